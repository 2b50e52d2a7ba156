"""Time zones: names that may be asked for, and the zone of a position."""

from __future__ import annotations

import functools
import importlib.resources
import pathlib
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Boxes (zone, south, north, west, east) of land and coastal waters where buoys lie, first match wins; an
#: approximation in place of zone polygons, replaceable by the caller.
BOXES = [
    ("Pacific/Honolulu", 18.5, 22.6, -160.6, -154.4),
    ("America/Los_Angeles", 32.5, 48.5, -125.2, -116.0),
    ("America/Anchorage", 55.0, 61.5, -160.0, -140.0),
    ("America/New_York", 24.3, 45.2, -82.9, -69.8),
    ("America/Chicago", 27.5, 30.8, -97.9, -85.5),
    ("America/Puerto_Rico", 17.6, 18.7, -67.5, -65.1),
    ("Europe/London", 49.8, 59.5, -6.5, 1.8),
    ("Asia/Tokyo", 30.9, 45.6, 129.5, 146.0),
    ("Australia/Sydney", -37.6, -28.1, 149.0, 153.8),
    ("Pacific/Auckland", -47.4, -34.3, 166.3, 178.7),
    ("Pacific/Guam", 13.1, 13.8, 144.5, 145.1),
    ("America/Vancouver", 48.5, 54.8, -133.5, -122.7),
    ("America/Halifax", 43.3, 47.1, -66.5, -59.6),
    ("America/St_Johns", 46.5, 51.7, -59.4, -52.5),
    ("America/Tijuana", 28.0, 32.5, -118.5, -114.8),
    ("America/Lima", -18.3, -3.4, -82.0, -70.5),
    ("America/Santiago", -56.0, -18.4, -76.5, -69.9),
    ("America/Montevideo", -35.2, -33.8, -58.5, -53.3),
    ("America/Sao_Paulo", -33.8, -18.0, -53.5, -38.9),
    ("America/Bahia", -18.0, -10.5, -40.0, -37.3),
    ("America/Fortaleza", -7.0, -2.7, -42.0, -34.7),
    ("Atlantic/Reykjavik", 63.2, 66.7, -24.7, -13.4),
    ("Atlantic/Azores", 36.8, 39.9, -31.4, -24.9),
    ("Atlantic/Canary", 27.5, 29.5, -18.3, -13.3),
    ("Europe/Dublin", 51.3, 55.5, -10.8, -5.5),
    ("Europe/Lisbon", 36.8, 41.9, -9.9, -7.4),
    ("Europe/Madrid", 35.9, 44.0, -9.5, 3.4),
    ("Europe/Paris", 42.3, 49.8, -5.2, 6.5),
    ("Europe/Oslo", 57.9, 71.3, 4.4, 31.2),
    ("Europe/Rome", 36.5, 45.7, 6.5, 18.6),
    ("Africa/Johannesburg", -35.5, -26.9, 16.3, 33.0),
    ("Asia/Colombo", 5.8, 9.9, 79.6, 82.0),
    ("Asia/Kolkata", 7.9, 23.8, 68.0, 88.9),
    ("Asia/Taipei", 21.8, 25.4, 119.9, 122.1),
    ("Asia/Shanghai", 20.0, 40.9, 108.0, 123.0),
    ("Asia/Seoul", 33.0, 38.7, 124.5, 129.5),
    ("Asia/Manila", 5.0, 19.0, 117.0, 127.0),
    ("Australia/Perth", -35.2, -14.0, 112.5, 129.0),
    ("Australia/Brisbane", -28.1, -10.0, 142.0, 154.0),
    ("Australia/Hobart", -43.8, -39.5, 143.5, 148.6),
]
#: Names that Python's zone tables have and Java's lack.
ALIASES = {"ROC": "Asia/Taipei"}
#: Names offered for choice beside those of the zone table, fixed values.
COMMON = ("UTC", "GMT")
CANADA = ("Atlantic", "Central", "Eastern", "Mountain", "Newfoundland", "Pacific")
US = ("Alaska", "Arizona", "Central", "Eastern", "Hawaii", "Mountain", "Pacific")


def zone_dimension(spark: SparkSession) -> DataFrame:
    """SRC8: (name, lookup, zone) of all names, ``zone`` as Java knows it.  Some 600 rows."""
    ids = spark._jvm.java.time.ZoneId
    java = set(ids.getAvailableZoneIds()) | set(ids.SHORT_IDS.keySet())
    names = sorted(n for n in zoneinfo.available_timezones() if n in java or n in ALIASES)
    return spark.createDataFrame([(n, n.lower(), ALIASES.get(n, n)) for n in names], "name string, lookup string, zone string")


@functools.cache
def common_zones() -> tuple[str, ...]:
    """O1: the names offered for choice, in order: those of the system's zone table, one a place, and COMMON, CANADA and US."""
    tables = [p for root in zoneinfo.TZPATH if (p := pathlib.Path(root, "zone.tab")).exists()]
    table = tables[0] if tables else importlib.resources.files("tzdata") / "zoneinfo" / "zone.tab"
    places = {line.split("\t")[2].strip() for line in table.read_text(encoding="utf-8").splitlines() if line and not line.startswith("#")}
    return tuple(sorted(places | set(COMMON) | {f"Canada/{c}" for c in CANADA} | {f"US/{c}" for c in US}))


def zone_options(spark: SparkSession, selected: str = "") -> DataFrame:
    """O1, SNK6: names for choice in order, with the selected one marked."""
    names = spark.createDataFrame([(n,) for n in common_zones()], "value string")
    return names.select("value", F.col("value").alias("label"), (F.col("value") == selected).alias("selected")).orderBy("value")


def canonical_zone(spark: SparkSession, name: str | None) -> str | None:
    """The zone of a name in any case; null for offsets and unknown names, which are to be ignored."""
    found = zone_dimension(spark).where(F.col("lookup") == (name or "").lower()).select("zone").first()
    return found.zone if found else None


def with_asked_zone(df: DataFrame, asked: str, into: str) -> DataFrame:
    """S13 for a column of names: ``into`` has the zone, or null."""
    known = zone_dimension(df.sparkSession).select(F.col("lookup").alias("_lookup"), F.col("zone").alias(into))
    return df.join(F.broadcast(known), F.lower(F.col(asked)) == F.col("_lookup"), "left").drop("_lookup")


def position_zone(lat: Column, lon: Column) -> Column:
    """struct<zone,source>: the first box that holds the position, else the nautical zone, else UTC."""
    inside = lambda b: lat.between(b[1], b[2]) & lon.between(b[3], b[4])
    box = F.coalesce(*[F.when(inside(b), F.lit(b[0])) for b in BOXES])
    hours = F.round(lon / 15).cast("int")
    # signs run the other way in these names
    nautical = F.when(hours == 0, F.lit("Etc/GMT")).otherwise(F.concat(F.when(hours > 0, "Etc/GMT-").otherwise("Etc/GMT+"), F.abs(hours).cast("string")))
    known = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(known & box.isNotNull(), F.struct(box.alias("zone"), F.lit("box").alias("source"))).when(known, F.struct(nautical.alias("zone"), F.lit("nautical").alias("source"))).otherwise(F.struct(F.lit("UTC").alias("zone"), F.lit("default").alias("source")))
