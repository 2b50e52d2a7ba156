"""The station catalogue: ids joined with names and positions by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from swellworks.functions.measures import LENIENT_POSITION, position


def fallback_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table's rows, or all of the second if the first has none; one plan, no driver round trip."""
    some = first.limit(1).select(F.lit(1).alias("_one"))
    return first.unionByName(second.join(F.broadcast(some), F.lit(True), "left_anti"))


def named(ids: DataFrame, meta: DataFrame) -> DataFrame:
    """Every listed id (order and duplicates kept) with its name, or the id itself."""
    names = meta.select("id", F.col("name").alias("_name"))
    return ids.join(names, "id", "left").withColumn("name", F.coalesce("_name", "id")).drop("_name")


def located(ids: DataFrame, coords: DataFrame, defaults: DataFrame) -> DataFrame:
    """Positions from coords; if either number is missing both come from defaults; rows still without both go."""
    c = coords.select("id", F.struct("lat", "lon").alias("_c"))
    d = defaults.select("id", F.struct("lat", "lon").alias("_d"))
    at = F.when(F.col("_c.lat").isNotNull() & F.col("_c.lon").isNotNull(), F.col("_c")).otherwise(F.col("_d"))
    out = ids.join(c, "id", "left").join(d, "id", "left").withColumn("_at", at)
    return out.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_c", "_d", "_at").where("lat IS NOT NULL AND lon IS NOT NULL")


def stations(ids: DataFrame, meta: DataFrame, coords: DataFrame, defaults: DataFrame) -> DataFrame:
    """(pos, id, name, lat, lon).  Sides stay unhinted: Spark broadcasts those whose size allows it."""
    return located(named(ids, meta), coords, defaults).select("pos", "id", "name", "lat", "lon")


def markers(rows: DataFrame) -> DataFrame:
    """rows that a map can show."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(ok("lat") & ok("lon") & (F.col("id") != ""))


def bounding_box(rows: DataFrame, pad: float = 0.2) -> DataFrame:
    """A5: (south, west, north, east) around all rows, widened by ``pad`` of its size each way; the world if there are none."""
    edge = rows.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    h, w = (F.col("n") - F.col("s")) * pad, (F.col("e") - F.col("w")) * pad
    pick = lambda value, default: F.coalesce(value, F.lit(default))
    return edge.select(pick(F.col("s") - h, -90.0).alias("south"), pick(F.col("w") - w, -180.0).alias("west"), pick(F.col("n") + h, 90.0).alias("north"), pick(F.col("e") + w, 180.0).alias("east"))


def selected_position(station_rows: DataFrame, station: str, location: Column) -> Column:
    """J5 for one station: its catalogue position if it has one, else that of the location line as the map reads it."""
    found = station_rows.where(F.col("id") == station).select("lat", "lon").first()
    parsed = position(location, LENIENT_POSITION)
    return F.coalesce(F.struct(F.lit(found.lat).alias("lat"), F.lit(found.lon).alias("lon")), parsed) if found else parsed


def station_options(rows: DataFrame, selected: str = "", prefix: bool = False) -> DataFrame:
    """SNK6: (value, label, selected) for a choice; labels may lead with the id."""
    label = F.concat_ws(" - ", "id", "name") if prefix else F.col("name")
    return rows.select(F.col("id").alias("value"), label.alias("label"), (F.col("id") == selected).alias("selected"))
