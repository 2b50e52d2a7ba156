"""Station sources: pipe-delimited table, coordinate JSON, id list JSON, inline fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from swellworks.functions.measures import signed
from swellworks.functions.text import fields, lines, or_default, strip, to_number, tokens

#: Fallback stations, fixed values.
FALLBACK = [
    ("51201", "Buoy 51201", 21.67, -158.12),
    ("51202", "Buoy 51202", 21.45, -157.90),
    ("51203", "Buoy 51203", 21.55, -157.95),
    ("51211", "Buoy 51211", 21.32, -157.53),
    ("51212", "Buoy 51212", 21.27, -157.47),
    ("51213", "Buoy 51213", 21.17, -157.17),
    ("51001", "Buoy 51001", 16.87, -156.47),
    ("51002", "Buoy 51002", 12.38, -157.49),
    ("51003", "Buoy 51003", 23.69, -162.25),
    ("51004", "Buoy 51004", 25.84, -162.09),
]
STATION = "id string, name string, lat double, lon double"


def fallback(spark: SparkSession) -> DataFrame:
    """SRC7."""
    return spark.createDataFrame(FALLBACK, STATION)


def numbered_lines(texts: DataFrame, value: str = "value") -> DataFrame:
    """(pos, line) of every text."""
    return texts.select(F.posexplode(lines(F.col(value))).alias("pos", "line"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A3: the last row of each key; one partial aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*").drop(order)


def parse_station_lines(rows: DataFrame) -> DataFrame:
    """SRC3: (id, name, lat, lon) from (pos, line): comments, short rows, blank ids and unusable positions are left out."""
    line = F.col("line")
    kept = rows.where((strip(line) != "") & ~F.startswith(strip(line), F.lit("#"))).select("pos", fields(strip(line)).alias("p")).where(F.size("p") >= 7)
    at: Column = tokens(F.get("p", F.lit(6)))
    parts = kept.select("pos", F.get("p", F.lit(0)).alias("id"), F.get("p", F.lit(4)).alias("raw_name"), at.alias("t")).where((F.col("id") != "") & (F.size("t") >= 4))
    side = lambda k: F.upper(F.get("t", F.lit(k)))
    number = lambda k: to_number(F.get("t", F.lit(k)))
    found = parts.select("pos", "id", or_default(F.col("raw_name"), F.col("id")).alias("name"), signed(number(0), side(1)).alias("lat"), signed(number(2), side(3)).alias("lon"))
    return last_wins(found.where("lat IS NOT NULL AND lon IS NOT NULL"), "id", "pos")


def station_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC3 from a file."""
    return parse_station_lines(numbered_lines(spark.read.text(path, wholetext=True)))


def parse_coordinates(texts: DataFrame) -> DataFrame:
    """SRC4: (id, lat, lon) of an object of objects; entries without two numbers are left out."""
    entry = F.explode(F.from_json("value", "map<string,struct<lat:string,lon:string>>")).alias("id", "c")
    return texts.select(entry).select("id", to_number(strip(F.col("c.lat"))).alias("lat"), to_number(strip(F.col("c.lon"))).alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """SRC4 from a file."""
    return parse_coordinates(spark.read.text(path, wholetext=True))


def parse_id_list(texts: DataFrame) -> DataFrame:
    """SRC5: (pos, id) in order, duplicates kept, blanks left out."""
    return texts.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw")).select("pos", strip(F.col("raw")).alias("id")).where("id <> ''")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC5 from a file."""
    return parse_id_list(spark.read.text(path, wholetext=True))
