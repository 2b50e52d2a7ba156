"""SNK3: the station list as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def station_lines(rows: DataFrame) -> DataFrame:
    """(pos, json): an object a station; distributed, for ``df.write.text``."""
    return rows.select("pos", F.to_json(F.struct("id", "name", "lat", "lon")).alias("json"))


def station_array(rows: DataFrame) -> DataFrame:
    """One row with the array in order of pos: a catalogue is a few thousand stations; longer lists go as lines."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "lat", "lon"))), lambda x: F.struct(x.id.alias("id"), x["name"].alias("name"), x.lat.alias("lat"), x.lon.alias("lon")))
    return rows.agg(F.to_json(items).alias("json"))
