"""Typed forecasts to what the table view shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from swellworks.functions.measures import date_label, shown_height, time_band, time_label
from swellworks.operators.bulletin import SLOTS

#: Columns of the table view, in order.
GRID = ["date_local", "time_local", *[f"s{i}_{m}" for i in range(1, SLOTS + 1) for m in ("hs", "tp", "dir")], "combined_hs"]


def wide(rows: DataFrame, unit: Column | None = None) -> DataFrame:
    """C4: run_date, run_hour, station_id, pos, ts_utc and the 21 columns; heights in feet, or converted for display by ``unit``."""
    height = (lambda c: c) if unit is None else (lambda c: F.round(shown_height(c, unit), 2))
    local = F.from_utc_timestamp("ts_utc", F.col("tz"))
    slots = []
    for i in range(SLOTS):
        s = F.get("swells", F.lit(i))
        slots += [height(s.hs_ft).alias(f"s{i + 1}_hs"), s.tp_s.alias(f"s{i + 1}_tp"), s.dir_deg.alias(f"s{i + 1}_dir")]
    return rows.select("run_date", "run_hour", "station_id", "pos", "ts_utc", date_label(local).alias("date_local"), time_label(local).alias("time_local"), *slots, height(F.col("combined_ft")).alias("combined_hs"))


def with_band(rows: DataFrame) -> DataFrame:
    """S26 of every row of the long form."""
    return rows.withColumn("band", time_band(F.from_utc_timestamp("ts_utc", F.col("tz"))))
