"""Bulletins composed from the events and lineitem tables, so that the parser can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def dealt(rows: DataFrame) -> DataFrame:
    """The composed rows over all cores: they are small, so Spark would parse them in a task or two."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def bulletins_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout A: a bulletin a user, a row an hour with events, and a group for each of its events, the seventh and on too.

    Height is the event's value, period event_id modulo 20, direction event_id modulo 360; the combined height is the
    first event's value.  Stars stand before some heights, apart or not.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value", F.date_trunc("hour", "ts").alias("hour"))
    star = F.when(F.col("event_id") % 5 == 0, "*").when(F.col("event_id") % 5 == 1, "* ").otherwise("")
    cell = F.concat_ws(" ", F.concat(star, F.col("value").cast("string")), (F.col("event_id") % 20).cast("string"), (F.col("event_id") % 360).cast("string"))
    hours = events.groupBy("user_id", "hour").agg(F.array_sort(F.collect_list(F.struct("event_id", "value", cell.alias("cell"), star.alias("star")))).alias("e"))
    line = F.concat(F.lit("| "), F.dayofmonth("hour").cast("string"), F.lit(" "), F.hour("hour").cast("string"), F.lit(" | "), F.trim(F.get("e", F.lit(0)).star), F.get("e", F.lit(0)).value.cast("string"), F.lit(" 1 | "), F.array_join("e.cell", " | "), F.lit(" |"))
    rows = hours.select("user_id", F.struct("hour", line.alias("line")).alias("r")).groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    start = F.date_trunc("month", F.get("r", F.lit(0)).hour)
    head = F.concat(F.lit("Location : "), F.col("user_id").cast("string"), F.lit("  (21.67N 158.12W)\nCycle : "), F.date_format(start, "yyyyMMdd"), F.lit(" 00 UTC\n| day & | Hst |\n"))
    return dealt(rows).select(F.concat(head, F.array_join("r.line", "\n")).alias("value"), F.date_format(start, "yyyyMMdd").alias("run_date"), F.lit("00").alias("run_hour"), F.col("user_id").cast("string").alias("station_id"))


def bulletins_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout B: a bulletin an order, a row a line; two groups from quantity, line number and supplier, the combined height from the part."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = lambda c: c.cast("string")
    n, k = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    row = F.concat_ws(" ", text(n * 3), F.lit("1 2 3 4 5"), text(k), text(n), text(F.col("l_suppkey") % 360), text(k + 1), text(n + 1), text(F.col("l_partkey") % 360), F.lit(". . . . . . . ."), text(F.col("l_partkey") % 100))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("line")))).alias("r"))
    value = F.concat(F.lit("Cycle : 20250308 12 UTC\nLocation : x (40.25N 73.16W)\nHr a b\n"), F.array_join("r.line", "\n"))
    return dealt(rows).select(value.alias("value"), F.lit("20250308").alias("run_date"), F.lit("12").alias("run_hour"), F.col("l_orderkey").cast("string").alias("station_id"))
