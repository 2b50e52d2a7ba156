"""Bulletin files: ``run_date=YYYYMMDD/run_hour=HH/gfswave.<station>.bull`` below a root."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Run keys stay strings: discovery would make 06 an int.
SCHEMA = "value string, run_date string, run_hour string"
SENTINEL = "51201"
HOURS = ("00", "06", "12", "18")


def _station(df: DataFrame) -> DataFrame:
    name = F.col("_metadata.file_name")
    return df.select("value", "run_date", "run_hour", F.regexp_extract(name, r"gfswave\.(.+)\.bull$", 1).alias("station_id")).where("station_id <> ''")


def bulletins(spark: SparkSession, root: str) -> DataFrame:
    """SRC1: one row a file: value, run_date, run_hour, station_id.  Filters on the run keys prune folders."""
    return _station(spark.read.schema(SCHEMA).text(root, wholetext=True))


def bulletin_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream of new files."""
    return _station(spark.readStream.schema(SCHEMA).text(root, wholetext=True))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, whatever the store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def days_before(now: datetime.datetime) -> list[str]:
    """Run keys of today and yesterday (UTC)."""
    return [(now - datetime.timedelta(days=d)).strftime("%Y%m%d") for d in (0, 1)]


def probed_runs(spark: SparkSession, root: str, now: datetime.datetime, sentinel: str = SENTINEL) -> DataFrame:
    """SRC2: run_date, run_hour, station_id of the sentinel's files of two days: eight probes, no folder is listed."""
    runs = [(d, h, sentinel) for d in days_before(now) for h in HOURS if exists(spark, f"{root}/run_date={d}/run_hour={h}/gfswave.{sentinel}.bull")]
    return spark.createDataFrame(runs, "run_date string, run_hour string, station_id string")


def run_bulletins(spark: SparkSession, root: str, run_date: str, run_hour: str) -> DataFrame:
    """SRC1 of one run: only its folder is listed."""
    return _station(spark.read.schema(SCHEMA).option("basePath", root).text(f"{root}/run_date={run_date}/run_hour={run_hour}", wholetext=True))


def latest_run(existing: DataFrame, now: datetime.datetime, sentinel: str = SENTINEL) -> DataFrame:
    """The newest run of today or yesterday (UTC) that has the sentinel's file: (run_date, run_hour), nulls if none.

    ``existing`` has run_date, run_hour, station_id.  A filter and one partial maximum; runs after ``now`` count.
    """
    held = existing.where(F.col("run_date").isin(days_before(now)) & F.col("run_hour").isin(*HOURS) & (F.col("station_id") == sentinel))
    return held.agg(F.max(F.struct("run_date", "run_hour")).alias("r")).select("r.run_date", "r.run_hour")


def hrefs(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC6: distinct link targets of HTML pages."""
    return pages.select(F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


def listed_stations(pages: DataFrame, html: str = "html") -> DataFrame:
    """Station ids of the bulletin links in directory pages."""
    name = F.col("href")
    return hrefs(pages, html).where(name.startswith("gfswave.") & name.endswith(".bull")).select(F.split(name, r"\.")[1].alias("id")).distinct()
