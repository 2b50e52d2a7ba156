"""File-stream ingest: new bulletins to typed forecasts, appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from swellworks.operators import bulletin
from swellworks.sources.bulletins import bulletin_stream


def forecast_stream(spark: SparkSession, root: str) -> DataFrame:
    """The batch plan on a stream.  A bulletin is self-contained, so there is no state and no watermark."""
    return bulletin.forecast(bulletin.parsed(bulletin_stream(spark, root)))


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append all files not seen yet, exactly once, then stop."""
    return forecast_stream(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
