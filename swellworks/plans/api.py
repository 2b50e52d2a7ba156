"""The public functions: table view, HTML page part, workbook, station list."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from swellworks.functions.measures import US
from swellworks.functions.zones import canonical_zone
from swellworks.operators import bulletin, catalogue, present
from swellworks.sinks import html, xlsx
from swellworks.sources import bulletins as source, stations as station_source

DEFAULT_STATION = "51201"


class NoForecast(Exception):
    """There is no table for a request; the message says why."""


def newest_bulletins(spark: SparkSession, root: str, now: datetime.datetime | None = None) -> DataFrame:
    """All stations' bulletins of the newest run, found by eight probes; older runs are neither listed nor read."""
    at = now or datetime.datetime.now(datetime.timezone.utc)
    run = source.latest_run(source.probed_runs(spark, root, at), at).first()
    if run.run_date is None:
        raise NoForecast("no recent model run found")
    return source.run_bulletins(spark, root, run.run_date, run.run_hour)


def parsed_station(spark: SparkSession, root: str, station: str | None = None, tz: str | None = None, now: datetime.datetime | None = None) -> DataFrame:
    """One parsed bulletin.  Empty arguments take defaults; an invalid zone is ignored."""
    zone = canonical_zone(spark, tz)
    found = newest_bulletins(spark, root, now).where(F.col("station_id") == (station or DEFAULT_STATION))
    return bulletin.parsed(found, F.lit(zone).cast("string"))


def table_view(spark: SparkSession, root: str, station: str | None = None, tz: str | None = None, unit: str | None = None, now: datetime.datetime | None = None) -> DataFrame:
    """The 21 columns (and keys) of a station's newest forecast, heights in the unit (US, or else metric)."""
    rows = bulletin.forecast(parsed_station(spark, root, station, tz, now))
    return present.wide(rows, None if (unit or US) == US else F.lit(unit)).orderBy("pos")


def render_html(spark: SparkSession, root: str, station: str | None = None, tz: str | None = None, unit: str | None = None, now: datetime.datetime | None = None) -> str:
    """The table as HTML; NoForecast with the reason if there is none."""
    row = html.table_html(parsed_station(spark, root, station, tz, now), unit or US).first()
    if row is None:
        raise NoForecast("no file for this station in the newest run")
    if row.error is not None:
        raise NoForecast(row.error)
    return row.html


def export_xlsx(spark: SparkSession, root: str, folder: str, station: str | None = None, tz: str | None = None, unit: str | None = None, now: datetime.datetime | None = None) -> str:
    """SNK5: ``<station>_table_view.xlsx`` in folder; NoForecast if there are no rows."""
    station = station or DEFAULT_STATION
    try:
        return xlsx.export(bulletin.forecast(parsed_station(spark, root, station, tz, now)), f"{folder}/{station}_table_view.xlsx", unit or US)
    except ValueError as error:
        raise NoForecast(f"Error: {error}") from error


def stations(spark: SparkSession, list_path: str | None, table_path: str | None = None, coords_path: str | None = None) -> DataFrame:
    """The station list (pos, id, name, lat, lon).

    Sources that aren't given or can't be read are empty, and no ids at all mean the fallback's; without a readable
    table the fallback's names and positions stand in for it.
    """
    empty = lambda schema: spark.createDataFrame([], schema)
    list_path, table_path, coords_path = (p if p and source.exists(spark, p) else None for p in (list_path, table_path, coords_path))
    defaults = station_source.fallback(spark)
    order = [(i, s[0]) for i, s in enumerate(station_source.FALLBACK)]
    ids = station_source.id_list(spark, list_path) if list_path else empty("pos int, id string")
    ids = catalogue.fallback_union(ids, spark.createDataFrame(order, "pos int, id string"))
    meta = station_source.station_table(spark, table_path) if table_path else defaults
    coords = station_source.coordinates(spark, coords_path) if coords_path else empty("id string, lat double, lon double")
    return catalogue.stations(ids, meta, coords, defaults)
