from __future__ import annotations

import datetime
import zipfile

import pytest
from fixtures import A, B, ROWS_A, ROWS_B
from pyspark.sql import functions as F

from swellworks.operators import bulletin, present
from swellworks.plans import api
from swellworks.sources import bulletins as source
from swellworks.streaming import ingest

NOW = datetime.datetime(2025, 1, 31, 3)


def bulletins(spark, *texts, date="20250130", hour="18"):
    return spark.createDataFrame([(t, date, hour, str(i)) for i, t in enumerate(texts)], "value string, run_date string, run_hour string, station_id string")


def typed(df, zone):
    local = F.from_utc_timestamp("ts_utc", F.lit(zone))
    rows = df.withColumn("tz", F.lit(zone)).select("pos", F.col("ts_utc").cast("string"), F.date_format(local, "EEEE, MMMM d, yyyy"), F.date_format(local, "h:mm a"), "swells", "combined_ft").orderBy("pos").collect()
    return [(r[0], r[1], r[2], r[3], [s and (s.hs_ft, s.tp_s, s.dir_deg) for s in r.swells], r.combined_ft) for r in rows]


@pytest.mark.parametrize(("text", "zone", "want"), [(A, "Pacific/Honolulu", ROWS_A), (B, "America/New_York", ROWS_B)])
def test_goldens(spark, text, zone, want):
    assert typed(bulletin.forecast(bulletin.parsed(bulletins(spark, text))), zone) == want


def test_plan_has_no_exchange(spark):
    plan = bulletin.forecast(bulletin.parsed(bulletins(spark, A, B)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_headers(spark):
    a, b = bulletin.parsed(bulletins(spark, A, B)).orderBy("station_id").collect()
    assert (a.layout, str(a.cycle_ts), a.lat, a.lon, a.tz, a.zone_source) == ("A", "2025-01-30 18:00:00", 21.67, -158.12, "Pacific/Honolulu", "box")
    assert a.model_run_str == "Model Run: Thursday, January 30, 2025 08:00 AM"
    assert (b.layout, str(b.cycle_ts), b.lat, b.lon, b.tz) == ("B", "2025-03-08 12:00:00", 40.25, -73.16, "America/New_York")
    assert b.model_run_str == "Model Run: Saturday, March 8, 2025 07:00 AM"


def test_errors_and_fallbacks(spark):
    header = A.split("| 30 18")[0]
    late = "\n" * 10 + "day &\n| 30 18 | 1.0 |"
    texts = ["", "nothing\nhere", header, header.replace("20250130 18", "20250130 24"), header.replace("(21.67N", "( 21.67N"), late, None, "| day & |\n| 30 18 |\n| 30 19 | 1.0 | 1.0 2.0 inf |", "Hr\n" + "1e300 " + "1 " * 25]
    rows = bulletin.parsed(bulletins(spark, *texts)).orderBy("station_id").collect()
    assert [r.error for r in rows] == [bulletin.EMPTY, bulletin.NO_SECTION, bulletin.NO_ROWS, bulletin.NO_ROWS, bulletin.NO_ROWS, bulletin.NO_SECTION, bulletin.EMPTY, None, bulletin.NO_ROWS]
    assert str(rows[3].cycle_ts) == "2025-01-30 18:00:00"
    assert rows[4].tz == "UTC" and rows[4].lat is None
    at = bulletins(spark, texts[4]).select(bulletin.map_position(F.lit(rows[4].location_str)).alias("p")).first().p
    assert (at.lat, at.lon) == (21.67, -158.12)
    assert len(rows[7].rows) == 1 and rows[7].rows[0].swells == [None] * 6
    issues = bulletin.parse_issues(bulletins(spark, A)).first()
    assert (issues.candidates, issues.parsed) == (7, 4)


def test_repeated_times_and_order(spark):
    text = "Cycle : 20250130 18\n| day & |\n| 31 0 | 1.0 |\n| 31 0 | 2.0 |\n| 30 23 | 3.0 |"
    got = [str(r.ts_utc) for r in bulletin.forecast(bulletin.parsed(bulletins(spark, text))).orderBy("pos").collect()]
    assert got == ["2025-01-31 00:00:00", "2025-01-31 00:00:00", "2025-03-30 23:00:00"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("landing")
    for date, hour, station, text in (("20250130", "06", "51201", B), ("20250130", "18", "51201", A), ("20250131", "00", "44025", B), ("20250130", "18", "44025", B), ("20250130", "18", "99", "x\ny")):
        d = base / f"run_date={date}" / f"run_hour={hour}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"gfswave.{station}.bull").write_text(text)
    return str(base)


def test_latest_run_and_api(spark, root):
    run = source.latest_run(source.probed_runs(spark, root, NOW), NOW).first()
    assert (run.run_date, run.run_hour) == ("20250130", "18")  # 00 of the 31st lacks the sentinel
    later = NOW + datetime.timedelta(days=3)
    assert source.latest_run(source.probed_runs(spark, root, later), later).first().run_date is None
    with pytest.raises(api.NoForecast):
        api.table_view(spark, root, now=later)
    one = source.run_bulletins(spark, root, "20250130", "18")
    assert sorted(r.station_id for r in one.collect()) == ["44025", "51201", "99"] and {(r.run_date, r.run_hour) for r in one.collect()} == {("20250130", "18")}
    assert len(one.inputFiles()) == 3  # no other run's folder is listed
    view = api.table_view(spark, root, tz="Pacific/Honolulu", now=NOW)
    assert view.columns[5:] == present.GRID and len(present.GRID) == 21
    assert [r.time_local for r in view.collect()] == ["8:00 AM", "11:00 AM", "2:00 PM", "8:00 PM"]
    metric = api.table_view(spark, root, tz="Not/AZone", unit="foo", now=NOW).first()
    assert (metric.s1_hs, metric.s2_hs, metric.s3_hs, metric.combined_hs) == (1.3, 0.75, 0.42, 2.11)
    with pytest.raises(api.NoForecast):
        api.render_html(spark, root, "99", now=NOW)
    with pytest.raises(api.NoForecast):
        api.export_xlsx(spark, root, "/tmp", "99", now=NOW)


def test_html(spark, root):
    page = api.render_html(spark, root, tz="Pacific/Honolulu", now=NOW)
    assert page.count("<tr>") == 9 and page.count("<td") == 3 + 4 * 21 and page.count("<th") == 9 + 19
    assert "Time Zone: Pacific/Honolulu" in page and ">4.27<" in page and "1px dashed #999" in page and ">6.92<" in page
    assert "(m)" in api.render_html(spark, root, unit="Metric", now=NOW)
    odd = bulletins(spark, A.replace("Location :", "Location : <b>&'\""))
    from swellworks.sinks.html import table_html

    assert "&lt;b&gt;&amp;&#39;&quot;" in table_html(bulletin.parsed(odd)).first().html


def test_workbook(spark, root, tmp_path):
    path = api.export_xlsx(spark, root, str(tmp_path), tz="Pacific/Honolulu", now=NOW)
    assert path.endswith("/51201_table_view.xlsx")
    with zipfile.ZipFile(path) as z:
        sheet, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
        assert 'name="Table View"' in z.read("xl/workbook.xml").decode()
    assert sheet.count("<row ") == 9 and '<mergeCell ref="A1:U1"/>' in sheet and "4.27" in sheet and 'r="U9"' in sheet
    assert "FFC00000" in styles and 'style="dashed"' in styles


def test_stream_equals_batch(spark, root, tmp_path):
    query = ingest.ingest(spark, root, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    batch = bulletin.forecast(bulletin.parsed(source.bulletins(spark, root)))
    streamed = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(streamed) == key(batch) and batch.count() == 4 + 3 + 3 + 3
