from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from swellworks.functions import measures as m, text as t, zones
from swellworks.operators import catalogue as ops, timeline
from swellworks.sources import bulletins as source, stations as st


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_lines_tokens_strip(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g", "\n\n", None, "  x\t"]
    assert each(spark, t.lines, texts) == [x.splitlines() if x is not None else None for x in texts]
    padded = [" a  b\t", "", " \n ", "x y\x1cz"]
    assert each(spark, t.tokens, padded) == [x.split() for x in padded]
    assert each(spark, t.strip, padded) == [x.strip() for x in padded]
    assert each(spark, t.fields, ["a| b |", "|"]) == [["a", "b", ""], ["", ""]]


def test_numbers(spark):
    assert each(spark, t.to_number, ["1.5", "+1", "1e2", ".5", "5.", "1.5d", "0x1p3", "nan", "inf", "1_0", "", None, "x"]) == [1.5, 1.0, 100.0, 0.5, 5.0] + [None] * 8
    assert each(spark, t.to_integer, ["+1", "01", "1.0", "99999999999", "-3", ""]) == [1, 1, None, None, -3, None]
    assert each(spark, t.truncated, [90.9, -90.9, 1e300], "double") == [90, -90, None]


def test_direction_and_units(spark):
    assert each(spark, m.reversed_direction, [310, 20, 359, 180, 0, -20], "int") == [130, 200, 179, 0, 180, 160]
    twice = each(spark, lambda c: m.reversed_direction(m.reversed_direction(c)), list(range(0, 360, 7)), "int")
    assert twice == list(range(0, 360, 7))
    metres = [k / 100 for k in range(0, 5000, 13)]
    back = each(spark, lambda c: F.round(m.shown_height(F.round(m.feet(c), 2), F.lit("Metric")), 2), metres, "double")
    assert back == metres


def test_bands(spark):
    times = ["05:00", "05:30", "06:00", "19:00", "19:30", "20:00", "00:00", "12:00"]
    rows = each(spark, lambda c: m.time_band(F.concat(F.lit("2025-01-01 "), c).cast("timestamp")), times)
    assert rows == ["night", None, "day", "day", None, "night", "night", "day"]


def test_hours_and_runs(spark):
    start = F.lit(datetime.datetime(2025, 3, 8, 12)).cast("timestamp")
    assert str(value(spark, m.hours_later(start, F.lit(18.5)))) == "2025-03-09 06:30:00"
    assert value(spark, m.hours_later(start, F.lit(1e300))) is None and value(spark, m.hours_later(start, F.lit(7e7 - 1))) is None
    assert value(spark, m.run_timestamp(F.lit("20250130"), F.lit("24"))) is None and value(spark, m.run_timestamp(F.lit("20250230"), F.lit("00"))) is None


@pytest.mark.parametrize(("start", "day", "hour", "want"), [
    ("2025-01-30 18:00:00", 30, 18, "2025-01-30 18:00:00"), ("2025-01-30 18:00:00", 30, 17, "2025-03-30 17:00:00"), ("2025-01-31 00:00:00", 1, 0, "2025-02-01 00:00:00"),
    ("2024-01-30 00:00:00", 29, 0, "2024-02-29 00:00:00"), ("2025-01-30 00:00:00", 29, 0, "2025-03-29 00:00:00"), ("2025-01-30 00:00:00", 32, 0, None), ("2025-01-30 00:00:00", 1, 24, None), ("2025-12-31 23:00:00", 1, 1, "2026-01-01 01:00:00"),
])
def test_next_time(spark, start, day, hour, want):
    got = value(spark, timeline.next_time(F.lit(start).cast("timestamp"), F.lit(day), F.lit(hour)))
    assert (got and str(got)) == want


def test_zones(spark):
    ask = lambda n: zones.canonical_zone(spark, n)
    assert [ask(n) for n in ("pacific/honolulu", "Not/AZone", "+05:00", "ROC", "", None, "EST")] == ["Pacific/Honolulu", None, None, "Asia/Taipei", None, None, "EST"]
    assert value(spark, zones.position_zone(F.lit(0.0), F.lit(-150.0)).zone) == "Etc/GMT+10"
    assert value(spark, zones.position_zone(F.lit(None).cast("double"), F.lit(1.0)).zone) == "UTC"
    options = [r.value for r in zones.zone_options(spark, "UTC").collect()]
    assert options == sorted(options) and "Pacific/Honolulu" in options and "EST" not in options
    assert len(options) > 400 and {"UTC", "GMT", "US/Hawaii", "Canada/Pacific", "Asia/Kolkata"} <= set(options) and not {"Asia/Calcutta", "US/Samoa"} & set(options)
    known = {r.name for r in zones.zone_dimension(spark).collect()}
    assert set(options) <= known and {b[0] for b in zones.BOXES} <= known
    for lat, lon, zone in ((15.5, 73.0, "Asia/Kolkata"), (-23.9, -46.0, "America/Sao_Paulo"), (-33.0, -72.0, "America/Santiago")):
        assert value(spark, zones.position_zone(F.lit(lat), F.lit(lon)).zone) == zone


def test_station_sources(spark):
    text = "# comment\n\n51201|o|t|h|Waimea|n|21.671 N 158.118 W (x)\n 51202 |||||| 1.0 s 2.0 e\nshort|row\n|a|b|c|d|e|1 N 2 W\n5|a|b|c|d|e|x N 2 W\n51201|o|t|h|Later|n|1 N 2 E\n6|a|b|c|d|e|1 N 2"
    rows = sorted(tuple(r) for r in st.parse_station_lines(st.numbered_lines(spark.createDataFrame([(text,)], "value string"))).select("id", "name", "lat", "lon").collect())
    assert rows == [("51201", "Later", 1.0, 2.0), ("51202", "51202", -1.0, 2.0)]
    coords = st.parse_coordinates(spark.createDataFrame([('{"1": {"lat": 1.5, "lon": "2"}, "2": {"lat": "x", "lon": 1}, "3": {"lon": 1}}',)], "value string"))
    assert [tuple(r) for r in coords.collect()] == [("1", 1.5, 2.0)]
    ids = st.parse_id_list(spark.createDataFrame([('["b", " a ", "", 7, "b"]',)], "value string"))
    assert [r.id for r in ids.orderBy("pos").collect()] == ["b", "a", "7", "b"]


def test_catalogue(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    ids = frame([(0, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "d")], "pos int, id string")
    meta = frame([("a", "A", 9.0, 9.0)], "id string, name string, lat double, lon double")
    coords = frame([("a", 1.0, 2.0), ("b", 1.0, None)], "id string, lat double, lon double")
    defaults = frame([("b", "x", 3.0, 4.0), ("d", "y", 5.0, 6.0)], "id string, name string, lat double, lon double")
    rows = [tuple(r) for r in ops.stations(ids, meta, coords, defaults).orderBy("pos").collect()]
    assert rows == [(0, "a", "A", 1.0, 2.0), (1, "b", "b", 3.0, 4.0), (3, "a", "A", 1.0, 2.0), (4, "d", "d", 5.0, 6.0)]
    box = ops.bounding_box(ops.stations(ids, meta, coords, defaults)).first()
    assert (box.south, box.north) == (pytest.approx(0.2), pytest.approx(5.8))
    assert tuple(ops.bounding_box(ids.limit(0).selectExpr("0D AS lat", "0D AS lon")).first()) == (-90.0, -180.0, 90.0, 180.0)
    options = ops.station_options(ops.stations(ids, meta, coords, defaults), "b", prefix=True).collect()
    assert [(o.label, o.selected) for o in options if o.value == "b"] == [("b - b", True)]
    assert value(spark, ops.selected_position(ops.stations(ids, meta, coords, defaults), "zz", F.lit("( 1.5N 2W)")).lat) == 1.5


def test_links(spark):
    pages = spark.createDataFrame([('<a href="gfswave.51201.bull">x</a><a href="gfswave.51201.bull"/><a href="gfswave.9.spec"/><a href="x.bull"/>',)], "html string")
    assert [r.id for r in source.listed_stations(pages).collect()] == ["51201"]


def test_public_station_list(spark, tmp_path):
    import json

    from swellworks.plans import api
    from swellworks.sinks import json as sink

    (tmp_path / "ids.json").write_text(json.dumps(["51201", "zz"]))
    listed = api.stations(spark, str(tmp_path / "ids.json"))
    assert [r.id for r in listed.collect()] == ["51201"]
    everything = api.stations(spark, None)
    assert everything.count() == 10
    array = json.loads(sink.station_array(everything).first().json)
    assert array[0] == {"id": "51201", "name": "Buoy 51201", "lat": 21.67, "lon": -158.12}


def test_station_list_without_readable_sources(spark, tmp_path):
    from swellworks.plans import api

    (tmp_path / "ids.json").write_text('["51201", "7"]')
    (tmp_path / "bad.json").write_text("{not json")
    gone, ids, bad = str(tmp_path / "gone"), str(tmp_path / "ids.json"), str(tmp_path / "bad.json")
    fallback = [(s[0], s[1]) for s in st.FALLBACK]
    for paths in ((gone, gone, gone), (None, None, None), (bad, None, bad)):
        assert [(r.id, r.name) for r in api.stations(spark, *paths).orderBy("pos").collect()] == fallback
    assert [(r.id, r.name, r.lat) for r in api.stations(spark, ids, gone, bad).orderBy("pos").collect()] == [("51201", "Buoy 51201", 21.67)]
