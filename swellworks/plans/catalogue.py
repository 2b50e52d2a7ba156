"""Registered queries of the forecast engine, each over whole tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from swellworks.functions import measures as m, text as t
from swellworks.functions.zones import common_zones, position_zone, with_asked_zone, zone_options as offered_zones
from swellworks.operators import bulletin, catalogue as stations_of, present, timeline
from swellworks.plans import compose
from swellworks.sinks import html, json as json_sink, xlsx
from swellworks.sinks.palette import COMBINED, GROUPS
from swellworks.sources import bulletins as source, stations as station_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if there is one."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compose layout-A bulletins from events, parse them, return the table view in Honolulu time."""
    done = bulletin.parsed(compose.bulletins_a(spark, sf_dir), F.lit("Pacific/Honolulu"))
    return present.wide(bulletin.forecast(done))


@query("SELECT event_id, round(value * 3.28084, 2) AS feet, round(round(value * 3.28084, 2) / 3.28084, 2) AS metres FROM events")
def unit_ft_m(spark, sf_dir):
    """Feet, and metres derived from them."""
    feet = F.round(m.feet(F.col("value")), 2)
    return table(spark, sf_dir, "events").select("event_id", feet.alias("feet"), F.round(m.shown_height(feet, F.lit("Metric")), 2).alias("metres"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 3.28084, 2) AS feet FROM lineitem")
def unit_ft_price(spark, sf_dir):
    """S12, S17."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(m.feet(F.col("l_extendedprice")), 2).alias("feet"))


@query("SELECT event_id, CAST(((CAST(trunc(value - 250) AS INTEGER) + 180) % 360 + 360) % 360 AS INTEGER) AS direction FROM events")
def direction_reverse(spark, sf_dir):
    """S10, S11, negative degrees too."""
    return table(spark, sf_dir, "events").select("event_id", m.reversed_direction(t.truncated(F.col("value") - 250)).alias("direction"))


_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE '{}')"


@query("SELECT event_id, strftime({0}, '%A, %B %-d, %Y') AS date_local, strftime({0}, '%-I:%M %p') AS time_local FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)".format(_LOCAL.format("Pacific/Honolulu")))
def local_labels_hst(spark, sf_dir):
    """S14-S16."""
    local = F.from_utc_timestamp("ts", "Pacific/Honolulu")
    return table(spark, sf_dir, "events").select("event_id", m.date_label(local).alias("date_local"), m.time_label(local).alias("time_local"))


@query("SELECT l_orderkey, l_linenumber, strftime({0}, '%A, %B %-d, %Y') AS date_local, strftime({0}, '%-I:%M %p') AS time_local FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_linenumber * 3 AS INTEGER)) AS ts FROM lineitem)".format(_LOCAL.format("America/New_York")))
def local_labels_dst(spark, sf_dir):
    """S14-S16, S22 across changes of daylight saving time."""
    local = F.from_utc_timestamp(m.hours_later(F.col("l_shipdate"), F.col("l_linenumber") * 3.0), "America/New_York")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m.date_label(local).alias("date_local"), m.time_label(local).alias("time_local"))


@query("SELECT o_orderkey, concat('Model Run: ', strftime({0}, '%A, %B %-d, %Y %I:%M %p')) AS label FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders)".format(_LOCAL.format("America/New_York")))
def model_run_label(spark, sf_dir):
    """S16b."""
    return table(spark, sf_dir, "orders").select("o_orderkey", m.model_run_label(F.from_utc_timestamp("o_orderdate", "America/New_York")).alias("label"))


@query("SELECT event_id, CASE WHEN x BETWEEN 360 AND 1140 THEN 'day' WHEN x >= 1200 OR x <= 300 THEN 'night' END AS band FROM (SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS x FROM events)")
def time_band(spark, sf_dir):
    """S26."""
    return table(spark, sf_dir, "events").select("event_id", m.time_band(F.col("ts")).alias("band"))


@query("""
WITH f AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS run_date, lpad(CAST(hour(ts) // 6 * 6 AS VARCHAR), 2, '0') AS run_hour, user_id FROM events)
SELECT r.run_date AS run_date, r.run_hour AS run_hour FROM (
  SELECT max({'run_date': run_date, 'run_hour': run_hour}) AS r FROM f
  WHERE user_id = (SELECT min(user_id) FROM events) AND run_date IN ('20240128', '20240129'))""")
def latest_run(spark, sf_dir):
    """Six-hour buckets of events are runs, the smallest user is the sentinel."""
    import datetime

    events = table(spark, sf_dir, "events")
    sentinel = str(events.agg(F.min("user_id")).first()[0])
    hour = F.lpad((F.floor(F.hour("ts") / 6) * 6).cast("string"), 2, "0")
    files = events.select(F.date_format("ts", "yyyyMMdd").alias("run_date"), hour.alias("run_hour"), F.col("user_id").cast("string").alias("station_id"))
    return source.latest_run(files, datetime.datetime(2024, 1, 29, 23), sentinel)


@query("SELECT user_id, event_id, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts_hour FROM events")
def timeline_rebuild(spark, sf_dir):
    """Day and hour of every event give back its time."""
    row = F.struct("ts", "event_id", F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    first = F.date_trunc("month", F.get("r", F.lit(0)).ts)
    timed = users.select("user_id", F.inline(F.arrays_zip("r.event_id", timeline.timeline(first, F.col("r")).alias("ts_hour"))))
    return timed.toDF("user_id", "event_id", "ts_hour")


_TRIPLES = ", ".join(f"max(CASE WHEN rn = {i} THEN round(value * 3.28084, 2) END) AS s{i}_hs, max(CASE WHEN rn = {i} THEN CAST(event_id % 20 AS DOUBLE) END) AS s{i}_tp, CAST(max(CASE WHEN rn = {i} THEN (event_id % 360 + 180) % 360 END) AS INTEGER) AS s{i}_dir" for i in range(1, 7))
_HOURS = "SELECT user_id, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS h, value, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events"

#: The table view of composed bulletins in Honolulu time: three header lines stand before the first row.
_VIEW = f"""
SELECT strftime(date_trunc('month', min(h) OVER (PARTITION BY user_id)), '%Y%m%d') AS run_date, '00' AS run_hour, CAST(user_id AS VARCHAR) AS station_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY h) + 2 AS INTEGER) AS pos, h AS ts_utc, {_LOCAL.replace("ts", "h").format("Pacific/Honolulu")} AS local,
  strftime(local, '%A, %B %-d, %Y') AS date_local, strftime(local, '%-I:%M %p') AS time_local, * EXCLUDE (user_id, h)
FROM (SELECT user_id, h, {_TRIPLES}, max(CASE WHEN rn = 1 THEN round(value * 3.28084, 2) END) AS combined_hs FROM ({_HOURS}) GROUP BY user_id, h)"""


@query(f"SELECT CAST(user_id AS VARCHAR) AS station_id, h AS ts_utc, {_TRIPLES}, max(CASE WHEN rn = 1 THEN round(value * 3.28084, 2) END) AS combined_hs FROM ({_HOURS}) GROUP BY user_id, h")
def bulletin_roundtrip_a(spark, sf_dir):
    """Layout A from text to 21 columns: F8, F9, W1, S11, S12, C1, O5."""
    done = bulletin.parsed(compose.bulletins_a(spark, sf_dir))
    return present.wide(bulletin.forecast(done)).drop("run_date", "run_hour", "pos", "date_local", "time_local")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS station_id, TIMESTAMP '2025-03-08 12:00:00' + to_hours(CAST(l_linenumber * 3 AS INTEGER)) AS ts_utc,
  round(CAST(l_quantity AS INTEGER) * 3.28084::DOUBLE, 2) AS s1_hs, CAST(l_linenumber AS DOUBLE) AS s1_tp, CAST((l_suppkey % 360 + 180) % 360 AS INTEGER) AS s1_dir,
  round((CAST(l_quantity AS INTEGER) + 1) * 3.28084::DOUBLE, 2) AS s2_hs, CAST(l_linenumber + 1 AS DOUBLE) AS s2_tp, CAST((l_partkey % 360 + 180) % 360 AS INTEGER) AS s2_dir,
  CAST(NULL AS DOUBLE) AS s3_hs, round((l_partkey % 100) * 3.28084::DOUBLE, 2) AS combined_hs
FROM lineitem""")
def bulletin_roundtrip_b(spark, sf_dir):
    """Layout B from text: F10, F11, C3, O4, S22."""
    done = bulletin.parsed(compose.bulletins_b(spark, sf_dir))
    return present.wide(bulletin.forecast(done)).select("station_id", "ts_utc", "s1_hs", "s1_tp", "s1_dir", "s2_hs", "s2_tp", "s2_dir", "s3_hs", "combined_hs")


@query(f"SELECT user_id, h AS hour_utc, {', '.join(f'max(CASE WHEN rn = {i} THEN value END) AS v{i}' for i in range(1, 7))} FROM ({_HOURS}) GROUP BY user_id, h")
def swell_wide(spark, sf_dir):
    """The first six values of every user and hour as columns."""
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour_utc")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    return hours.select("user_id", "hour_utc", *[F.get("e.value", F.lit(i)).alias(f"v{i + 1}") for i in range(6)])


@query("""
SELECT l_orderkey, {}, CAST(least(count(*), 6) AS INTEGER) AS filled
FROM lineitem GROUP BY l_orderkey""".format(", ".join(f"max(CASE WHEN rn = {i} THEN l_partkey END) AS p{i}" for i in range(1, 7))).replace("FROM lineitem", "FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem)"))
def swell_slots(spark, sf_dir):
    """Padded and cut to six slots."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    slots = F.slice("r.l_partkey", 1, 6)
    return orders.select("l_orderkey", *[F.get(slots, F.lit(i)).alias(f"p{i + 1}") for i in range(6)], F.size(slots).alias("filled"))


@query("SELECT c_name AS id, c_mktsegment AS name, CAST(c_custkey % 90 AS DOUBLE) AS lat, -CAST(c_custkey % 180 AS DOUBLE) AS lon FROM customer")
def pipe_parse(spark, sf_dir):
    """SRC3, S2, S4, S20, F1-F4: station lines composed from customers, with comments and short rows between."""
    c, text = table(spark, sf_dir, "customer"), lambda x: x.cast("string")
    at = F.concat(text(F.col("c_custkey") % 90), F.lit(" N "), text(F.col("c_custkey") % 180), F.lit(" w (x)"))
    line = F.concat_ws("|", F.concat(F.lit("  "), F.col("c_name")), F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")), F.lit("d"), at)
    rows = c.select(F.col("c_custkey").alias("pos"), F.explode(F.array(line, F.concat(F.lit("# "), line), F.lit("a|b|c"), F.lit(" "))).alias("line"))
    return station_source.parse_station_lines(rows)


@query(r"""
SELECT doc_id, CAST(count(*) FILTER (WHERE trim(l, ' ') <> '' AND NOT starts_with(l, 'T')) AS BIGINT) AS kept
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def comment_filter(spark, sf_dir):
    """Lines that are neither blank nor start with a mark."""
    kept = F.filter(t.lines(F.col("text")), lambda l: (F.trim(l) != "") & ~F.startswith(l, F.lit("T")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("bigint").alias("kept"))


@query(r"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS numbers, coalesce(round(sum(CAST(x AS DECIMAL(38, 4))), 2), 0)::DOUBLE AS total
FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS x FROM documents)
WHERE regexp_matches(x, '^[+-]?[0-9]{1,9}(\.[0-9]{1,4})?$') GROUP BY doc_id""")
def numeric_tokens(spark, sf_dir):
    """Number tokens of every document."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokens(F.col("text"))).alias("x")).where(F.col("x").rlike(r"^[+-]?[0-9]{1,9}(\.[0-9]{1,4})?$"))
    return x.where(t.to_number(F.col("x")).isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"), F.round(F.sum(F.col("x").cast("decimal(38,4)")), 2).cast("double").alias("total"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * round(s_acctbal, 2) AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE -1 END * CAST(s_suppkey AS DOUBLE) AS lon FROM supplier")
def latlon_regex(spark, sf_dir):
    """Positions from location lines."""
    s = table(spark, sf_dir, "supplier")
    line = F.concat(F.lit("Location : x ("), F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "N").otherwise("S"), F.lit("  "), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " E").otherwise(" W"), F.lit(")"))
    at = m.position(line)
    return s.select("s_suppkey", at.lat.alias("lat"), at.lon.alias("lon"))


@query("SELECT o_orderkey, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS cycle_ts FROM orders")
def cycle_parse(spark, sf_dir):
    """Cycle times from cycle lines; hour 24 falls back."""
    o = table(spark, sf_dir, "orders")
    day, hour = F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    text = F.concat(F.lit("Cycle : "), day, F.lit(" "), F.when(F.col("o_orderkey") % 5 == 0, "24").otherwise(hour))
    bulletins = o.select("o_orderkey", text.alias("value"), day.alias("run_date"), hour.alias("run_hour"))
    return bulletin.with_header(bulletins).select("o_orderkey", "cycle_ts")


@query("SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def hrefs(spark, sf_dir):
    """SRC6, A2."""
    return source.hrefs(table(spark, sf_dir, "pages"))


@query("SELECT DISTINCT CAST(page_id % 100 AS VARCHAR) AS id FROM pages WHERE page_id % 3 <> 0")
def listed_stations(spark, sf_dir):
    """SRC6, F6, A2: bulletin links put into pages, among links that are none."""
    p = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "spec").otherwise("bull")
    link = F.concat(F.lit('<a href="gfswave.'), (F.col("page_id") % 100).cast("string"), F.lit("."), kind, F.lit('">'))
    return source.listed_stations(p.select(F.concat("html", link).alias("html")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    """C7."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("SELECT s_name AS id, CAST(s_suppkey AS DOUBLE) AS lat, -CAST(s_suppkey AS DOUBLE) / 2 AS lon FROM supplier WHERE s_suppkey % 4 <> 0")
def coordinate_json(spark, sf_dir):
    """SRC4, C7, S8: an object of objects a supplier; numbers as text, bad entries skipped."""
    lat = F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise(F.col("s_suppkey").cast("string"))
    text = F.concat(F.lit('{"'), F.col("s_name"), F.lit('": {"lat": "'), lat, F.lit('", "lon": '), (-F.col("s_suppkey") / 2).cast("string"), F.lit("}}"))
    return station_source.parse_coordinates(table(spark, sf_dir, "supplier").select(text.alias("value")))


@query("SELECT c_custkey AS pos, CAST(c_nationkey AS VARCHAR) AS id, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def catalogue_names(spark, sf_dir):
    """Names by left join, ids where there is none."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("string").alias("id"))
    meta = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return stations_of.named(ids, meta).select("pos", "id", "name")


@query("""
SELECT s_suppkey AS pos, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE c END AS lat, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE d END AS lon
FROM supplier
LEFT JOIN (SELECT n_nationkey AS k1, CAST(n_nationkey AS DOUBLE) AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 2.0::DOUBLE END AS b FROM nation WHERE n_nationkey < 15) ON s_nationkey = k1
LEFT JOIN (SELECT n_nationkey AS k2, -CAST(n_nationkey AS DOUBLE) AS c, -n_nationkey * 2.0::DOUBLE AS d FROM nation WHERE n_nationkey > 4) ON s_nationkey = k2
WHERE CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE c END IS NOT NULL""")
def catalogue_coords(spark, sf_dir):
    """Positions by priority, as pairs."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("string").alias("id"))
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    coords = n.where(key < 15).select(key.cast("string").alias("id"), key.cast("double").alias("lat"), F.when(key % 2 == 0, key * 2.0).alias("lon"))
    defaults = n.where(key > 4).select(key.cast("string").alias("id"), (-key.cast("double")).alias("lat"), (-key * 2.0).alias("lon"))
    return stations_of.located(ids, coords, defaults).select("pos", "lat", "lon")


@query("SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_last(spark, sf_dir):
    """A3: the last row of each key."""
    return station_source.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type"), "user_id", "event_id")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def fallback_union(spark, sf_dir):
    """An empty first table gives all of the second, a full one none of it."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return stations_of.fallback_union(stations_of.fallback_union(n.where("k < 0"), n), r)


@query("SELECT min(a) - 0.2 * (max(a) - min(a)) AS south, min(b) - 0.2 * (max(b) - min(b)) AS west, max(a) + 0.2 * (max(a) - min(a)) AS north, max(b) + 0.2 * (max(b) - min(b)) AS east FROM (SELECT CAST(c_custkey AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)")
def bbox_pad(spark, sf_dir):
    """A5, F15."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), F.col("c_custkey").cast("double").alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    return stations_of.bounding_box(stations_of.markers(rows))


@query("""
SELECT c_custkey, CASE WHEN lat BETWEEN 18.5 AND 22.6 AND lon BETWEEN -160.6 AND -154.4 THEN 'Pacific/Honolulu'
  WHEN round(lon / 15) = 0 THEN 'Etc/GMT' ELSE 'Etc/GMT' || CASE WHEN lon > 0 THEN '-' ELSE '+' END || CAST(CAST(abs(round(lon / 15)) AS INTEGER) AS VARCHAR) END AS zone
FROM (SELECT c_custkey, CAST(c_custkey % 30 AS DOUBLE) - 7 AS lat, CAST(c_custkey % 31 AS DOUBLE) - 175 AS lon FROM customer)""")
def zone_of_position(spark, sf_dir):
    """Positions around Hawaii, by box or nautical zone (none of the other boxes reaches there)."""
    lat, lon = (F.col("c_custkey") % 30).cast("double") - 7, (F.col("c_custkey") % 31).cast("double") - 175
    return table(spark, sf_dir, "customer").select("c_custkey", position_zone(lat, lon).zone.alias("zone"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Pacific/Honolulu' WHEN 1 THEN 'Asia/Taipei' END AS zone FROM customer")
def asked_zone(spark, sf_dir):
    """Names in any case, an alias; offsets and unknown names are ignored."""
    names = F.array(*map(F.lit, ("pacific/HONOLULU", "ROC", "+05:00", "Not/AZone")))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 4).cast("int")).alias("asked"))
    return with_asked_zone(asked, "asked", "zone").select("c_custkey", "zone")


@query("SELECT name AS value, name AS label, name = 'Pacific/Honolulu' AS selected FROM (SELECT unnest([{}]) AS name)".format(", ".join(f"'{n}'" for n in common_zones())))
def zone_options(spark, sf_dir):
    """SRC8, O1, SNK6."""
    return offered_zones(spark, "Pacific/Honolulu")


@query("""
SELECT user_id, string_agg('<td>' || CAST(event_id AS VARCHAR) || ':' || replace(event_type, '_', '&amp;') || '</td>', '' ORDER BY event_id) AS html
FROM events GROUP BY user_id""")
def html_rows(spark, sf_dir):
    """SNK1, A4: escaped cells in order."""
    cell = F.concat(F.lit("<td>"), F.col("event_id").cast("string"), F.lit(":"), t.escaped(F.replace("event_type", F.lit("_"), F.lit("&"))), F.lit("</td>"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", cell.alias("html")))).alias("r"))
    return rows.select("user_id", F.array_join("r.html", "").alias("html"))


def _html_sql() -> str:
    full = lambda text: f"""<tr><td colspan="21"><strong>{text}</strong></td></tr>\n"""
    groups = "".join(f'<th colspan="3" style="background-color:#{g[0]}; color:white; text-align:center;">Swell {i}</th>' for i, g in enumerate(GROUPS, 1))
    subs = "".join(f'<th style="background-color:#{c}; text-align:center;">{label}</th>' for c, label in [(g[1], x) for g in GROUPS for x in ("Hs<br>(ft)", "Tp<br>(s)", "Dir<br>(d)")] + [(COMBINED[1], "Hs<br>(ft)")])
    combined = f'<th style="background-color:#{COMBINED[0]}; color:white; text-align:center;">Combined</th>'
    head = '<table class="table table-bordered table-sm">\n' + full("Cycle : @ 00 UTC") + full("Location : #  (21.67N 158.12W)") + full("Time Zone: Pacific/Honolulu")
    head += f'<tr><th rowspan="2">Date</th><th rowspan="2">Time</th>{groups}{combined}</tr>\n<tr>{subs}</tr>\n'
    cell = lambda colour, text: f"""'<td style="background-color:#{colour}; text-align:right; font-weight:' || weight || '; ' || border || ' padding:4px 8px;">' || coalesce({text}, '') || '</td>'"""
    cells = [cell(g[2], x.format(i)) for i, g in enumerate(GROUPS, 1) for x in ("printf('%.2f', s{}_hs)", "printf('%.1f', s{}_tp)", "CAST(s{}_dir AS VARCHAR)")] + [cell(COMBINED[2], "printf('%.2f', combined_hs)")]
    dates = """'<tr><td style="font-weight:bold; ' || border || ' padding:4px 8px;">' || date_local || '</td><td style="font-weight:' || weight || '; ' || border || ' padding:4px 8px;">' || time_local || '</td>'"""
    return f"""
SELECT station_id, replace(replace('{head}', '@', run_date), ' #  (', ' ' || station_id || '  (') || string_agg({dates} || {" || ".join(cells)} || '</tr>\n', '' ORDER BY pos) || '</table>' AS html
FROM (SELECT *, CASE WHEN x BETWEEN 360 AND 1140 THEN 'bold' ELSE 'normal' END AS weight,
    CASE WHEN x BETWEEN 360 AND 1140 THEN 'border:1px solid #000;' WHEN x >= 1200 OR x <= 300 THEN 'border:1px dashed #999;' ELSE '' END AS border
  FROM (SELECT *, hour(local) * 60 + minute(local) AS x FROM ({_VIEW})))
GROUP BY station_id, run_date"""


@query(_html_sql())
def html_table(spark, sf_dir):
    """SNK1, S19, S26, C8: whole tables from composed bulletins, to the last character."""
    return html.table_html(bulletin.parsed(compose.bulletins_a(spark, sf_dir))).select("station_id", "html")


@query("SELECT to_json(list({'id': s_name, 'name': s_name, 'lat': CAST(s_suppkey AS INTEGER), 'lon': s_nationkey} ORDER BY s_suppkey)) AS json FROM supplier")
def stations_json(spark, sf_dir):
    """SNK3."""
    return json_sink.station_array(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("lat"), F.col("s_nationkey").alias("lon")))


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) + to_microseconds(CAST(round(l_quantity / 4 * 3600000000) AS BIGINT)) AS later FROM lineitem")
def hour_offset(spark, sf_dir):
    """Fractional hours."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m.hours_later(F.col("l_shipdate"), F.col("l_quantity") / 4).alias("later"))


_TEXTS = ["date_local", "time_local", *[f"coalesce(CAST({x} AS VARCHAR), '')" for i in range(1, 7) for x in (f"s{i}_hs / 3.28084::DOUBLE", f"s{i}_tp", f"s{i}_dir")], "coalesce(CAST(combined_hs / 3.28084::DOUBLE AS VARCHAR), '')"]


@query(f"SELECT station_id, pos AS row, CAST(unnest(range(21)) AS INTEGER) AS col, unnest([{', '.join(_TEXTS)}]) AS value FROM ({_VIEW})")
def xlsx_grid(spark, sf_dir):
    """SNK2: the cells of every composed bulletin's workbook."""
    return xlsx.grid(bulletin.forecast(bulletin.parsed(compose.bulletins_a(spark, sf_dir))), "Metric")


@query(f"SELECT * EXCLUDE (local) FROM ({_VIEW})")
def table_view(spark, sf_dir):
    """The flagship on this table size."""
    return flagship(spark, sf_dir)


@query("SELECT s_suppkey, url_encode(s_name || ' & ' || CAST(s_suppkey AS VARCHAR)) AS query_text FROM supplier")
def url_parameters(spark, sf_dir):
    """Text for a query string, blanks as %20."""
    text = F.concat("s_name", F.lit(" & "), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", m.url_parameter(text).alias("query_text"))


@query("SELECT s_name AS value, s_name || ' - ' || CAST(s_nationkey AS VARCHAR) AS label, s_suppkey = 7 AS selected FROM supplier")
def station_options(spark, sf_dir):
    """SNK6: a choice of stations, labels led by the id, one selected."""
    s = table(spark, sf_dir, "supplier")
    chosen = s.where("s_suppkey = 7").select("s_name").first()
    rows = s.select(F.col("s_name").alias("id"), F.col("s_nationkey").cast("string").alias("name"))
    return stations_of.station_options(rows, chosen.s_name if chosen else "", prefix=True)


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'bulletin file is empty' WHEN 1 THEN 'data section not found' WHEN 2 THEN 'no data rows' END AS error,
  CAST(CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS INTEGER) AS parsed FROM orders""")
def bulletin_errors(spark, sf_dir):
    """Every error value, from bulletins that lack something."""
    texts = F.array(F.lit(""), F.lit("a\nb"), F.lit("| day & |\n| 30 24 | 1.0 |"), F.lit("| day & |\n| 30 18 | 1.0 |"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % 4).cast("int")).alias("value"), F.lit("20250130").alias("run_date"), F.lit("18").alias("run_hour"))
    return bulletin.parsed(o).select("o_orderkey", "error", F.coalesce(F.size("rows"), F.lit(0)).alias("parsed"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS station_id, CAST(21.67 AS DOUBLE) AS lat, CAST(-158.12 AS DOUBLE) AS lon, '2024-01-01 00:00:00' AS cycle, 'Pacific/Honolulu' AS tz FROM events")
def bulletin_headers(spark, sf_dir):
    """Section 1.4's header: cycle, position and zone of composed bulletins."""
    head = bulletin.with_header(compose.bulletins_a(spark, sf_dir))
    return head.select("station_id", "lat", "lon", F.date_format("cycle_ts", "yyyy-MM-dd HH:mm:ss").alias("cycle"), "tz")


@query("SELECT x.pos AS pos, x.id AS id FROM (SELECT unnest([{'pos': 0, 'id': s_name}, {'pos': 1, 'id': CAST(s_nationkey AS VARCHAR)}, {'pos': 3, 'id': s_name}, {'pos': 4, 'id': '7'}]) AS x FROM supplier)")
def id_list(spark, sf_dir):
    """SRC5, C7: arrays of ids, a supplier each: blanks around, blanks alone, duplicates and numbers."""
    name, nation = F.col("s_name"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit('["'), name, F.lit('", " '), nation, F.lit(' ", "", "'), name, F.lit('", 7]'))
    return station_source.parse_id_list(table(spark, sf_dir, "supplier").select(text.alias("value")))


@query("SELECT unnest({ids}) AS id, unnest({names}) AS name, CAST(unnest({lats}) AS DOUBLE) AS lat, CAST(unnest({lons}) AS DOUBLE) AS lon".format(**{k: list(c) for k, c in zip(("ids", "names", "lats", "lons"), zip(*station_source.FALLBACK))}))
def fallback_stations(spark, sf_dir):
    """SRC7."""
    return station_source.fallback(spark)


@query("""
SELECT s_suppkey, station, CASE WHEN station = 'known' THEN 1.5 ELSE -CAST(s_suppkey % 90 AS DOUBLE) - 0.25 END AS lat,
  CASE WHEN station = 'known' THEN -2.5 ELSE CAST(s_suppkey AS DOUBLE) END AS lon
FROM supplier, (SELECT unnest(['known', 'other']) AS station)""")
def map_positions(spark, sf_dir):
    """A catalogue position goes before that of the location line, as the map reads it."""
    known = spark.createDataFrame([("known", 1.5, -2.5)], "id string, lat double, lon double")
    line = F.concat(F.lit("Location : x ("), (F.col("s_suppkey") % 90).cast("string"), F.lit(".25S "), F.col("s_suppkey").cast("string"), F.lit(".00E)"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))
    found = [rows.select("s_suppkey", F.lit(x).alias("station"), stations_of.selected_position(known, x, F.col("line")).alias("at")) for x in ("known", "other")]
    return found[0].unionByName(found[1]).select("s_suppkey", "station", "at.lat", "at.lon")


@query("SELECT n AS number, CASE WHEN n <= 26 THEN chr(64 + n) ELSE chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) END AS letters FROM (SELECT CAST(unnest(range(1, 703)) AS INTEGER) AS n)")
def column_letters(spark, sf_dir):
    """Names of workbook columns."""
    return spark.createDataFrame([(n, xlsx.letter(n)) for n in range(1, 703)], "number int, letters string")
