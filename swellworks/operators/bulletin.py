"""Bulletins to typed forecasts: header, layout dispatch, both layouts.

One bulletin is one row from scan to result: lines are an array and all steps are higher-order functions on it, so the
plan has no exchange and every executor parses the files it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from swellworks.functions.measures import LENIENT_POSITION, feet, hours_later, model_run_label, position, reversed_direction, run_timestamp
from swellworks.functions.text import first_line, let, lines, matched, strip, to_integer, to_number, tokens, truncated, unstarred
from swellworks.functions.zones import position_zone
from swellworks.operators.timeline import timeline

SLOTS = 6
EMPTY, NO_SECTION, NO_ROWS = "bulletin file is empty", "data section not found", "no data rows"
SWELL = "struct<hs_ft:double,tp_s:double,dir_deg:int>"
ROWS = f"array<struct<pos:int,ts_utc:timestamp,swells:array<{SWELL}>,combined_ft:double>>"


def with_header(bulletins: DataFrame, zone: Column | None = None) -> DataFrame:
    """Adds lines, cycle_str, location_str, cycle_ts, lat, lon, tz, zone_source, model_run_str and layout.

    ``zone`` is a valid zone that overrides the position's; null leaves that.  The cycle falls back to the run key.
    """
    rows = F.col("lines")
    out = bulletins.withColumn("lines", F.coalesce(lines(F.col("value")), F.array().cast("array<string>")))
    out = out.withColumns({
        "cycle_str": strip(F.coalesce(first_line(rows, "cycle"), F.get(rows, F.lit(0)))),
        "location_str": strip(F.coalesce(first_line(rows, "location"), F.get(rows, F.lit(1)), F.lit(""))),
        "layout": F.when(F.exists(F.slice(rows, 1, 10), lambda l: F.contains(F.lower(l), F.lit("day &"))), "A").otherwise("B"),
    })
    cycle = r"(\d{8})\s*(\d{2})"  # fixed value
    out = out.withColumns({
        "cycle_ts": F.coalesce(run_timestamp(matched(F.col("cycle_str"), cycle, 1), matched(F.col("cycle_str"), cycle, 2)), run_timestamp(F.col("run_date"), F.col("run_hour"))),
        "_at": position(F.col("location_str")),
    })
    out = out.withColumn("_zone", position_zone(F.col("_at.lat"), F.col("_at.lon")))
    asked = F.lit(None).cast("string") if zone is None else zone
    out = out.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon"), "tz": F.coalesce(asked, F.col("_zone.zone")), "zone_source": F.when(asked.isNotNull(), "request").otherwise(F.col("_zone.source"))})
    return out.withColumn("model_run_str", model_run_label(F.from_utc_timestamp("cycle_ts", F.col("tz")))).drop("_at", "_zone")


def map_position(location: Column) -> Column:
    """J5's second source: the position as the map reads it."""
    return position(location, LENIENT_POSITION)


def _swell(t: Column, at: int | Column = 0) -> Column:
    """A group from three number columns of an array: null unless all three hold."""
    k = F.lit(at) if isinstance(at, int) else at
    hs, tp, d = F.get(t, k), F.get(t, k + 1), truncated(F.get(t, k + 2))
    group = F.struct(F.round(feet(hs), 2).alias("hs_ft"), F.round(tp, 1).alias("tp_s"), reversed_direction(d).alias("dir_deg"))
    return F.when(hs.isNotNull() & tp.isNotNull() & d.isNotNull(), group).cast(SWELL)


def _cell_swell(cell: Column) -> Column:
    words = F.filter(F.transform(tokens(cell), unstarred), lambda t: t != "")
    return let(F.transform(words, to_number), _swell)


def rows_a(rows: Column, start: Column) -> Column:
    """Layout A: piped rows with day and hour, combined height and up to six groups.

    Empty cells go before cells are counted, so a blank group lets later ones move up.  Rows without a day, hour or
    second cell, and rows whose time fits nowhere, are left out.
    """

    def row(line: Column, pos: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != "")

        def typed(p: Column) -> Column:
            dh = tokens(F.get(p, F.lit(0)))
            return F.struct(
                pos.alias("pos"),
                F.size(p).alias("cells"),
                to_integer(F.get(dh, F.lit(0))).alias("d"),
                to_integer(F.get(dh, F.lit(1))).alias("h"),
                F.round(feet(to_number(unstarred(F.get(tokens(F.get(p, F.lit(1))), F.lit(0))))), 2).alias("combined_ft"),
                F.transform(F.sequence(F.lit(2), F.lit(SLOTS + 1)), lambda i: _cell_swell(F.get(p, i))).alias("swells"),
            )

        return let(cells, typed)

    marked = F.filter(
        F.transform(rows, lambda l, i: F.struct(i.alias("pos"), l.alias("l"))),
        lambda x: F.startswith(strip(x.l), F.lit("|")) & ~F.contains(x.l, F.lit("Hst")) & ~F.contains(x.l, F.lit("---")),
    )
    typed = F.filter(F.transform(marked, lambda x: row(x.l, x.pos)), lambda r: r.d.isNotNull() & r.h.isNotNull() & (r.cells >= 2))
    timed = let(typed, lambda r: F.zip_with(r, timeline(start, r), lambda x, ts: F.struct(x.pos.alias("pos"), ts.alias("ts_utc"), x.swells.alias("swells"), x.combined_ft.alias("combined_ft"))))
    return F.filter(timed, lambda x: x.ts_utc.isNotNull()).cast(ROWS)


def header_line_b(rows: Column) -> Column:
    """0-based number of layout B's first header line, null if there is none."""
    return F.nullif(F.array_position(F.transform(rows, lambda l: F.startswith(strip(l), F.lit("Hr"))), True), F.lit(0)).cast("int") - 1


def rows_b(rows: Column, start: Column) -> Column:
    """Layout B: an hour offset and at least twenty tokens a row.

    Groups are the numbers from the seventh token on, three by three; an unfinished group is null.  The combined height
    is the last number of the whole line.
    """

    def row(line: Column, pos: Column) -> Column:
        def typed(t: Column) -> Column:
            clean = F.transform(t, lambda x: to_number(unstarred(x)))
            numbers = F.filter(F.slice(clean, 7, F.greatest(F.size(t) - 6, F.lit(0))), lambda x: x.isNotNull())
            last = F.try_element_at(F.filter(clean, lambda x: x.isNotNull()), F.lit(-1))
            groups = let(numbers, lambda n: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: _swell(n, i * 3)))
            ts = F.when(F.size(t) >= 20, hours_later(start, to_number(F.get(t, F.lit(0)))))
            return F.struct(pos.alias("pos"), ts.alias("ts_utc"), groups.alias("swells"), F.round(feet(last), 2).alias("combined_ft"))

        return let(tokens(line), typed)

    def after(header: Column) -> Column:
        data = F.slice(rows, header + 2, F.greatest(F.size(rows) - header - 1, F.lit(0)))
        return F.transform(data, lambda l, i: row(l, i + header + 1))

    return F.filter(let(header_line_b(rows), after), lambda r: r.ts_utc.isNotNull()).cast(ROWS)


def parsed(bulletins: DataFrame, zone: Column | None = None) -> DataFrame:
    """Header columns, ``rows`` and ``error`` (null, or one of a closed set) of every bulletin; nothing makes it fail.

    One scan and one projection: the condition picks the layout, and only the picked one is evaluated.
    """
    head = with_header(bulletins, zone)
    lines_, start, is_a = F.col("lines"), F.col("cycle_ts"), F.col("layout") == "A"
    out = head.withColumn("rows", F.when(is_a, rows_a(lines_, start)).otherwise(rows_b(lines_, start)))
    section = is_a | header_line_b(lines_).isNotNull()
    error = F.when(F.size("lines") == 0, EMPTY).when(~section, NO_SECTION).when(F.coalesce(F.size("rows"), F.lit(0)) == 0, NO_ROWS)
    return out.withColumn("error", error).drop("value")


def parse_issues(bulletins: DataFrame) -> DataFrame:
    """Candidate data lines and parsed rows of each bulletin, so that what was left out can be counted."""
    done = parsed(bulletins)
    a = F.size(F.filter("lines", lambda l: F.startswith(strip(l), F.lit("|")) & ~F.contains(l, F.lit("Hst")) & ~F.contains(l, F.lit("---"))))
    b = F.coalesce(F.size("lines") - header_line_b(F.col("lines")) - 1, F.lit(0))
    return done.select("run_date", "run_hour", "station_id", "error", F.when(F.col("layout") == "A", a).otherwise(b).alias("candidates"), F.coalesce(F.size("rows"), F.lit(0)).alias("parsed"))


def forecast(done: DataFrame) -> DataFrame:
    """D5, long form: a row for each forecast time with its header's zone."""
    keys = ["run_date", "run_hour", "station_id", "cycle_str", "location_str", "tz"]
    # the outer form: the plain one would make Catalyst filter on the array's size first, by parsing a second time
    return done.select(*keys, F.inline_outer("rows")).where("ts_utc IS NOT NULL")
