"""SNK1: the table view as HTML, built inside the bulletin's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from swellworks.functions.measures import date_label, shown_height, time_band, time_label, unit_label
from swellworks.functions.text import escaped, let
from swellworks.sinks.palette import COLUMNS, COMBINED, GROUPS

#: The markup in this module is fixed: what it must look like, built from columns.
BORDERS = {"day": "border:1px solid #000;", "night": "border:1px dashed #999;"}


def _shown(number: Column, form: str) -> Column:
    """The number in a printf form, blank for null (which printf would show as letters)."""
    return F.when(number.isNotNull(), F.format_string(form, number)).otherwise("")


def _head(cycle: Column, location: Column, tz: Column, unit: Column) -> Column:
    full = lambda c: F.concat(F.lit(f'<tr><td colspan="{COLUMNS}"><strong>'), c, F.lit("</strong></td></tr>\n"))
    groups = "".join(f'<th colspan="3" style="background-color:#{h}; color:white; text-align:center;">Swell {i}</th>' for i, (h, _, _) in enumerate(GROUPS, 1))
    over = f'<tr><th rowspan="2">Date</th><th rowspan="2">Time</th>{groups}<th style="background-color:#{COMBINED[0]}; color:white; text-align:center;">Combined</th></tr>\n<tr>'

    def sub(colour: str, label: Column) -> list[Column]:
        return [F.lit(f'<th style="background-color:#{colour}; text-align:center;">'), label, F.lit("</th>")]

    hs = F.concat(F.lit("Hs<br>"), unit_label(unit))
    cells = [c for _, s, _ in GROUPS for label in (hs, F.lit("Tp<br>(s)"), F.lit("Dir<br>(d)")) for c in sub(s, label)]
    return F.concat(full(escaped(cycle)), full(escaped(location)), full(F.concat(F.lit("Time Zone: "), escaped(tz))), F.lit(over), *cells, *sub(COMBINED[1], hs), F.lit("</tr>\n"))


def row_html(row: Column, tz: Column, unit: Column) -> Column:
    """One data row from a struct of ts_utc, swells and combined_ft."""

    def made(local: Column) -> Column:
        band = time_band(local)
        border = F.coalesce(*[F.when(band == k, v) for k, v in BORDERS.items()], F.lit(""))
        weight = F.when(band == "day", "bold").otherwise("normal")
        pad = "padding:4px 8px;"

        def cell(colour: str, text: Column) -> list[Column]:
            return [F.lit(f'<td style="background-color:#{colour}; text-align:right; font-weight:'), weight, F.lit("; "), border, F.lit(f' {pad}">'), text, F.lit("</td>")]

        out = [F.lit('<tr><td style="font-weight:bold; '), border, F.lit(f' {pad}">'), date_label(local), F.lit('</td><td style="font-weight:'), weight, F.lit("; "), border, F.lit(f' {pad}">'), time_label(local), F.lit("</td>")]
        for i, (_, _, colour) in enumerate(GROUPS):
            s = F.get(row.swells, F.lit(i))
            out += cell(colour, _shown(shown_height(s.hs_ft, unit), "%.2f"))
            out += cell(colour, _shown(s.tp_s, "%.1f"))
            out += cell(colour, F.coalesce(s.dir_deg.cast("string"), F.lit("")))
        return F.concat(*out, *cell(COMBINED[2], _shown(shown_height(row.combined_ft, unit), "%.2f")), F.lit("</tr>\n"))

    return let(F.from_utc_timestamp(row.ts_utc, tz), made)


def table_html(parsed: DataFrame, unit: str = "US") -> DataFrame:
    """(run_date, run_hour, station_id, html, error): no shuffle; header text is escaped; rows keep their order."""
    u, tz = F.lit(unit), F.col("tz")
    body = F.array_join(F.transform("rows", lambda r: row_html(r, tz, u)), "")
    html = F.concat(F.lit('<table class="table table-bordered table-sm">\n'), _head(F.coalesce("cycle_str", F.lit("")), F.col("location_str"), tz, u), body, F.lit("</table>"))
    return parsed.select("run_date", "run_hour", "station_id", F.when(F.col("error").isNull(), html).alias("html"), "error")
