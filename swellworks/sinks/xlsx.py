"""SNK2: the table view as a workbook, written with the standard library from one station's rows."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, functions as F

from swellworks.functions.measures import FEET, US
from swellworks.operators.bulletin import SLOTS
from swellworks.operators.present import with_band
from swellworks.sinks.palette import COLUMNS, COMBINED, GROUPS

SHEET = "Table View"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
WIDTHS = {1: 30, 2: 15}  # of columns; any other is 10


def letter(column: int) -> str:
    """A, B, .., Z, AA of a 1-based column."""
    out = ""
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


class _Styles:
    """Cell formats, each once, in order of first use."""

    def __init__(self):
        self.fonts, self.fills, self.borders, self.formats = [(False, None)], [None, "gray125"], [None], [(0, 0, 0, 0, None)]

    @staticmethod
    def _index(known: list, value: object) -> int:
        if value not in known:
            known.append(value)
        return known.index(value)

    def get(self, bold: bool = False, colour: str | None = None, fill: str | None = None, border: str | None = None, number: int = 0, align: str | None = None) -> int:
        key = (self._index(self.fonts, (bold, colour)), self._index(self.fills, fill), self._index(self.borders, border), number, align)
        return self._index(self.formats, key)

    def xml(self) -> str:
        fonts = "".join(f"<font>{'<b/>' * b}<sz val=\"11\"/>{f'<color rgb="FF{c}"/>' if c else ''}<name val=\"Calibri\"/></font>" for b, c in self.fonts)
        fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{f}"/></patternFill></fill>' if f and f != "gray125" else f'<fill><patternFill patternType="{f or "none"}"/></fill>' for f in self.fills)
        side = lambda b: "".join(f'<{s} style="{b}"><color rgb="FF000000"/></{s}>' if b else f"<{s}/>" for s in ("left", "right", "top", "bottom"))
        borders = "".join(f"<border>{side(b)}<diagonal/></border>" for b in self.borders)
        xfs = "".join(f'<xf numFmtId="{n}" fontId="{a}" fillId="{b}" borderId="{c}" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1"' + (f' applyAlignment="1"><alignment horizontal="{h}"/></xf>' if h else "/>") for a, b, c, n, h in self.formats)
        return (
            f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0"/></numFmts>'
            f'<fonts count="{len(self.fonts)}">{fonts}</fonts><fills count="{len(self.fills)}">{fills}</fills><borders count="{len(self.borders)}">{borders}</borders>'
            f'<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="{len(self.formats)}">{xfs}</cellXfs></styleSheet>'
        )


TWO, ONE = 2, 164  # number formats 0.00 and 0.0


def grid(rows: DataFrame, unit: str = "US") -> DataFrame:
    """The data cells (station_id, row, col, value) that a workbook holds: metric heights unrounded, nulls as ''."""
    divide = 1.0 if unit == US else FEET
    local = F.from_utc_timestamp("ts_utc", F.col("tz"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cells = [F.date_format(local, "EEEE, MMMM d, yyyy"), F.date_format(local, "h:mm a")]
    for i in range(SLOTS):
        s = F.get("swells", F.lit(i))
        cells += [text(s.hs_ft / divide), text(s.tp_s), text(s.dir_deg)]
    cells.append(text(F.col("combined_ft") / divide))
    return rows.select("station_id", F.col("pos").alias("row"), F.posexplode(F.array(*cells)).alias("col", "value"))


def write_workbook(path: str, cycle: str, location: str, tz: str, rows: Iterable, unit: str = "US") -> None:
    """Rows are structs of ts_utc's labels (date_local, time_local), band, swells and combined_ft, in order."""
    styles, out, merges = _Styles(), [], []

    def cell(r: int, c: int, value: object, style: int) -> str:
        at = f'{letter(c)}{r}'
        if value is None or isinstance(value, str):
            return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(value or "")}</t></is></c>'
        return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>'

    for r, text in enumerate((cycle, location, f"Time Zone: {tz}"), 1):
        out.append(f'<row r="{r}">{cell(r, 1, text, styles.get(bold=True))}</row>')
        merges.append(f"A{r}:{letter(COLUMNS)}{r}")
    label = "(ft)" if unit == US else "(m)"
    bold, head, sub = styles.get(bold=True, align="center"), [], []
    for i, (h, s, _) in enumerate(GROUPS):
        c = 3 + 3 * i
        head.append(cell(4, c, f"Swell {i + 1}", styles.get(bold=True, colour="FFFFFF", fill=h, align="center")))
        merges.append(f"{letter(c)}4:{letter(c + 2)}4")
        sub += [cell(5, c + k, t, styles.get(bold=True, fill=s, align="center")) for k, t in enumerate((f"Hs\n{label}", "Tp\n(s)", "Dir\n(d)"))]
    head.append(cell(4, COLUMNS, "Combined", styles.get(bold=True, colour="FFFFFF", fill=COMBINED[0], align="center")))
    sub.append(cell(5, COLUMNS, f"Hs\n{label}", styles.get(bold=True, fill=COMBINED[1], align="center")))
    out += [f'<row r="4">{cell(4, 1, "Date", bold)}{cell(4, 2, "Time", bold)}{"".join(head)}</row>', f'<row r="5">{"".join(sub)}</row>']
    show = (lambda v: v) if unit == US else (lambda v: None if v is None else v / FEET)
    for r, row in enumerate(rows, 6):
        border, day = {"day": "thin", "night": "dashed"}.get(row.band), row.band == "day"
        line = [cell(r, 1, row.date_local, styles.get(bold=True, border=border)), cell(r, 2, row.time_local, styles.get(bold=day, border=border))]
        for i, (_, _, fill) in enumerate(GROUPS):
            s = row.swells[i] if i < len(row.swells) else None
            values = (None, None, None) if s is None else (show(s.hs_ft), s.tp_s, s.dir_deg)
            line += [cell(r, 3 + 3 * i + k, v, styles.get(bold=day, fill=fill, border=border, number=n, align="right")) for k, (v, n) in enumerate(zip(values, (TWO, ONE, 0)))]
        line.append(cell(r, COLUMNS, show(row.combined_ft), styles.get(bold=day, fill=COMBINED[2], border=border, number=TWO, align="right")))
        out.append(f'<row r="{r}">{"".join(line)}</row>')
    widths = "".join(f'<col min="{c}" max="{c}" width="{WIDTHS.get(c, 10)}" customWidth="1"/>' for c in range(1, COLUMNS + 1))
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><cols>{widths}</cols><sheetData>{"".join(out)}</sheetData><mergeCells count="{len(merges)}">{"".join(f"<mergeCell ref=\"{m}\"/>" for m in merges)}</mergeCells></worksheet>'
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/styles.xml": styles.xml(),
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)


def export(forecast: DataFrame, path: str, unit: str = "US") -> str:
    """Write one station's forecast (long form, one run); rows come in order, a partition at a time.  ValueError without rows."""
    local = F.from_utc_timestamp("ts_utc", F.col("tz"))
    rows = with_band(forecast).select("pos", "cycle_str", "location_str", "tz", F.date_format(local, "EEEE, MMMM d, yyyy").alias("date_local"), F.date_format(local, "h:mm a").alias("time_local"), "band", "swells", "combined_ft").orderBy("pos").toLocalIterator()
    first = next(rows, None)
    if first is None:
        raise ValueError("no data rows")
    write_workbook(path, first.cycle_str, first.location_str, first.tz, (r for part in ([first], rows) for r in part), unit)
    return path
