"""The parts of .xlsx files, written with the standard library. Rows of reports are written by tasks: see sources/xlsx.py."""

from __future__ import annotations

import os
import re
import shutil
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

_SHEET_BAD, _FILE_BAD = re.compile(r"[\[\]:*?/\\]"), re.compile(r'[<>:"/\\|?*]')
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def sheet_name(raw: str, taken: set[str]) -> str:
    """At most 31 characters, none of those that sheets can't have, and not taken in any case; it is then."""
    base = " ".join(_SHEET_BAD.sub(" ", raw).split())[:31].strip() or "Sheet"
    name, n, used = base, 2, {t.lower() for t in taken}
    while name.lower() in used:
        end = f" ({n})"
        name, n = base[: 31 - len(end)].strip() + end, n + 1
    taken.add(name)
    return name


def file_name(pattern: str, **tokens: str) -> str:
    out = re.sub(r"\{(\w+)\}", lambda m: str(tokens.get(m[1], "")), pattern)
    return " ".join(_FILE_BAD.sub("-", out).split()) or "Cash Bids.xlsx"


def free_path(folder: Path, name: str) -> Path:
    """The name, or with ' (2)', ' (3)' and so on: nothing is overwritten."""
    folder.mkdir(parents=True, exist_ok=True)
    path, n = folder / name, 2
    while path.exists():
        path, n = folder / f"{Path(name).stem} ({n}){Path(name).suffix}", n + 1
    return path


def archive_old(folder: Path, keep: int, month: str) -> list[str]:
    """Workbooks but the newest `keep` go to Archive/<month>. Returns names of those that can't be moved."""
    files = sorted((p for p in folder.glob("*.xlsx") if p.is_file()), key=lambda p: p.stat().st_mtime, reverse=True)
    stuck = []
    for p in files[keep:]:
        (folder / "Archive" / month).mkdir(parents=True, exist_ok=True)
        try:
            shutil.move(str(p), str(folder / "Archive" / month / p.name))
        except OSError:
            stuck.append(p.name)
    return stuck


def number_formats(decimals: dict) -> dict[str, str]:
    z = lambda k: "0." + "0" * decimals.get(k, 4)
    return {
        "cash": f'"$"#,##{z("cash")}', "basis": f"+{z('basis')};-{z('basis')};{z('basis')}", "change": f'+{z("basis")};-{z("basis")};"unch"',
        "futures": f"#,##{z('futures')}", "date": "mm/dd/yyyy",
    }


@dataclass
class Chart:
    """Bars or a line over rows of the hidden chart sheet: `count` values from row `first`, names in one column, values in the next."""

    kind: str
    title: str
    first: int
    count: int
    column: int = 0


CHART_SHEET = "_ChartData"
#: Rows that a chart takes; charts of a sheet stand below each other.
CHART_ROWS = 16


@dataclass
class Sheet:
    name: str
    title: list[str]
    headers: list[str]
    kinds: list[str]
    widths: list[float]
    rows: Iterable[Iterable]
    hidden: bool = False
    data_row: int = 7
    charts: list[Chart] = field(default_factory=list)
    #: Cells and where they lead to.
    links: list[tuple[str, str]] = field(default_factory=list)
    #: Cash prices are shaded by their height.
    best: bool = True
    #: The rows as text of the sheet, up to last_row, instead of `rows`.
    body: Iterable[bytes] | None = None
    last_row: int = 0


_KINDS = ["text", "head", "title", "wrap", "cash", "basis", "change", "futures", "date", "number", "link"]
_NUMBERS = {"cash", "basis", "change", "futures", "number"}


def _cell_name(row: int, col: int) -> str:
    letters, n = "", col + 1
    while n:
        n, r = divmod(n - 1, 26)
        letters = chr(65 + r) + letters
    return f"{letters}{row}"


def _cell(row: int, col: int, value: object, kind: str) -> str:
    at, style = _cell_name(row, col), _KINDS.index(kind)
    if value is None or value == "":
        return f'<c r="{at}" s="{style}"/>'
    if isinstance(value, datetime | date):
        days = (date(value.year, value.month, value.day) - date(1899, 12, 30)).days
        return f'<c r="{at}" s="{style}"><v>{days}</v></c>'
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>'
    text = escape(_CONTROL.sub("", str(value)))
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def row_of_texts(row: int, cells: Iterable[tuple[str, str | None]]) -> str:
    """A row of a sheet from (kind, text) of its cells: texts of numbers and of dates (yyyy-mm-dd) are stored as such;
    null, empty texts and what is no finite number are empty cells."""
    out = []
    for k, (kind, text) in enumerate(cells):
        value: object = text
        if text and kind in _NUMBERS:
            value = float(text) if "." in text or "E" in text or not text.lstrip("-").isdigit() else int(text)
            value = value if value == value and abs(value) != float("inf") else None
        elif text and kind == "date":
            value = date.fromisoformat(text)
        out.append(_cell(row, k, value, kind))
    return f'<row r="{row}">{"".join(out)}</row>'


def cell_at(row: int, col: int) -> str:
    return _cell_name(row, col)


def _sheet_xml(sheet: Sheet) -> Iterable[str | bytes]:
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    top = sheet.data_row - 1
    if top and sheet.headers:
        yield f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{top}" topLeftCell="A{sheet.data_row}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    yield "<cols>" + "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(sheet.widths, 1)) + "</cols><sheetData>"
    for k, line in enumerate(sheet.title, 1):
        yield f'<row r="{k}">{_cell(k, 0, line, "title" if k == 1 else "text")}</row>'
    if top and sheet.headers:
        yield f'<row r="{top}">' + "".join(_cell(top, k, h, "head") for k, h in enumerate(sheet.headers)) + "</row>"
    n = top
    if sheet.body is not None:
        yield from sheet.body
        n = max(n, sheet.last_row)
    for n, row in enumerate(sheet.rows, n + 1):
        yield f'<row r="{n}">' + "".join(_cell(n, k, v, kind) for k, (v, kind) in enumerate(zip(row, sheet.kinds, strict=True))) + "</row>"
    sheet.last_row = n
    yield "</sheetData>"
    if top and sheet.headers:
        yield f'<autoFilter ref="A{top}:{_cell_name(max(n, top), len(sheet.headers) - 1)}"/>'
    for k, kind in enumerate(sheet.kinds):
        if n < sheet.data_row or kind not in ("basis", "change", "cash") or (kind == "cash" and not sheet.best):
            continue
        ref = f"{_cell_name(sheet.data_row, k)}:{_cell_name(n, k)}"
        if kind == "cash":
            rule = '<cfRule type="colorScale" priority="1"><colorScale><cfvo type="min"/><cfvo type="max"/><color rgb="FFFFFFFF"/><color rgb="FF63BE7B"/></colorScale></cfRule>'
        else:
            rule = '<cfRule type="cellIs" dxfId="0" priority="2" operator="greaterThan"><formula>0</formula></cfRule><cfRule type="cellIs" dxfId="1" priority="3" operator="lessThan"><formula>0</formula></cfRule>'
        yield f'<conditionalFormatting sqref="{ref}">{rule}</conditionalFormatting>'
    if sheet.links:
        yield f'<hyperlinks xmlns:r="{_REL}">' + "".join(f'<hyperlink ref="{ref}" r:id="h{ref}"/>' for ref, _ in sheet.links) + "</hyperlinks>"
    yield '<drawing xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="r1"/>' if sheet.charts else ""
    yield "</worksheet>"


_A, _C = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/chart"


def _chart_xml(chart: Chart) -> str:
    def ref(column: int) -> str:
        letter = _cell_name(1, column)[:-1]
        return f"'{CHART_SHEET}'!${letter}${chart.first}:${letter}${chart.first + chart.count - 1}"

    series = f'<c:ser><c:idx val="0"/><c:order val="0"/><c:cat><c:strRef><c:f>{ref(chart.column)}</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>{ref(chart.column + 1)}</c:f></c:numRef></c:val></c:ser>'
    if chart.kind == "bar":
        plot = f'<c:barChart><c:barDir val="col"/><c:grouping val="clustered"/>{series}<c:axId val="1"/><c:axId val="2"/></c:barChart>'
    else:
        plot = f'<c:lineChart><c:grouping val="standard"/>{series}<c:axId val="1"/><c:axId val="2"/></c:lineChart>'
    axis = '<c:scaling><c:orientation val="minMax"/></c:scaling><c:delete val="0"/><c:axPos val="{}"/><c:crossAx val="{}"/>'
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><c:chartSpace xmlns:c="{_C}" xmlns:a="{_A}"><c:chart><c:title><c:tx><c:rich><a:bodyPr/><a:p><a:r><a:t>{escape(chart.title)}</a:t></a:r></a:p></c:rich></c:tx></c:title>'
        f'<c:plotArea>{plot}<c:catAx><c:axId val="1"/>{axis.format("b", 2)}</c:catAx><c:valAx><c:axId val="2"/>{axis.format("l", 1)}</c:valAx></c:plotArea></c:chart></c:chartSpace>'
    )


def _drawing_xml(sheet: Sheet) -> str:
    frames = ""
    for k, _ in enumerate(sheet.charts, 1):
        top = sheet.last_row + 2 + (k - 1) * CHART_ROWS
        at = "<xdr:{0}><xdr:col>{1}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{2}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:{0}>"
        frames += (
            f'<xdr:twoCellAnchor>{at.format("from", 0, top)}{at.format("to", 6, top + CHART_ROWS - 1)}<xdr:graphicFrame macro=""><xdr:nvGraphicFramePr><xdr:cNvPr id="{k + 1}" name="Chart {k}"/><xdr:cNvGraphicFramePr/></xdr:nvGraphicFramePr>'
            f'<xdr:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/></xdr:xfrm><a:graphic><a:graphicData uri="{_C}"><c:chart xmlns:c="{_C}" r:id="r{k}"/></a:graphicData></a:graphic></xdr:graphicFrame><xdr:clientData/></xdr:twoCellAnchor>'
        )
    return (
        '<?xml version="1.0" encoding="UTF-8"?><xdr:wsDr xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" '
        f'xmlns:a="{_A}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{frames}</xdr:wsDr>'
    )


def _rels_xml(targets: list[tuple[str, str]], links: list[tuple[str, str]] | None = None) -> str:
    """Relations r1, r2, ..: kind and target; then one for each linked cell."""
    rels = "".join(f'<Relationship Id="r{k}" Type="{_REL}/{what}" Target="{target}"/>' for k, (what, target) in enumerate(targets, 1))
    rels += "".join(f'<Relationship Id="h{ref}" Type="{_REL}/hyperlink" Target={quoteattr(_CONTROL.sub("", url))} TargetMode="External"/>' for ref, url in links or [])
    return f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'


def _styles_xml(formats: dict[str, str]) -> str:
    ids = {k: 164 + n for n, k in enumerate(formats)}
    custom = "".join(f'<numFmt numFmtId="{ids[k]}" formatCode={quoteattr(v)}/>' for k, v in formats.items())
    font = {"head": 1, "title": 2, "link": 3}
    xfs = "".join(
        f'<xf numFmtId="{ids.get(k, 0)}" fontId="{font.get(k, 0)}" fillId="0" borderId="0" xfId="0" applyNumberFormat="1">'
        + ('<alignment wrapText="1" vertical="top"/>' if k == "wrap" else "") + "</xf>" for k in _KINDS
    )
    fonts = '<font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="14"/><name val="Calibri"/></font><font><u/><sz val="11"/><color rgb="FF0563C1"/><name val="Calibri"/></font>'
    return (
        '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        f'<numFmts count="{len(formats)}">{custom}</numFmts><fonts count="4">{fonts}</fonts><fills count="2"><fill><patternFill patternType="none"/></fill>'
        '<fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="{len(_KINDS)}">{xfs}</cellXfs><dxfs count="2"><dxf><font><color rgb="FF006100"/></font></dxf><dxf><font><color rgb="FF9C0006"/></font></dxf></dxfs></styleSheet>'
    )


def write_workbook(path: Path, sheets: list[Sheet], decimals: dict | None = None) -> Path:
    """Writes a draft and puts it in place at once; if the place is locked, beside it under a free name."""
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_suffix(path.suffix + ".tmp")
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as z:
        for k, sheet in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                for part in _sheet_xml(sheet):
                    f.write(part if isinstance(part, bytes) else part.encode())
        drawn, n_charts, extra = 0, 0, ""
        for k, sheet in enumerate(sheets, 1):
            if not sheet.charts:
                if sheet.links:
                    z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", _rels_xml([], sheet.links))
                continue
            drawn += 1
            names = [f"chart{n_charts + i}.xml" for i in range(1, len(sheet.charts) + 1)]
            n_charts += len(names)
            z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", _rels_xml([("drawing", f"../drawings/drawing{drawn}.xml")], sheet.links))
            z.writestr(f"xl/drawings/drawing{drawn}.xml", _drawing_xml(sheet))
            z.writestr(f"xl/drawings/_rels/drawing{drawn}.xml.rels", _rels_xml([("chart", f"../charts/{n}") for n in names]))
            extra += f'<Override PartName="/xl/drawings/drawing{drawn}.xml" ContentType="application/vnd.openxmlformats-officedocument.drawing+xml"/>'
            for name, chart in zip(names, sheet.charts, strict=True):
                z.writestr(f"xl/charts/{name}", _chart_xml(chart))
                extra += f'<Override PartName="/xl/charts/{name}" ContentType="application/vnd.openxmlformats-officedocument.drawingml.chart+xml"/>'
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}{extra}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{k}"' + (' state="hidden"' if s.hidden else "") + f' r:id="r{k}"/>' for k, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}<Relationship Id="rs" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _styles_xml(number_formats(decimals or {})))
    try:
        os.replace(draft, path)
    except PermissionError:
        path = free_path(path.parent, f"{path.stem} (2){path.suffix}")
        os.replace(draft, path)
    return path
