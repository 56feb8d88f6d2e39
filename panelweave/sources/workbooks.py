"""Workbooks (.xlsx) as tables: zipped XML, read file by file in tasks.

Spark reads the files; each task unzips its own, streams the shared strings and the rows of one sheet, and
binds the columns by name. A cell that a merged range covers is blank but for the first one, blank rows
before the header and between rows are passed over, and ``skip`` goes by the sheet's own row numbers.
A workbook has at most a million rows a sheet, so a file is never more than one task's work.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.periods import period_in_text, period_year

# Fixed values of the format: namespaces, number formats that show dates, and the first day of the calendar.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DAY_ZERO, DAY_ZERO_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)

#: Rows that a task hands over at once.
ROWS_AT_ONCE = 5000


def _parts(archive: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind of a part, each dropped after use; none if there is no such part."""
    if name not in archive.namelist():
        return
    with archive.open(name) as part:
        root = None
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if root is None:
                root = element
            if event == "end" and element.tag == MAIN + tag:
                yield element
                element.clear()
                if len(root) > 1000:
                    root.clear()


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs joined, phonetic hints left out."""
    runs = [t for e in element if e.tag in (MAIN + "t", MAIN + "r") for t in ([e] if e.tag == MAIN + "t" else e.iter(MAIN + "t"))]
    return "".join(t.text or "" for t in runs)


def _column(place: str) -> int:
    """0 for A1, 26 for AA1."""
    at = 0
    for letter in place:
        if not letter.isalpha():
            break
        at = 26 * at + ord(letter.upper()) - 64
    return at - 1


def _sheet_part(archive: zipfile.ZipFile, sheet: str | int) -> str:
    """The part of a sheet, by its name or its place from 0 on."""
    sheets = [(s.get("name"), s.get(RELATION + "id")) for s in _parts(archive, "xl/workbook.xml", "sheet")]
    names = [n for n, _ in sheets]
    if (sheet not in names) if isinstance(sheet, str) else not 0 <= sheet < len(sheets):
        raise ValueError(f"no sheet {sheet!r} among {names}")
    wanted = dict(sheets)[sheet] if isinstance(sheet, str) else sheets[sheet][1]
    with archive.open("xl/_rels/workbook.xml.rels") as part:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(part).getroot()}
    target = targets[wanted]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _parts(archive, "xl/styles.xml", "numFmt")}
    shows = lambda n: n in DATE_FORMATS or bool(re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, "")), re.I))
    formats = [[int(x.get("numFmtId", 0)) for x in xfs] for xfs in _parts(archive, "xl/styles.xml", "cellXfs")]
    return {i for i, n in enumerate(formats[0] if formats else []) if shows(n)}


def _moment(value: str, zero: datetime) -> str:
    when = zero + timedelta(milliseconds=round(float(value) * 86_400_000))
    return when.date().isoformat() if when.time() == datetime.min.time() else when.isoformat(sep=" ")


def sheet_rows(content: bytes, sheet: str | int = 0, skip: int = 0) -> Iterator[list[str | None]]:
    """The filled rows of a sheet below row ``skip`` as texts; blank cells, and those that show an error, are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        part = _sheet_part(archive, sheet)
        strings = [_text(s) for s in _parts(archive, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(archive)
        late = any(p.get("date1904") in ("1", "true") for p in _parts(archive, "xl/workbook.xml", "workbookPr"))
        zero, number = DAY_ZERO_1904 if late else DAY_ZERO, 0
        for row in _parts(archive, part, "row"):
            number = int(row.get("r", number + 1))
            if number <= skip:
                continue
            cells: dict[int, str | None] = {}
            at = -1
            for cell in row:
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                kind, value = cell.get("t", "n"), cell.findtext(MAIN + "v")
                if kind == "inlineStr":
                    value = _text(cell.find(MAIN + "is"))
                elif value is None or kind == "e":
                    continue
                elif kind == "s":
                    value = strings[int(value)]
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind == "n" and int(cell.get("s", 0)) in dates:
                    value = _moment(value, zero)
                cells[at] = value
            if any(v is not None and v.strip() for v in cells.values()):
                yield [cells.get(k) for k in range(max(cells) + 1)]


def workbook_rows(
    files: DataFrame,
    schema: T.StructType,
    sheet: str | int = 0,
    skip: int = 0,
    stamp: bool = True,
    required: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of workbooks given as ``files`` (path, content), with the declared columns.

    The first filled row below row ``skip`` has the names, which are upper-cased. A column a sheet lacks is NULL, but one
    without any, or without one of ``required``, is refused with its path. Blank cells of text columns are
    blank text; ``stamp`` adds ``DATE`` and ``YEAR`` from the file's name, as for delimited files.
    """
    from panelweave.sources.period_files import typed

    wanted = schema.names

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = sheet_rows(bytes(content), sheet, skip)
                    names = [(n or "").strip().upper() for n in next(rows, [])]
                    repeated = {n for n in names if n and names.count(n) > 1}
                    absent = [n for n in required if n not in names]
                    if repeated or absent or not set(names) & set(wanted):
                        raise ValueError(f"repeated columns {sorted(repeated)}" if repeated else f"no column {', '.join(absent) or 'that is declared'}")
                    places = [names.index(n) if n in names else None for n in wanted]
                    part: list[list[str | None]] = []
                    for row in rows:
                        part.append([path, *[row[k] if k is not None and k < len(row) else None for k in places], *[k is None for k in places]])
                        if len(part) == ROWS_AT_ONCE:
                            yield pd.DataFrame(part, columns=read_names)
                            part = []
                    yield pd.DataFrame(part, columns=read_names)
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as wrong:
                    raise ValueError(f"{wrong} in {path}") from wrong

    lacks = [f"__lacks_{i}" for i in range(len(wanted))]
    read_names = ["__path", *wanted, *lacks]
    text = [T.StructField("__path", T.StringType()), *[T.StructField(n, T.StringType()) for n in wanted], *[T.StructField(n, T.BooleanType()) for n in lacks]]
    rows = files.select("path", "content").mapInPandas(read, T.StructType(text))
    columns = [
        F.when(~F.col(gone), typed(F.col(f"`{f.name}`"), f.dataType, f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else typed(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name)
        for f, gone in zip(schema, lacks)
    ]
    if stamp:
        period = period_in_text(F.regexp_substr(F.url_decode(F.replace("__path", F.lit("+"), F.lit(" "))), F.lit("[^/]*$")))
        columns = [period.alias("DATE"), period_year(period).alias("YEAR"), *columns]
    return rows.select(*columns)


def read_workbooks(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str = "*.xlsx",
    recursive: bool = False,
    sheet: str | int = 0,
    skip: int = 0,
    stamp: bool = True,
    required: tuple[str, ...] = (),
) -> DataFrame:
    """:func:`workbook_rows` of the files of a directory."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", str(recursive).lower()).load(path)
    return workbook_rows(files, schema, sheet, skip, stamp, required)


def workbook(sheets: dict[str, Iterable[Iterable]], merged: tuple[str, ...] = ()) -> bytes:
    """A workbook of these sheets; cells are texts, numbers, dates, flags or None. ``merged`` are ranges of the first sheet."""
    shared: dict[str, int] = {}

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, date):
            return f'<c s="1"><v>{(datetime(value.year, value.month, value.day) - DAY_ZERO).days}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="s"><v>{shared.setdefault(str(value), len(shared))}</v></c>'

    main, relation = MAIN.strip("{}"), RELATION.strip("{}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        put = archive.writestr
        for k, rows in enumerate(sheets.values(), 1):
            lines = "".join(f'<row r="{r}">{"".join(map(cell, row))}</row>' for r, row in enumerate(rows, 1) if row)
            ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merged) if k == 1 else ""
            ranges = f"<mergeCells>{ranges}</mergeCells>" if ranges else ""
            put(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData>{ranges}</worksheet>')
        items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)
        put("xl/sharedStrings.xml", f'<sst xmlns="{main}">{items}</sst>')
        put("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        named = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relation}"><sheets>{named}</sheets></workbook>')
        package = "http://schemas.openxmlformats.org/package/2006"
        link = lambda k, kind, target: f'<Relationship Id="rId{k}" Type="{relation}/{kind}" Target="{target}"/>'
        links = "".join(link(k, "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1))
        links += link(len(sheets) + 1, "sharedStrings", "sharedStrings.xml") + link(len(sheets) + 2, "styles", "styles.xml")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        put("_rels/.rels", f'<Relationships xmlns="{package}/relationships">{link(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
        book = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        types = [("workbook.xml", "sheet.main"), ("sharedStrings.xml", "sharedStrings"), ("styles.xml", "styles")]
        types += [(f"worksheets/sheet{k}.xml", "worksheet") for k in range(1, len(sheets) + 1)]
        over = "".join(f'<Override PartName="/xl/{p}" ContentType="{book}{t}+xml"/>' for p, t in types)
        base = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types">{base}{over}</Types>')
    return out.getvalue()
