import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import types as T

from panelweave.sources import read_workbooks, workbook
from panelweave.sources.workbooks import sheet_rows

SCHEMA = T.StructType(
    [
        T.StructField("CODE", T.LongType()),
        T.StructField("NAME", T.StringType()),
        T.StructField("RATE", T.DoubleType()),
        T.StructField("DAY", T.DateType()),
        T.StructField("OPEN", T.BooleanType()),
    ]
)
ROWS = [[35000012, "São & <b>", 0.25, date(2021, 5, 31), True], [7, None, None, None, False], [None, "--", 1, date(1999, 1, 1), None]]


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_preamble_merged_cells_and_drifting_columns(spark, collect, tmp_path):
    preamble = [["Title", None, "more"], [], ["code"], [], ["5"], [], [], ["8"]]
    write(tmp_path / "x_0521.xlsx", workbook({"data": [*preamble, ["Code", "name", "rate", "day", "open"], [], *ROWS], "other": [["x"]]}, ("A1:B1",)))
    write(tmp_path / "deep" / "y_0622.xlsx", workbook({"first": [["z"]], "data": [*preamble, ["Rate", None, "code "], [3, "lost", 9]]}))
    write(tmp_path / "notes.txt", b"none")
    found = read_workbooks(spark, str(tmp_path), SCHEMA, sheet="data", skip=8, recursive=True)
    assert found.columns == ["DATE", "YEAR", *SCHEMA.names]
    assert collect(found) == sorted(
        [
            ("0521", 2021, 35000012, "São & <b>", 0.25, date(2021, 5, 31), True),
            ("0521", 2021, 7, "", None, None, False),
            ("0521", 2021, None, "--", 1.0, date(1999, 1, 1), None),
            ("0622", 2022, 9, None, 3.0, None, None),
        ],
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )
    one = read_workbooks(spark, str(tmp_path), SCHEMA, skip=8, stamp=False)
    assert one.columns == SCHEMA.names and one.count() == 3


def test_cells_of_every_kind():
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
      <row r="2"><c r="B2" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c r="AB2" t="str"><f>A1</f><v>made</v></c></row>
      <row r="5"><c t="e"><v>#DIV/0!</v></c><c><v>1.5E3</v></c><c s="1"><v>44347.5</v></c><c t="b"><v>0</v></c></row>
      <row r="6"><c/><c t="s"><v>0</v></c></row></sheetData></worksheet>"""
    content = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook({"s": [["  "]]}))) as old, zipfile.ZipFile(content, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if "sheet1" in name else old.read(name))
    assert list(sheet_rows(content.getvalue())) == [[None, "inline", *[None] * 25, "made"], [None, "1.5E3", "2021-05-31 12:00:00", "FALSE"]]
    assert list(sheet_rows(content.getvalue(), "s", 2)) == [[None, "1.5E3", "2021-05-31 12:00:00", "FALSE"]]


def test_many_rows_and_an_empty_sheet(spark, tmp_path):
    write(tmp_path / "a.xlsx", workbook({"s": [["code"], *[[i] for i in range(12_000)]]}))
    write(tmp_path / "b.xlsx", workbook({"s": [["code"]]}))
    found = read_workbooks(spark, str(tmp_path), SCHEMA, stamp=False)
    assert found.count() == 12_000 and found.agg({"CODE": "sum"}).first()[0] == sum(range(12_000))


@pytest.mark.parametrize(
    "content, settings, said",
    [
        (workbook({"s": [["code", "CODE"], [1, 2]]}), {}, "repeated columns .*bad"),
        (workbook({"s": [["x"], [1]]}), {}, "no column that is declared in .*bad"),
        (workbook({"s": [["code"], [1]]}), {"required": ("RATE",)}, "no column RATE in .*bad"),
        (workbook({"s": [["code"], [1]]}), {"sheet": "data"}, "no sheet 'data' among .*bad"),
        (b"no archive", {}, "not a zip file in .*bad"),
        (workbook({"s": [["code"], [1.5]]}), {}, "holds whole numbers, but also 1.5"),
    ],
)
def test_what_cannot_be_read_is_refused_with_its_path(spark, tmp_path, content, settings, said):
    write(tmp_path / "bad.xlsx", content)
    with pytest.raises(Exception, match=said):
        read_workbooks(spark, str(tmp_path), SCHEMA, **settings).collect()
