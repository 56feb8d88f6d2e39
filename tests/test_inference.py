import random
import re
from datetime import date

from pyspark.sql import types as T

from panelweave.sources import infer_schema, read_period_files

POOLS = {
    "logical": ["TRUE", "false", "True"],
    "whole": ["0", "-12", "+7", "0012", "9223372036854775807"],
    "number": ["1.5", "-2e3", ".5", "3.", "9223372036854775808"],
    "date": ["2021-02-28", "1999-12-31"],
    "text": ["x", "2021-02-30", "31/12/2021", "1,5", "true?", "1e", "--"],
    "blank": ["", "NA", "  "],
}


def kind_of(values):
    """The narrowest type by trying each on every value."""

    def is_date(v):
        try:
            return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", v)) and bool(date.fromisoformat(v))
        except ValueError:
            return False

    known = [v.strip() for v in values if v.strip() not in ("", "NA")]
    tests = [
        (T.BooleanType(), lambda v: v.lower() in ("true", "false")),
        (T.LongType(), lambda v: bool(re.fullmatch(r"[+-]?\d+", v)) and -(2**63) <= int(v) < 2**63),
        (T.DoubleType(), lambda v: bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v))),
        (T.DateType(), is_date),
    ]
    return next((t for t, fits in tests if known and all(map(fits, known))), T.StringType())


def test_types_equal_brute_force_on_drifting_files(spark, tmp_path):
    rng = random.Random(4)
    columns = {}
    for i in range(40):
        kinds = rng.sample(list(POOLS), rng.choice([1, 1, 2]))
        columns[f"C{i}"] = [v for k in kinds for v in POOLS[k]] + (POOLS["blank"] if rng.random() < 0.5 else [])
    seen = {c: [] for c in columns}
    for f in range(6):
        names = rng.sample(list(columns), 25)
        rows = [[rng.choice(columns[c]) for c in names] for _ in range(8)]
        for c, values in zip(names, zip(*rows)):
            seen[c] += values
        lines = [";".join(rng.choice([n, n.lower()]) for n in names), *[";".join(r) for r in rows]]
        (tmp_path / f"f_0{f + 1}21.csv").write_text("\n".join(lines) + "\n")
    found = infer_schema(spark, str(tmp_path), sep=";")
    assert {f.name: f.dataType for f in found} == {c: kind_of(v) for c, v in seen.items() if v}


def test_files_are_read_with_the_types_found(spark, collect, tmp_path):
    (tmp_path / "a_0121.csv").write_text('id,open,n,day\na,TRUE,1,2021-01-31\nb,NA,,\n')
    (tmp_path / "b_0221.csv").write_text('n,note,id\n2.5,"two\nlines",c\n')
    found = read_period_files(spark, str(tmp_path), multi_line=True)
    assert found.dtypes == [("DATE", "string"), ("YEAR", "int"), ("ID", "string"), ("OPEN", "boolean"), ("N", "double"), ("DAY", "date"), ("NOTE", "string")]
    assert collect(found, "ID", "OPEN", "N", "DAY", "NOTE") == [
        ("a", True, 1.0, date(2021, 1, 31), None),
        ("b", None, None, None, None),
        ("c", None, 2.5, None, "two\nlines"),
    ]


def test_no_files_have_no_columns(spark, tmp_path):
    (tmp_path / "empty_0121.csv").write_text("")
    assert infer_schema(spark, str(tmp_path)) == T.StructType([])
    assert read_period_files(spark, str(tmp_path)).columns == ["DATE", "YEAR"]


def test_preamble_is_no_part_of_the_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Title\n\nid,n\na,1\n")
    assert infer_schema(spark, str(tmp_path), skip=2) == T.StructType([T.StructField("ID", T.StringType()), T.StructField("N", T.LongType())])


