import math
import statistics

import pytest
from pyspark.sql import functions as F

from panelweave.operators import (
    Variable,
    composition_table,
    distinct_entity_row,
    group_difference_table,
    present,
    stack_report,
)

LEVELS = {"perm": "Efetivo", "temp": "Temporário"}
ROWS = [
    ("Efetivo", "a", 50, 0.1, "F"),
    ("Efetivo", "a", 40, None, "F"),
    ("Efetivo", "b", 45, 0.4, "M"),
    ("Temporário", "c", 30, 0.2, None),
    ("Temporário", "d", 31, 0.1, "F"),
    ("NI", "e", 99, 9.0, "F"),
    (None, "f", 99, 9.0, "F"),
]


@pytest.fixture
def panel(spark):
    return spark.createDataFrame(ROWS, "kind string, id string, age int, rate double, sex string")


VARIABLES = [
    Variable("age", "Age", "General"),
    Variable("rate", "Rate"),
    Variable("cast(coalesce(sex = 'F', false) as double)", "Women"),
    Variable("cast(sex = 'F' as double)", "Women known"),
]


def test_difference_and_error_use_all_rows_as_n(panel):
    out = group_difference_table(panel, "kind", LEVELS, VARIABLES, minuend="perm")
    got = {r["variable"]: r for r in out.collect()}
    assert out.columns == ["row_no", "section", "variable", "perm", "temp", "diff", "se_diff"]
    assert [r["row_no"] for r in sorted(got.values(), key=lambda r: r["row_no"])] == [1, 2, 3, 4]
    age, rate = got["Age"], got["Rate"]
    assert (age["perm"], age["temp"], age["diff"], age["section"]) == (45.0, 30.5, 14.5, "General")
    error = math.sqrt(statistics.variance([50, 40, 45]) / 3 + statistics.variance([30, 31]) / 2)
    assert age["se_diff"] == pytest.approx(error)
    # One rate is missing: the mean skips it, the error still divides by three rows.
    assert rate["perm"] == pytest.approx(0.25)
    assert rate["se_diff"] == pytest.approx(math.sqrt(statistics.variance([0.1, 0.4]) / 3 + statistics.variance([0.2, 0.1]) / 2))
    # An unknown sex is 0 in one variable and left out of the other.
    assert got["Women"]["temp"] == 0.5 and got["Women known"]["temp"] == 1.0
    assert got["Women known"]["se_diff"] is None


def test_minuend_sets_the_sign(panel):
    one = {r["variable"]: r["diff"] for r in group_difference_table(panel, "kind", LEVELS, VARIABLES, "perm").collect()}
    two = {r["variable"]: r["diff"] for r in group_difference_table(panel, "kind", LEVELS, VARIABLES, "temp").collect()}
    assert two == {k: pytest.approx(-v) for k, v in one.items()}
    with pytest.raises(ValueError):
        group_difference_table(panel, "kind", LEVELS, VARIABLES, "other")


def test_one_row_level_has_no_error(panel):
    out = group_difference_table(panel, "kind", {"a": "NI", "b": "Efetivo"}, VARIABLES[:1], "a").first()
    assert out["diff"] == 54.0 and out["se_diff"] is None


def test_absent_level_gives_missing_cells(panel):
    out = group_difference_table(panel, "kind", {"a": "Efetivo", "b": "none"}, VARIABLES[:1], "a").first()
    assert out["a"] == 45.0 and out["b"] is None and out["diff"] is None


def test_composition_shares_add_up_to_one(spark):
    rows = [("Efetivo", 1, None, 3, 4), ("Efetivo", 1, 5, 0, 6), ("Temporário", 0, 0, 0, 0), ("Temporário", 2, 0, 2, 4), ("NI", 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "kind string, a int, b int, c int, total int")
    parts = [Variable("a", "A", "Motives"), Variable("b", "B", "Motives"), Variable("c", "C", "Motives")]
    out = composition_table(df, "kind", LEVELS, parts, where=F.col("total") > 0)
    got = {r["variable"]: (r["row_no"], r["section"], r["perm"], r["temp"]) for r in out.collect()}
    assert got == {"A": (1, "Motives", 0.2, 0.5), "B": (2, "Motives", 0.5, 0.0), "C": (3, "Motives", 0.3, 0.5)}
    sums = out.agg(F.sum("perm"), F.sum("temp")).first()
    assert tuple(sums) == (pytest.approx(1.0), pytest.approx(1.0))


def test_composition_of_nothing_is_missing(spark):
    df = spark.createDataFrame([("Efetivo", 0, None)], "kind string, a int, b int")
    out = composition_table(df, "kind", LEVELS, [Variable("a", "A"), Variable("b", "B")]).collect()
    assert {(r["variable"], r["perm"], r["temp"], r["section"]) for r in out} == {("A", None, None, None), ("B", None, None, None)}


def test_distinct_entities_per_level(panel):
    plain = distinct_entity_row(panel, "id", "kind", LEVELS, "N").first()
    assert (plain["perm"], plain["temp"], plain["diff"], plain["se_diff"]) == (2.0, 2.0, None, None)
    counted = distinct_entity_row(panel, "id", "kind", LEVELS, "N", count_na=True).first()
    assert (counted["perm"], counted["temp"]) == (3.0, 3.0)
    known = panel.where("kind is not null")
    assert distinct_entity_row(known, "id", "kind", LEVELS, "N", count_na=True).first()["perm"] == 2.0


def test_stacked_report_fills_missing_columns_and_keeps_order(panel):
    report = stack_report(
        group_difference_table(panel, "kind", LEVELS, VARIABLES[:2], "perm"),
        composition_table(panel, "kind", LEVELS, [Variable("age", "Age share")]),
        distinct_entity_row(panel, "id", "kind", LEVELS, "N"),
    )
    shown = present(report, 2, {"perm": "Civil-servant", "se_diff": "SE"})
    got = shown.orderBy("part_no", "row_no").collect()
    assert shown.columns == ["part_no", "row_no", "section", "variable", "Civil-servant", "temp", "diff", "SE"]
    assert [r["variable"] for r in got] == ["Age", "Rate", "Age share", "N"]
    assert [r["SE"] is None for r in got] == [False, False, True, True]
    assert got[0]["SE"] == round(got[0]["SE"], 2)
