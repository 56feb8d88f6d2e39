import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweave.functions import codes, missing, periods


def one(spark, column, **values):
    """Evaluate a column over one row; a value is (SQL type, value)."""
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items()) or "x int"
    row = [tuple(v for _, v in values.values()) or (1,)]
    return spark.createDataFrame(row, schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1/2/2020", dt.date(2020, 2, 1)),
        ("1/2/2020 00:00", dt.date(2020, 2, 1)),
        ("01/02/2020 00:00:00", dt.date(2020, 2, 1)),
        ("31/02/2020", None),
        ("2020-02-01", None),
        ("garbage", None),
        ("", None),
        (None, None),
    ],
)
def test_leading_date_ignores_trailing_text(spark, text, expected):
    assert one(spark, periods.leading_date("t"), t=("string", text)) == expected


@pytest.mark.parametrize(
    "name, period, year",
    [("ativos_0521.csv", "0521", 2021), ("a12_b1223x.csv", "1223", 2023), ("no_digits_12.csv", None, None), (None, None, None)],
)
def test_period_from_file_name_is_null_without_four_digits(spark, name, period, year):
    assert one(spark, periods.period_in_text("t"), t=("string", name)) == period
    assert one(spark, periods.period_year(periods.period_in_text("t")), t=("string", name)) == year


@pytest.mark.parametrize(
    "mmyy, start, days",
    [
        ("0224", dt.date(2024, 2, 1), 29),
        ("0223", dt.date(2023, 2, 1), 28),
        ("1268", dt.date(2068, 12, 1), 31),
        ("0469", dt.date(1969, 4, 1), 30),
        ("1321", None, None),
        (None, None, None),
    ],
)
def test_month_start_and_length(spark, mmyy, start, days):
    assert one(spark, periods.period_start("t"), t=("string", mmyy)) == start
    assert one(spark, periods.days_in_month(periods.period_start("t")), t=("string", mmyy)) == days


def test_period_of_day(spark):
    assert one(spark, periods.period_of("d"), d=("date", dt.date(2003, 4, 9))) == "0403"


@pytest.mark.parametrize(
    "code, expected",
    [(12345, "35012345"), (35012345, "35012345"), (135012345, "35012345"), (7, "35000007"), (None, None)],
)
def test_school_code_keeps_the_last_eight_then_overwrites_the_prefix(spark, code, expected):
    column = codes.replace_prefix(codes.keep_last(missing.number_to_text("c"), 8), "35")
    assert one(spark, column, c=("long", code)) == expected


def test_number_to_text_has_no_exponent(spark):
    assert one(spark, missing.number_to_text("c"), c=("double", 35000012.0)) == "35000012"


def test_replace_prefix_leaves_short_text_alone(spark):
    assert one(spark, codes.replace_prefix("c", "35"), c=("string", "7")) == "7"


@pytest.mark.parametrize("value, inside, outside", [("a", True, False), ("b", False, True), (None, False, True)])
def test_membership_of_null(spark, value, inside, outside):
    assert one(spark, missing.is_in("v", ["a"]), v=("string", value)) is inside
    assert one(spark, missing.not_in("v", ["a"]), v=("string", value)) is outside


def test_membership_can_list_null(spark):
    assert one(spark, missing.is_in("v", ["a", None]), v=("string", None)) is True
    assert one(spark, missing.is_in("v", []), v=("string", "a")) is False


@pytest.mark.parametrize("test, expected", [(True, "y"), (False, "n"), (None, None)])
def test_two_way_choice_with_unknown_test(spark, test, expected):
    assert one(spark, missing.if_else(F.col("t"), F.lit("y"), F.lit("n")), t=("boolean", test)) == expected


@pytest.mark.parametrize(
    "a, b, total, mean, largest",
    [(1.0, 3.0, 4.0, 2.0, 3.0), (None, 3.0, 3.0, 3.0, 3.0), (None, None, 0.0, None, None)],
)
def test_row_reducers_skip_null(spark, a, b, total, mean, largest):
    values = {"a": ("double", a), "b": ("double", b)}
    assert one(spark, missing.row_sum("a", "b"), **values) == total
    assert one(spark, missing.row_mean("a", "b"), **values) == mean
    assert one(spark, missing.row_max("a", "b"), **values) == largest


@pytest.mark.parametrize(
    "text, expected",
    [("1.5", 1.5), (" 2 ", 2.0), ("1e2", 100.0), (".5", 0.5), ("--", None), ("", None), ("NaN", None), ("1d", None), (None, None)],
)
def test_text_to_number(spark, text, expected):
    assert one(spark, missing.number("t"), t=("string", text)) == expected


def test_trimmed_strips_tabs(spark):
    assert one(spark, missing.trimmed("t"), t=("string", "\t a b \n")) == "a b"


def test_recode_keeps_or_defaults(spark):
    rules = [(["", "D"], "S/INFO"), (["N"], "P")]
    kept = {v: one(spark, codes.recode("v", rules), v=("string", v)) for v in ["", "D", "N", "B", None]}
    assert kept == {"": "S/INFO", "D": "S/INFO", "N": "P", "B": "B", None: None}
    assert one(spark, codes.recode("v", rules, otherwise=None), v=("string", "B")) is None
    assert one(spark, codes.recode("v", [([None], "x")]), v=("string", None)) == "x"


def test_lookup_of_unknown_key(spark):
    assert one(spark, codes.lookup("v", {"a": 1}), v=("string", "b")) is None
    assert one(spark, codes.lookup("v", {"a": 1}), v=("string", "a")) == 1


def test_count_distinct_with_missing_values(spark):
    df = spark.createDataFrame([("a", True), ("b", None), (None, True), ("a", False)], "id string, c boolean")
    out = df.agg(
        missing.count_distinct("id").alias("plain"),
        missing.count_distinct("id", count_na=True).alias("na"),
        missing.count_distinct("id", F.col("c")).alias("cond"),
        missing.count_distinct("id", F.col("c"), count_na=True).alias("cond_na"),
    ).first()
    assert tuple(out) == (2, 3, 1, 2)


def test_rounding_ties_go_away_from_zero(spark):
    assert one(spark, F.round(F.col("v"), 2), v=("double", 0.125)) == 0.13


def test_rounding_to_the_nearest_double_of_so_many_digits(spark):
    from panelweave.functions.rounding import round_nearest
    from panelweave.operators.quality import percent

    # Written table: value, digits, result.
    table = [
        (0.15, 1, 0.1), (0.25, 1, 0.2), (0.35, 1, 0.3), (0.45, 1, 0.4), (0.65, 1, 0.7), (2.675, 2, 2.67), (0.125, 2, 0.12), (0.375, 2, 0.38),
        (1.005, 2, 1.0), (2.5, 0, 2.0), (3.5, 0, 4.0), (1e15 + 0.5, 0, 1e15), (1e15 + 1.5, 0, 1e15 + 2), (0.0, 2, 0.0), (1e300, 2, 1e300),
        (4.35, 2, 4.35), (99.995, 2, 100.0), (5e-324, 2, 0.0),
    ]
    for value, digits, want in table:
        for sign in (1, -1):
            got = spark.range(1).select(round_nearest(F.lit(sign * value), digits).alias("r")).first()["r"]
            assert got == sign * want, (sign * value, digits, got)
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    assert [str(r[0]) for r in odd.select(round_nearest("v")).collect()] == ["None", "inf", "-inf", "nan"]
    ratio = spark.createDataFrame([(1, 800), (0, 0)], "a int, b int").select(percent("a", "b"), percent("a", "b", round_nearest))
    assert [tuple(r) for r in ratio.collect()] == [(0.13, 0.12), (None, None)]
