import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.operators import balance_check, balance_panel, balanced_entities, cells, panel_cells, retention

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
pairs = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["0121", "0221", "0321"])), min_size=1, max_size=20)


@SLOW
@given(pairs)
def test_balanced_entities_have_every_period(spark, data):
    df = spark.createDataFrame(data, "id int, mmyy string")
    length = len({p for _, p in data})
    seen = {i: {p for j, p in data if j == i} for i, _ in data}
    expected = sorted(r for r in data if len(seen[r[0]]) == length)
    out = balance_panel(df, "id", "mmyy")
    assert sorted(tuple(r) for r in out.collect()) == expected
    kept = retention(out, df).first()
    assert (kept["kept_rows"], kept["all_rows"]) == (len(expected), len(data))
    assert abs(kept["retained"] - len(expected) / len(data)) < 1e-12


KINDS = {
    "mmyy": ["0121", "1220", "0100", "1299", "1322", "0021", "00121", "121", "1021", "", "x", "0121 ", "0121\n", None],
    "int": [0, 1, 63, 64, -1, -64, -65, 2**31 - 1, -(2**31), None],
    "long": [2**63 - 1, -(2**63), 2**62, 0, None],
    "double": [0.5, 1.0, float("inf"), None],
    "date": ["2021-01-01", "2021-02-01", "2021-01-31", "1969-12-31", "2030-01-01", None],
}


@pytest.mark.parametrize("kind", KINDS)
def test_periods_of_any_type_are_told_apart(spark, kind):
    """Entity ``all`` has each period twice, ``less k`` all but the k-th."""
    periods = KINDS[kind]
    rows = [("all", str(p) if kind == "date" and p else p) for p in periods * 2]
    rows += [(f"less {k}", str(p) if kind == "date" and p else p) for k in range(len(periods)) for j, p in enumerate(periods) if j != k]
    type_ = {"mmyy": "string", "date": "string"}.get(kind, kind)
    df = spark.createDataFrame(rows, f"id string, p {type_}").repartition(5)
    if kind == "date":
        df = df.withColumn("p", F.col("p").cast("date"))
    kept = {r["id"] for r in balance_panel(df, "id", "p").select("id").distinct().collect()}
    assert kept == {"all", f"less {len(periods) - 1}"}  # the last one lacks NULL, which does not count
    assert {r["id"] for r in balance_panel(df, "id", "p", count_na=True).select("id").distinct().collect()} == {"all"}
    assert {r["id"] for r in balanced_entities(df, "id", "p", len(periods) - 2).collect()} == {f"less {k}" for k in range(len(periods) - 1)}


def test_more_periods_than_any_bitmap_holds(spark):
    df = spark.range(0, 40_000, 1, 4).select((F.col("id") - 7000).alias("p"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("id"))
    df = df.where("id = 'a' or (id = 'b' and p <> 33000 - 1) or (id = 'c' and p % 2 = 0)")
    assert [r["id"] for r in balanced_entities(df, "id", "p").collect()] == ["a"]
    assert [r["id"] for r in balanced_entities(df, "id", "p", 20_000).collect()] == ["c"]
    text = df.withColumn("p", F.concat(F.lit("p"), "p"))
    assert [r["id"] for r in balanced_entities(text, "id", "p").collect()] == ["a"]


def test_one_aggregate_serves_bitmaps_length_and_hot_entities(spark):
    import re

    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("id"), (F.col("id") % 7).cast("int").alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = balance_panel(df, "id", "t")
        assert len(out.collect()) == 20_000
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "approx_top_k" not in plan
    assert len(re.findall("ReusedExchange", plan)) >= 2


def test_fixed_length_is_exact_not_at_least(spark, collect):
    rows = [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 1), (None, 1), (None, 2), (None, 3)]
    df = spark.createDataFrame(rows, "id string, year int")
    out = balance_panel(df, "id", "year", length=3)
    assert {r[0] for r in collect(out)} == {"a", None}
    assert collect(balance_check(out, "id", "year", "n")) == [(1, 1), (2, 1), (3, 1)]
    assert collect(balance_check(out, "id", "year", "n", count_na=True)) == [(1, 2), (2, 2), (3, 2)]


def test_null_period_counts_only_on_request(spark, collect):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "id string, t int")
    assert {r[0] for r in collect(balance_panel(df, "id", "t"))} == {"a", "b"}
    assert {r[0] for r in collect(balance_panel(df, "id", "t", count_na=True))} == {"a"}


def test_nothing_kept_is_a_ratio_of_zero(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, t int")
    assert tuple(retention(balance_panel(df, "id", "t"), df).first()) == (0, 2, 0.0)
    empty = df.where("false")
    assert tuple(retention(empty, empty).first()) == (0, 0, None)


ROWS = [
    ("s1", "a", "O", 10, 1.0),
    ("s1", "a", "O", 9, None),
    ("s1", "a", "A", None, 3.0),
    ("s1", "b", None, 12, 4.0),
    ("s1", None, "O", 0, 0.0),
    ("s2", "c", "A", None, None),
    (None, "d", "O", 20, 2.0),
]


def test_cells_match_hand_counts(spark):
    df = spark.createDataFrame(ROWS, "site string, id string, kind string, days int, x double")
    temp = F.col("kind") == "O"
    metrics = [
        cells.entities("n"),
        cells.entities("n_na", count_na=True),
        cells.entities("temps", temp),
        cells.entities("temps_na", temp, count_na=True),
        cells.total("days", "days"),
        cells.derived("days_each", F.try_divide("days", "n")),
        cells.share("long", F.col("days") >= 10),
        cells.share("share_temp", temp),
        cells.mean("x", "x"),
        cells.derived("ratio", F.try_divide("x", "days")),
    ]
    out = panel_cells(df, ["site"], "id", metrics)
    assert out.columns == ["site", *[m.name for m in metrics]]
    got = {r["site"]: tuple(r)[1:] for r in out.collect()}
    assert got["s1"] == (2, 3, 1, 2, 31, 15.5, 0.5, 0.75, 2.0, 2.0 / 31)
    assert got["s2"] == (1, 1, 0, 0, 0, 0.0, None, 0.0, None, None)
    assert got[None] == (1, 1, 1, 1, 20, 20.0, 1.0, 1.0, 2.0, 0.1)


@SLOW
@given(
    st.lists(
        st.tuples(st.integers(0, 2), st.integers(0, 3), st.one_of(st.none(), st.booleans()), st.one_of(st.none(), st.integers(-5, 5))),
        min_size=1,
        max_size=20,
    )
)
def test_two_level_cells_equal_direct_aggregates(spark, data):
    df = spark.createDataFrame(data, "site int, id int, c boolean, v int")
    out = panel_cells(
        df,
        ["site"],
        "id",
        [cells.entities("n"), cells.entities("nc", F.col("c")), cells.total("s", "v"), cells.mean("m", "v"), cells.share("p", F.col("c"))],
    )
    direct = df.groupBy("site").agg(
        F.count_distinct("id").alias("n"),
        F.count_distinct(F.when(F.col("c"), F.col("id"))).alias("nc"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("s"),
        F.avg("v").alias("m"),
        F.avg(F.col("c").cast("double")).alias("p"),
    )
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, direct.collect()), key=str)
