import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from panelweave.functions.exact import exact_deviation, exact_mean, exact_sum
from panelweave.operators import Variable, cells, group_difference_table, panel_cells


def one(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(exact_sum("x").alias("s")).first()["s"]


SETS = [
    [0.1] * 10,
    [1e16, 1.0, -1e16],
    [1e-20, -3e-20],
    [-(2.0**-60), 2.0**-61],
    [2.0**83, -(2.0**83), 0.3],
    [-1.5, -2.25, 0.0],
    [-0.1, 0.1],
    [123456789.123, -0.000001, 1e20, 7e-9],
]


@pytest.mark.parametrize("values", SETS)
def test_sums_are_those_of_exact_arithmetic(spark, values):
    assert one(spark, values) == pytest.approx(math.fsum(values), rel=4e-16, abs=1e-28)


def test_random_sums_and_odd_values(spark):
    rng = random.Random(3)
    for size in (1, 1e-9, 1e12):
        values = [rng.gauss(0, size) * 10 ** rng.randrange(-6, 6) for _ in range(500)]
        assert one(spark, values) == pytest.approx(math.fsum(values), rel=4e-16, abs=1e-26)
    assert one(spark, [None, None]) is None and one(spark, [None, 2.5]) == 2.5
    assert one(spark, [1.0, float("inf")]) == float("inf") and math.isnan(one(spark, [1.0, float("nan")]))
    assert one(spark, [1e300, 1.0]) == 1e300


def test_bits_do_not_depend_on_partitions_or_order(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 3).alias("site"),
        (F.col("id") % 17).alias("id"),
        F.when(F.col("id") % 11 > 0, F.rand(7) * F.pow(F.lit(10.0), F.col("id") % 13 - 6) * F.when(F.col("id") % 2 == 0, -1).otherwise(1)).alias("x"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
    ).coalesce(1)
    data = [tuple(r) for r in rows.collect()]
    metrics = [cells.total("t", "x"), cells.mean("m", "x"), cells.share("s", F.col("x") > 0)]
    seen, tables = set(), set()
    for parts in (1, 7, 40):
        random.Random(parts).shuffle(data)
        df = spark.createDataFrame(data, rows.schema).repartition(parts)
        out = panel_cells(df, ["site"], "id", metrics, exact=True)
        seen.add(tuple(sorted((r["site"], r["t"].hex(), r["m"].hex(), r["s"].hex()) for r in out.collect())))
        made = group_difference_table(df, "kind", {"a": "a", "b": "b"}, [Variable("x", "X")], "a", exact=True).first()
        tables.add((made["a"].hex(), made["b"].hex(), made["diff"].hex(), made["se_diff"].hex()))
        plain = group_difference_table(df, "kind", {"a": "a", "b": "b"}, [Variable("x", "X")], "a").first()
        assert made["se_diff"] == pytest.approx(plain["se_diff"], rel=1e-9) and made["diff"] == pytest.approx(plain["diff"], rel=1e-9)
    assert len(seen) == len(tables) == 1


def test_mean_and_deviation(spark):
    values = [48.0, 42.5, None, 39.25, 61.0]
    known = [v for v in values if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.agg(exact_mean("x"), exact_deviation("x")).first()
    assert got[0] == pytest.approx(statistics.mean(known)) and got[1] == pytest.approx(statistics.stdev(known))
    few = df.where("x = 48").agg(exact_mean("x"), exact_deviation("x")).first()
    assert tuple(few) == (48.0, None)
    assert tuple(df.where("false").agg(exact_mean("x"), exact_deviation("x")).first()) == (None, None)


@pytest.mark.parametrize("keys", [["site"], []])
def test_exact_sums_are_held_for_cells_not_for_entities(spark, keys):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(400)]), rng.choice([None, rng.gauss(0, 1e6), 1e-9])) for _ in range(3000)]
    df = spark.createDataFrame(data, "site string, id long, x double")
    sums = [cells.total("t", "x"), cells.mean("m", "x"), cells.derived("both", F.col("t") + F.col("m"))]
    for metrics in (sums, [cells.entities("n"), *sums, cells.entities("above", F.col("x") > 1, count_na=True)]):
        out = panel_cells(df, keys, "id", metrics, exact=True)
        assert out.columns == [*keys, *[m.name for m in metrics]]
        got = {r["site"] if keys else "all": r for r in out.collect()}
        for site in {r[0] for r in data} if keys else ["all"]:
            own = [r for r in data if not keys or r[0] == site]
            known = [x for _, _, x in own if x is not None]
            assert got[site]["t"] == pytest.approx(math.fsum(known), rel=4e-16)
            assert got[site]["m"] == pytest.approx(math.fsum(known) / len(known), rel=4e-16) and got[site]["both"] == got[site]["t"] + got[site]["m"]
            if len(metrics) > 3:
                assert got[site]["n"] == len({i for _, i, _ in own if i is not None})
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        by_entity = [line for line in plan.split("\n") if re.search(r"Aggregate \[[^\[\]]*\bid#\d+L\], \[", line)]
        assert len(by_entity) == (len(metrics) > 3) and not any("sum(" in line for line in by_entity)
    none = panel_cells(df.where("false"), keys, "id", sums, exact=True).collect()
    assert [tuple(r) for r in none] == ([] if keys else [(0.0, None, None)])
