import pytest
from pyspark.sql import functions as F

from panelweave.operators.joins import grid_join, grid_slices, key_salts, keyed_join


def hot_table(spark, n=4000):
    """A third of the rows share key 7, another block of copies shares NULL."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select(key.cast("long").alias("k"), F.when(F.col("id") % 3 != 1, F.col("id")).alias("v"))


def small_table(spark):
    return spark.createDataFrame([(7, "x"), (7, "y"), (None, "n"), (2, "z"), (99999, "none")], "k long, w string")


def plain(left, right, how):
    on = left["k"].eqNullSafe(right["k"])
    joined = left.join(right, on, how)
    return joined if how == "left_semi" else joined.select(left["k"], "v", "w")


def test_hot_keys_are_found_and_others_are_not(spark):
    found = spark.range(1).select(key_salts(hot_table(spark), ["k"]).alias("m")).first()["m"]
    hashes = spark.sql("select xxhash64(7L) a, xxhash64(cast(null as bigint)) b").first()
    assert set(found) == {hashes["a"], hashes["b"]}
    assert all(n >= 2 for n in found.values())


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_equals_plain_join(spark, collect, how, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        left, right = hot_table(spark), small_table(spark)
        expected = collect(plain(left, right, how))
        assert collect(keyed_join(left, right, ["k"], how)) == expected
        assert collect(keyed_join(left, right, ["k"], how, salts=False)) == expected
        assert len(expected) > 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_hot_rows_spread_over_tasks(spark):
    """With a plain join one task would hold a third of all rows."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = hot_table(spark, 40000).where("v is not null or k is null")
        for key in (F.col("k") == 7, F.col("k").isNull()):
            joined = keyed_join(left, small_table(spark), ["k"], "left_semi").where(key)
            per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert len(per_task) > 1
            assert max(per_task) < 0.8 * sum(per_task)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_integer_widths_may_differ(spark, collect):
    left = hot_table(spark).withColumn("k", F.col("k").cast("int"))
    assert keyed_join(left, small_table(spark), ["k"], "inner").count() == plain(hot_table(spark), small_table(spark), "inner").count()


def test_other_type_differences_are_refused(spark):
    with pytest.raises(ValueError, match="string"):
        keyed_join(hot_table(spark), small_table(spark).withColumn("k", F.col("k").cast("string")), ["k"])
    with pytest.raises(ValueError, match="both sides"):
        keyed_join(hot_table(spark), small_table(spark), ["v"])
    with pytest.raises(ValueError, match="unsupported"):
        keyed_join(hot_table(spark), small_table(spark), ["k"], "full")


def test_clashing_names_get_suffixes(spark):
    left = spark.createDataFrame([(1, "a")], "k int, c string")
    right = spark.createDataFrame([(1, "b")], "k int, c string")
    out = keyed_join(left, right, ["k"])
    assert out.columns == ["k", "c_x", "c_y"]
    assert tuple(out.first()) == (1, "a", "b")


def test_empty_sides(spark):
    left, right = hot_table(spark), small_table(spark)
    assert keyed_join(left.where("false"), right, ["k"], "left").count() == 0
    assert keyed_join(left, right.where("false"), ["k"], "left").count() == left.count()
    assert keyed_join(left, right.where("false"), ["k"], "left_semi").count() == 0


def test_self_derived_right_side(spark):
    left = hot_table(spark)
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    out = keyed_join(left, counts, ["k"], "inner")
    assert out.count() == left.count()
    assert out.where("k = 7").agg(F.max("n")).first()[0] == left.where("k = 7").count()


def two_sided(spark, n=3000, hot=True):
    """Tables of which key 7 holds a third on both sides, and NULL a sixth on the left only."""
    key = lambda third, m: F.when(F.lit(hot) & (F.col("id") % 3 == 0), F.lit(third)).otherwise(F.col("id") % m)
    left = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 6 != 5, key(7, 400)).cast("long").alias("k"), F.col("id").alias("v"))
    right = spark.range(0, n // 2, 1, 8).select(key(7, 500).cast("long").alias("k"), (F.col("id") % 50).alias("w"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [True, False])
def test_grid_join_equals_plain_join(spark, how, hot):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = two_sided(spark, hot=hot)
        summary = lambda df: sorted(map(tuple, df.groupBy("k", "v").agg(F.count("*"), F.sum("w")).collect()), key=str)
        assert summary(grid_join(left, right, ["k"], how)) == summary(plain(left, right, how))
        for a, b in ((left.where("false"), right), (left, right.where("false")), (left, right.where("k = 7 and w = 3"))):
            assert summary(grid_join(a, b, ["k"], how)) == summary(plain(a, b, how))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_grid_of_a_key_hot_on_both_sides(spark):
    left, right = two_sided(spark)
    found = spark.range(1).select(grid_slices(left, right, ["k"]).alias("m"), F.xxhash64(F.lit(7).cast("long")).alias("h")).first()
    grid = found["m"][found["h"]]
    assert grid["rows"] > grid["columns"] > 1
    assert grid["rows"] * grid["columns"] >= 30  # 8 partitions


def test_pairs_of_a_hot_key_spread_over_tasks(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left, right = two_sided(spark, 12000)
        per_task = sorted(r["count"] for r in grid_join(left, right, ["k"]).groupBy(F.spark_partition_id()).count().collect())
        assert len(per_task) == 16 and per_task[-1] < 2 * per_task[8]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_tasks_of_a_grid_join_follow_its_pairs(spark, monkeypatch, how):
    """Few bytes make many pairs: merged by bytes, all of them would be one task's."""
    monkeypatch.setattr("panelweave.operators.joins.PAIRS_PER_TASK", 500_000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = two_sided(spark, 12000)
        left = left.withColumn("k", F.col("k").cast("int"))
        joined = grid_join(left, right, ["k"], how)
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == plain(left, right, how).count() > 8_000_000
        assert len(per_task) >= 16 and max(per_task) < 3 * 500_000
        summary = lambda df: sorted(map(tuple, df.groupBy("k").agg(F.count("*"), F.sum("w"), F.sum("v")).collect()), key=str)
        assert summary(joined) == summary(plain(left, right, how))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_grid_join_refuses_what_it_cannot_do(spark, collect):
    left, right = two_sided(spark, 30)
    with pytest.raises(ValueError, match="unsupported"):
        grid_join(left, right, ["k"], "left_semi")
    with pytest.raises(ValueError, match="both sides"):
        grid_join(left, right, ["v"])
    out = grid_join(left.withColumn("w", F.lit("l")), right, ["k"], "left", deal=(["v", "w"], ["w"]))
    assert out.columns == ["k", "v", "w_x", "w_y"]
