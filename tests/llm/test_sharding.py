from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.llm import sharding as sh
from panelweave.llm.common import Stages


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 26, 1000])
def test_a_permutation_and_its_inverse(spark, n):
    rows = spark.range(n).withColumn("place", sh.place_of(F.col("id"), n)).withColumn("back", sh.number_at(F.col("place"), n)).collect()
    assert sorted(r["place"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)
    a, b = sh.halves(n)
    assert n <= a * b < n + a


def test_the_seed_decides(spark):
    one, two = (spark.range(500).select(sh.place_of(F.col("id"), 500, s).alias("p")).collect() for s in (1, 2))
    assert sum(a == b for a, b in zip(one, two)) < 20
    moved = [r["p"] for r in one]
    assert sum(abs(b - a) == 1 for a, b in zip(moved, moved[1:])) < 20


def test_long_walks_end(spark, monkeypatch):
    # Halves far larger than the rows need: most steps lie outside, and walks are long.
    monkeypatch.setattr(sh, "halves", lambda n: (12, 12))
    rows = spark.range(7).withColumn("place", sh.place_of(F.col("id"), 7)).withColumn("back", sh.number_at(F.col("place"), 7)).collect()
    assert sorted(r["place"] for r in rows) == list(range(7)) and all(r["back"] == r["id"] for r in rows)


def dealt(rows, **settings):
    return [tuple(r) for r in sh.shuffled_shards(rows, 7, **settings).collect()]


def even(found, shards=7):
    sizes = Counter(r[-2] for r in found)
    assert max(sizes.values()) - min(sizes.values() if len(sizes) == shards else [0]) <= 1
    assert sorted((r[-2], r[-1]) for r in found) == sorted((s, k) for s, n in sizes.items() for k in range(n))


def test_shards_do_not_depend_on_files_or_partitions(spark):
    rows = spark.range(400).select((F.col("id") * 13 % 401).alias("doc_id"), F.concat(F.lit("t"), "id").alias("shard_text"))
    first = sorted(dealt(rows))
    even(first)
    assert first == sorted(dealt(rows.orderBy(F.desc("shard_text")).repartition(23)))


def test_nulls_ties_copies_and_clashing_names(spark):
    data = [(1, "a", "x"), (1, "a", "x"), (1, "a", "x"), (None, None, None), (None, None, None), (2, "", "y"), (2, "b", None)]
    rows = spark.createDataFrame(data + [(9, "same", "z")] * 50, "doc_id long, text string, number string").withColumn("a b.c", F.lit(1))
    found = dealt(rows)
    assert Counter(r[:3] for r in found) == Counter(data + [(9, "same", "z")] * 50)
    even(found)
    with pytest.raises(ValueError, match="slot"):
        sh.shuffled_shards(rows.withColumn("slot", F.lit(0)), 7)
    even([r for r in dealt(rows.withColumn("slot", F.lit(0)), slot="at")])


def test_numbers_follow_the_order_over_ranges_and_pieces(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("v"))
    got = sh.numbered(rows, "n", Stages(spark, "test"), range_rows=20, copies=7).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(300))
    assert [r["v"] for r in got] == sorted(5 if i % 3 == 0 else i for i in range(300))


def test_empty_table(spark):
    assert dealt(spark.range(0)) == []
