import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import near_dedup as nd
from panelweave.llm.common import Stages
from panelweave.llm.components import components


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_families_of_all_spreads_equal_brute_force(spark, docs_table):
    rng = random.Random(6)
    texts = []
    for f in range(4):  # near copies of one text with more and more edits, so that links form chains and gaps
        base = [f"f{f}w{rng.randrange(80)}" for _ in range(100)]
        texts += [edited(base, rng.randrange(9), rng) for _ in range(40)]
    texts += [" ".join(rng.choices("ab cd ef gh".split(), k=rng.randrange(12))) for _ in range(30)]
    texts += ["", None, "One two", "one two", "one two three four five", "one two three four five"]
    rng.shuffle(texts)
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    got = rows_of(nd.near_duplicates(docs_table(rows)))
    want = brute.near_duplicates(rows)
    assert got == sorted(want, key=str)
    assert sum(not r[3] for r in got) > 40


def test_chains_reach_beyond_the_threshold(spark, docs_table):
    words = [f"w{i}" for i in range(200)]
    # Each text moves on by six words: neighbours are alike, ends are not.
    rows = [(100 - i, " ".join(words[6 * i : 6 * i + 120])) for i in range(12)]
    got = rows_of(nd.near_duplicates(docs_table(rows)))
    assert {r[2] for r in got} == {89}
    assert not 100 * len(brute.shingles(rows[0][1]) & brute.shingles(rows[-1][1])) >= 85 * 116


@pytest.mark.parametrize("percent", [85, 80])
def test_links_exactly_at_the_threshold(spark, docs_table, percent):
    """A and B lack C's ends and are linked through texts at both ends of a zone: A to C at the threshold, B twice as far from C."""
    rng = random.Random(percent)
    rows, cut = [], 100 - percent
    for f in range(24):
        a = [f"f{f}w{i}" for i in range(104)]  # 100 shingles
        c, b = a[: 104 - cut], a[cut:]
        texts = [a, c, b] + [[*c[:-k], *(f"f{f}e{k}x{i}" for i in range(k))] for k in range(1, 3 + f % 5)]
        rows += [(1000 * f + i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert rows_of(nd.near_duplicates(docs_table(rows), percent)) == sorted(brute.near_duplicates(rows, percent), key=str)


def test_many_copies_and_repeated_rows(spark, docs_table):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(300, 500)] + [(300, text), (7, text + " end"), (None, text), (None, None), (9, "other"), (9, "words here")]
    docs = docs_table(rows)
    got = rows_of(nd.near_duplicates(docs))
    assert all(r[2] == 7 for r in got if r[0] is not None and r[1] > 1)
    assert [(r[2], r[3]) for r in got if r[0] is None] == [(None, True), (None, True)]
    left = nd.without_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert kept == sorted([(7, text + " end"), (None, text), (None, None), (9, "other"), (9, "words here")], key=str)


def test_one_of_repeated_rows_stays(spark, docs_table):
    left = nd.without_near_duplicates(docs_table([(1, "a b"), (1, "a b"), (2, None), (2, None), (3, "a b")]))
    assert sorted((r["doc_id"], r["text"]) for r in left.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [(1, "a b"), (2, "")]


def test_empty_table(spark, docs_table):
    empty = docs_table([(1, "a")]).limit(0)
    assert nd.near_duplicates(empty).collect() == []
    assert nd.without_near_duplicates(empty).collect() == []


def test_estimates_are_close():
    a, b = nd._multipliers()
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
            y = np.concatenate([x[: int(2000 * 2 * share / (1 + share))], rng.integers(0, 1 << 63, 2000 - int(2000 * 2 * share / (1 + share))).astype(np.uint64)])
            bits = [nd.packed_bits(nd.minima(np.unique(s), a, b)) for s in (x, y)]
            errors.append(float(nd.estimate(*bits)) - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 301), (301, 300), (5, 5)]
    found = components(spark.createDataFrame(links, "a long, b long"), Stages(spark, "test"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[200 + i] for i in range(50)} == {100}
    assert got[301] == got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long"), Stages(spark, "test")).collect() == []


def test_the_pipeline_links_from_80_percent_on(spark, docs_table):
    import corpus_pipeline as cp

    rng = random.Random(9)
    rows, linked = [], []
    for k in range(60):
        words = [f"t{k}w{i}" for i in range(200)]
        # Four words far apart change 20 of 196 shingles: 176 of 216 are shared, below 0.85. Six words leave less than 0.8.
        for own, places in ((10 * k, ()), (10 * k + 1, (20, 60, 100, 140)), (10 * k + 2, (20, 60, 100, 140, 180, 190))):
            rows.append((own, " ".join(f"x{k}y{own}{i}" if i in places else w for i, w in enumerate(words))))
        linked.append(10 * k + 1)
    rng.shuffle(rows)
    docs = docs_table(rows)
    kept = {r["doc_id"] for r in cp.near_dedup_stage(spark, docs, "").select("doc_id").collect()}
    shingles = {i: brute.shingles(t) for i, t in rows}
    share = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert 0.8 <= share(0, 1) < 0.85 and share(0, 2) < 0.8 and share(1, 2) < 0.8
    assert kept == {i for i, _ in rows} - set(linked)


def test_bounds_follow_the_threshold():
    assert nd.rows_of_band(85) == 5 and nd.rows_of_band(80) == 4
    assert abs(nd.leave_from(85) - 0.65) < 1e-9 and abs(nd.estimate_floor(85) - 0.66) < 0.001
    for percent in nd.THRESHOLDS:
        rows = nd.rows_of_band(percent)
        assert (1 - (percent / 100) ** rows) ** (nd.MINIMA // rows) < 1e-6
        assert nd.FAMILY < nd.leave_from(percent) - (100 - percent) / 100
    for percent in (59, 100):
        try:
            nd.rows_of_band(percent)
        except ValueError:
            continue
        raise AssertionError(percent)


class PlannedStages(Stages):
    """Stages that keep the plan of each table before it is written, by its name."""

    def __init__(self, spark):
        super().__init__(spark, "test")
        self.plans = {}

    def write(self, df, name, options=None):
        self.plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return super().write(df, name, options)


def near_copies(spark, stages, n=60):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    docs = spark.createDataFrame([(i, edited(base, rng.randrange(6), rng)) for i in range(n)], "doc_id long, text string")
    return stages.write(nd.sketches(docs).select(F.col("doc_id").alias("node"), "bands", "bits"), "classes")


def test_bands_of_all_classes_are_never_broadcast(spark):
    """Each class has many rows of bands, which Spark sizes as one row a class."""
    stages = PlannedStages(spark)
    assert nd.families(near_copies(spark, stages), stages).count() > 30
    assert "BroadcastHashJoin" not in stages.plans["buckets"] and "SortMergeJoin" in stages.plans["buckets"]


def test_written_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    stages = PlannedStages(spark)
    classes = near_copies(spark, stages)
    plain = sorted(map(tuple, nd.families(classes, stages).collect()))
    monkeypatch.setattr("panelweave.llm.common.BROADCAST_ROWS", 20, raising=False)
    monkeypatch.setattr("panelweave.llm.components.BROADCAST_ROWS", 20, raising=False)
    stages = PlannedStages(spark)
    chains = nd.families(classes, stages)
    assert sorted(map(tuple, chains.collect())) == plain
    assert {r["component"] for r in components(chains, stages).collect()} == {0}
    assert all("BroadcastHashJoin" not in stages.plans[name] for name in ("buckets", "led", "edges"))
