import random

import brute
from pyspark.sql import functions as F

from panelweave.llm import decontamination as dc

ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "three four five six seven eight nine ten eleven twelve thirteen"),
    (3, "short item here"),
    (4, None),
    (5, "..."),
    (6, "Éa éa éa éa éa éa éa éa éa éa éa éa"),
    (7, "solo"),
]


def found(spark, docs, items=ITEMS):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("own"))
    rows = dc.contamination(docs, bench).collect()
    out = []
    for r in rows:
        items = ",".join(sorted(str(i) for i in r["items"] or []))
        hit = {k for s in r["spans"] or [] for k in range(s["start"], s["end"])}
        out.append((r["doc_id"], r["n_words"], len(hit), len(r["items"] or []), brute.sha(items), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, docs_table):
    random.seed(3)
    vocabulary = "one two three four five six seven eight nine ten eleven twelve thirteen short item here".split()
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 40))) for _ in range(60)]
    texts += ["x ONE-two,three four; five six seven eight nine ten y", "a b c " * 5 + ITEMS[0][1] + " tail " + ITEMS[1][1], ITEMS[0][1] * 2]
    texts += [None, "", "a short item here", "éa " * 15, "Éa " * 15, "solo", "x solo short item here " * 3, "one two three four five six seven eight nine"]
    rows = list(enumerate(texts))
    assert found(spark, docs_table(rows)) == sorted(brute.decontamination(rows, ITEMS), key=str)


def test_every_shared_span_of_ten_words_is_found(spark, docs_table):
    random.seed(4)
    item = [f"w{random.randint(0, 3)}" for _ in range(60)]
    rows = [(i, f"p{i} q " + " ".join(item[i : i + 10]) + f" r s{i}") for i in range(50)]
    got = found(spark, docs_table(rows), [(9, " ".join(item))])
    assert all(r[5] and r[2] >= 10 for r in got)


def test_repeated_rows_null_ids_and_equal_ids(spark, docs_table):
    text = ITEMS[0][1]
    rows = [(1, text), (1, text), (1, "clean words only"), (None, text), (None, None)]
    docs = docs_table(rows)
    assert [r[5] for r in found(spark, docs)] == [r[5] for r in sorted(brute.decontamination(rows, ITEMS), key=str)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dc.without_overlaps(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "clean words only"), (None, None)], key=str)


def test_empty_tables(spark, docs_table):
    docs = docs_table([(1, "a b")])
    assert found(spark, docs.limit(0)) == []
    assert [r[5] for r in found(spark, docs, [])] == [False]
    assert found(spark, docs, [(4, None)]) == [(1, 2, 0, 0, brute.sha(""), False)]


def test_fingerprints_take_the_first_least_hash_of_each_window(spark):
    words = [f"w{i}" for i in range(30)]
    hashed = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    row = hashed.select(dc.fingerprints(F.col("h")).alias("f"), dc._runs(F.col("h"), 5).alias("g")).first()
    hashes = row["g"]
    want = {i + hashes[i : i + 6].index(min(hashes[i : i + 6])) for i in range(len(hashes) - 5)}
    assert [f["place"] for f in row["f"]] == sorted(want)


def test_many_items_of_one_preamble_and_a_very_long_text(spark, docs_table):
    preamble = " ".join(f"pre{i}" for i in range(50))
    items = [(i, f"{preamble} own{i} words{i} of{i} item{i} end{i}") for i in range(2000)] + [(5000, "two words")]
    long = " ".join(f"l{i % 977}" for i in range(400_000))
    rows = [(1, f"a {preamble} b"), (2, f"c {preamble} own7 words7 of7 item7 end7 d"), (3, long + " two words " + preamble + " " + long), (4, "x" * 1_000_000)]
    assert found(spark, docs_table(rows), items) == sorted(brute.decontamination(rows, items), key=str)


def test_documents_are_scanned_three_times_at_most(spark, tmp_path):
    import re

    spark.createDataFrame([(i, ITEMS[0][1] + f" x{i}") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    out = dc.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # One more pass finds the hits, when the table is built.
    assert len(re.findall(r"Relation \[doc_id", plan)) == 1


def test_many_windows_are_not_broadcast(spark, monkeypatch):
    """Overlapping windows pack into few bytes, by which Spark would find a table of millions small."""
    from panelweave.llm.common import Stages

    plans = []
    write = Stages.write

    def planned(self, df, name, options=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name, options)

    monkeypatch.setattr(Stages, "write", planned)
    monkeypatch.setattr("panelweave.llm.common.BROADCAST_ROWS", 10, raising=False)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words[50:80])), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:70]))], "item_id long, text string")
    overlaps = dc.find_overlaps(docs, bench).collect()
    assert [(r["doc_id"], r["items"] and sorted(r["items"])) for r in overlaps] == [(1, [7, 8])]
    join = next(plan for name, plan in plans if name == "matched")
    assert "window" in join and not [line for line in join.splitlines() if "BroadcastHashJoin" in line and "window" in line]
