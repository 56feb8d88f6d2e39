import re
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SMOKE_DIR = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted toxic texts, copies, benchmark passages and secrets, among clean ones."""
    import random

    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage = " ".join(rng.choices(WORDS, k=30))
    rows = []
    for i in range(200):
        words = rng.choices(WORDS, k=rng.randint(60, 90))
        if i < 40:
            words[3] = words[9] = "vilewordly" if i % 2 else "vilewords"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[50][1]) for i in range(5)] + [(310, rows[51][1] + " end")]
    rows += [(320 + i, f"own{i} " + " ".join(rng.choices(WORDS, k=30)) + " " + passage) for i in range(3)]
    rows += [(330, " ".join(rng.choices(WORDS, k=40)) + " token = 'q9w8e7r6t5y4'"), (340, None), (341, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i < 40)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), passage


def test_stage_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


def test_each_stage_does_its_part_and_keeps_the_rest(spark, corpus, tmp_path):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = set(texts) - set(range(40))
    gone = {"near_dedup": {300, 301, 302, 303, 304, 310}, "decontamination": {320, 321, 322}}
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        expected -= gone.get(name, set())
        held = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(held) == expected
        changed = {d for d in held if held[d] != texts[d]}
        assert changed == ({330} if name == "secrets" else set())
    assert "q9w8e7r6t5y4" not in held[330] and "[secret]" in held[330]
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_run_packs_what_the_stages_keep(spark, corpus):
    folder, texts, _ = corpus
    rows = cp.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids == set(texts) - set(range(40)) - {300, 301, 302, 303, 304, 310, 320, 321, 322}
    assert len({r["sequence_id"] for r in rows}) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 1


@pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="supplied tables are not here")
def test_stages_equal_brute_force_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    near = {r["doc_id"] for r in cp.near_dedup_stage(spark, docs, SMOKE_DIR).collect()}
    assert near == {r[0] for r in brute.near_duplicates(pairs, cp.SIMILAR_FROM) if r[3]}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in cp.decontamination_stage(spark, docs, SMOKE_DIR).collect()}
    assert clean == {r[0] for r in brute.decontamination(pairs, bench) if not r[5]}
    for r in cp.secrets_stage(spark, docs, SMOKE_DIR).collect():
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"])


def test_empty_documents(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
