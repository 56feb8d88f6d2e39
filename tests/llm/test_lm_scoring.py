import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import lm_scoring

DEPTH = 2


def tree_scores(train, texts, depth):
    """Context tree weighting written as its definition: one tree of contexts for each node of the byte tree."""
    counts = {}
    for t in train:
        data = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            for j in range(8):
                node, bit = (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1
                for d in range(depth + 1):
                    counts.setdefault((node, data[i - d : i]), [0, 0])[bit] += 1

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def children(node, context):
        return [c for (n, c) in counts if n == node and len(c) == len(context) + 1 and c.endswith(context)]

    memo = {}

    def weighted(node, context):
        key = node, context
        if key not in memo:
            own = estimate(*counts[key])
            if len(context) < depth:
                longer = sum(weighted(node, c) for c in children(node, context))
                own = math.log(0.5 * math.exp(own) + 0.5 * math.exp(longer))
            memo[key] = own
        return memo[key]

    def predict(node, past, d, bit):
        context = past[len(past) - d :]
        if (node, context) not in counts:
            return 0.5
        a, b = counts[node, context]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == depth:
            return own
        longer = sum(weighted(node, c) for c in children(node, context))
        beta = math.exp(estimate(a, b) - longer)
        return (beta * own + predict(node, past, d + 1, bit)) / (beta + 1)

    out = []
    for t in texts:
        data, total = b"\xff" * depth + t + b"\xff", 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                node, bit = (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1
                total += math.log10(predict(node, data[:i], 0, bit))
        out.append(total)
    return out


TEXTS = ["the cat sat", "the hat", None, "", "Thé cät", "zzz unseen qq", "the cat sat", "a\x0bb\tc"]


def scored(spark, rows, held, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("block", F.lit(1))
    return lm_scoring.score_texts(docs, F.col("doc_id").isin(held), depth=DEPTH, **settings).orderBy("doc_id").collect()


@pytest.mark.parametrize("block_bytes", [1 << 20, 12])
def test_scores_are_those_of_the_weighted_tree(spark, block_bytes):
    rows = list(enumerate(TEXTS))
    held = [4, 5]
    got = scored(spark, rows, held, block_bytes=block_bytes)
    texts = [lm_scoring.lowered(t) for t in TEXTS]
    want = tree_scores([t for i, t in enumerate(texts) if i not in held], texts, DEPTH)
    assert [r["score"] for r in got] == pytest.approx(want, rel=1e-9)
    assert [r["bits_per_byte"] for r in got] == pytest.approx([-w * math.log2(10) / (len(t) + 1) for w, t in zip(want, texts)])


def test_base_is_the_unigram_score(spark):
    rows = list(enumerate(TEXTS * 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lm_scoring.score_texts(docs, held, depth=1).orderBy("doc_id").collect()
    for r, want in zip(got, sorted(brute.unigram(rows))):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:5]
        assert r["base_score"] == pytest.approx(want[5])


def test_probabilities_of_all_next_bytes_sum_to_one(spark, tmp_path):
    from panelweave.llm.common import Stages

    stages = Stages(spark, "test")
    runs = Counter()
    for t in (b"abracadabra", b"banana"):
        code, _ = lm_scoring.runs([t], DEPTH)
        runs.update(int(c) for c in code)
    for context in (b"ab", b"zz", b"\xff\xff"):
        asked = {(context[0] << 16) | (context[1] << 8) | b: 0 for b in range(256)}
        counts = spark.createDataFrame([(r, n) for r, n in (asked | runs).items()], "run long, total long")
        scores = lm_scoring.run_scores(counts, lm_scoring.model(counts, stages, DEPTH)).collect()
        assert sum(10 ** r["log_p"] for r in scores if r["run"] in asked) == pytest.approx(1)


def test_no_rows_and_no_training_rows(spark):
    assert scored(spark, [], []) == []
    only_held = scored(spark, [(1, "ab")], [1])
    assert only_held[0]["score"] == pytest.approx(24 * math.log10(0.5))
    assert only_held[0]["train_tokens"] == 0


def test_held_out_text_like_the_training_texts_scores_higher(spark):
    same = [(i, f"the number {i % 7} is a common number") for i in range(30)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in scored(spark, [*same, (90, "the number 3 is a common number"), (91, "xq zv kwj pf xq zv kwj pf")], [90, 91])}
    assert got[90] < 1 < got[91]


def test_long_texts_are_counted_and_scored_in_chunks(spark, monkeypatch):
    rows = list(enumerate([*TEXTS, "a long text, " * 40, "so long " * 30, "ab" * 7]))
    want = [(r["score"], r["n_tokens"], r["base_score"]) for r in scored(spark, rows, [8])]
    depth, texts = 3, [lm_scoring.lowered(t) for _, t in rows]
    whole = lm_scoring.runs(texts, depth)[0]
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 16)
    parts = [c for t in texts for c in (lm_scoring._long_runs(t, depth) if len(t) > 16 else [lm_scoring.runs([t], depth)[0]])]
    assert Counter(np.concatenate(parts).tolist()) == Counter(whole.tolist())
    counts = lm_scoring._Counts(depth)
    for i, t in enumerate(texts):
        counts.add(i % 3 == 0, t)
    counts.flush(False), counts.flush(True), counts.fold()
    trained = Counter(c for i, t in enumerate(texts) if i % 3 for c in lm_scoring.runs([t], depth)[0].tolist())
    assert dict(zip(counts.codes.tolist(), counts.counts.tolist())) == {c: trained[c] for c in whole.tolist()}
    lookup = lm_scoring._Lookup(counts.codes, counts.counts.astype(float))
    assert sum(lm_scoring._long_scores(texts[8], depth, lookup)) == sum(trained[c] for c in lm_scoring.runs([texts[8]], depth)[0].tolist())
    assert len(want) == len(rows)


MEASURE = """
import random, resource, sys
import numpy as np, pyarrow as pa
from panelweave.llm import lm_scoring as lm
rng = random.Random(1)
letters = sys.argv[1]
words = ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(30_000)]
weights = [1 / (k + 1) for k in range(len(words))]
texts, size = [], 0
while size < lm.BLOCK_BYTES:
    texts.append(" ".join(rng.choices(words, weights, k=300)))
    size += len(texts[-1].encode())
batches = [pa.RecordBatch.from_arrays([pa.array([1] * len(t)), pa.array([False] * len(t)), pa.array(t)], ["block", "held_out", "text"])
           for t in (texts[i : i + 2000] for i in range(0, len(texts), 2000))]
told = pa.Table.from_batches(list(lm._requests(lm.DEPTH)(iter(batches))))
counted = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = pa.table({"doc_id": range(len(texts)), "held_out": [False] * len(texts), "text": texts})
del texts, batches
value = np.where(told["word"].is_valid().to_numpy(), told["n"].to_numpy(), -1.0)
out = lm._score_block(lm.DEPTH, 1000, 100)(rows, told.append_column("value", pa.array(value)))
print(counted // 1024, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, len(out))
"""


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上个国和也子"])
def test_memory_of_a_worker_for_a_whole_block(letters):
    """Megabytes at most, the interpreter and the block's own texts (held twice here) included."""
    out = subprocess.run([sys.executable, "-c", MEASURE, letters], capture_output=True, text=True, check=True, cwd=Path(lm_scoring.__file__).parents[2])
    counted, scored_, n = map(int, out.stdout.split())
    print(counted, scored_)
    assert n > 1000 and counted < 300 and scored_ < 350
