"""Scores of texts under a context-tree-weighting model of bytes.

Each byte is coded as eight binary decisions, the nodes of a tree over its values. For each node and each
context of zero to ``depth`` bytes before it, counts of zeros and ones over the training texts give a
Krichevsky-Trofimov estimate. Weighting mixes the estimates of all depths: the weighted probability of
a context is half its own estimate plus half the product of those of its longer contexts, which fixes
how much each depth counts on the path of a given context. A text's score is the log10 probability of
its bytes and of an end mark, each text starting from a context of start marks.

All steps are tables keyed by context and node, so the model may grow with the corpus without bound:

1. texts are written in blocks of bounded size, each with a number;
2. each block asks for its distinct words and byte runs, with their counts in training texts;
3. the counts of a key are added up, partly before the shuffle, into one row for each key;
4. level by level, contexts are folded into shorter ones and the weights handed down again;
5. each block gets the totals of its words and the log probabilities of its runs, and scores its texts.

So a text never leaves its block, and a task holds one block and what this block asks for.

NULL and empty texts have the end mark alone. Rows are scored each for itself, repeated ones too. A NULL id
belongs to the training texts. Without training texts every decision has probability one half.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import Stages

DEPTH = 4
#: Bytes of text that one block holds, but for a longer text, which is a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes of text whose runs are counted or looked up at once.
CHUNK_BYTES = 1 << 18
#: Rows of a block that are sent at once.
ROWS_SENT = 1 << 16
#: Zstandard level of the streams that hold the rows of blocks.
STREAM_LEVEL = 7
#: Parquet pages that hold sorted numbers as differences.
DELTAS = {"parquet.writer.version": "v2"}
MARK = b"\xff"  # never a byte of UTF-8: start marks before a text, the end mark after it

_A2Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(_A2Z)


def _codes(joined: bytes, depth: int) -> np.ndarray:
    """Codes of all runs of depth + 1 bytes."""
    own = np.frombuffer(joined, np.uint8)
    n = len(own) - depth
    code = np.zeros(n, np.int64)
    for k in range(depth + 1):
        code <<= 8
        code |= own[k : k + n]
    return code


def _long_runs(text: bytes, depth: int) -> Iterator[np.ndarray]:
    """The run codes of one long text with its end mark, chunk by chunk."""
    for at in range(0, len(text), CHUNK_BYTES):
        before = MARK * (depth - min(depth, at)) + text[max(0, at - depth) : at]
        end = MARK if at + CHUNK_BYTES >= len(text) else b""
        yield _codes(before + text[at : at + CHUNK_BYTES] + end, depth)


def runs_within(texts: list[bytes], depth: int) -> np.ndarray:
    """Which runs of the joined texts, each between start marks and its end mark, end in a byte or end mark of a text."""
    within = np.ones(sum(len(t) + 1 + depth for t in texts) - depth, bool)
    at = 0
    for t in texts[:-1]:
        at += len(t) + 1
        within[at : at + depth] = False
        at += depth
    return within


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of depth + 1 bytes that end in a byte or end mark of a text, and the text of each."""
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    joined = b"".join(MARK * depth + t + MARK for t in texts)
    return _codes(joined, depth)[runs_within(texts, depth)], owner


def in_blocks(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of neighbouring rows: a block's number and ``rows``, some of its rows (doc_id, held_out, text) as a compressed Arrow stream.

    Texts pass a shuffle later; streams of many texts take less than half the room of single ones there.
    """

    def stream(rows: pa.RecordBatch) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", STREAM_LEVEL))) as writer:
            writer.write_batch(rows)
        return out.getvalue().to_pybytes()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 30, 0
        for batch in batches:
            rows, start = batch.drop_columns(["n_bytes"]), 0
            for at, size in enumerate(batch.column("n_bytes").to_pylist()):
                if held and held + size > block_bytes:
                    if at > start:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "rows": pa.array([stream(rows.slice(start, at - start))])})
                    block, held, start = block + 1, 0, at
                held += size
            if len(rows) > start:
                yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "rows": pa.array([stream(rows.slice(start))])})

    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text")).mapInArrow(number, "block long, rows binary")


def _table(stream: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(stream.as_buffer()).read_all()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, held_out and text of every row of some blocks."""
    for batch in batches:
        for block, rows in zip(batch.column("block"), batch.column("rows")):
            for part in _table(rows).to_batches():
                numbers = pa.array(np.full(len(part), block.as_py()))
                yield pa.RecordBatch.from_arrays([numbers, part.column("held_out"), part.column("text")], ["block", "held_out", "text"])


class _Counts:
    """Counts of run codes, merged chunk by chunk; the codes stay sorted."""

    def __init__(self, depth: int):
        self.depth = depth
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: dict[bool, list[bytes]] = {False: [], True: []}
        self.size = {False: 0, True: 0}

    def add(self, held: bool, text: bytes) -> None:
        """Take a text; a long one goes piece by piece, so that no chunk is much larger than CHUNK_BYTES."""
        if len(text) > CHUNK_BYTES:
            for code in _long_runs(text, self.depth):
                self._merge(code, not held)
            return
        self.held[held].append(text)
        self.size[held] += len(text) + self.depth + 1
        if self.size[held] > CHUNK_BYTES:
            self.flush(held)

    def flush(self, held: bool) -> None:
        texts = self.held[held]
        if texts:
            joined = b"".join(MARK * self.depth + t + MARK for t in texts)
            self._merge(_codes(joined, self.depth)[runs_within(texts, self.depth)], not held)
            self.held[held], self.size[held] = [], 0

    def _merge(self, code: np.ndarray, trains: bool) -> None:
        code.sort()
        edges = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.waiting.append((code[edges], np.diff(np.append(edges, len(code))) * trains))
        if sum(len(c) for c, _ in self.waiting) > max(CHUNK_BYTES, len(self.codes) // 2):
            self.fold()

    def fold(self) -> None:
        """Add up what has come since the last time."""
        codes = np.concatenate([self.codes, *(c for c, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        self.waiting.clear()
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        self.counts = np.add.reduceat(counts[order], edges) if len(codes) else counts
        self.codes = codes[edges]


def _requests(depth: int):
    """Task function: the distinct words and runs of each block with their counts in training texts. The word of an end is empty."""
    names = ["block", "word", "run", "n"]

    def told(block: int, counts: _Counts, words: Counter) -> Iterator[pa.RecordBatch]:
        said = iter(words.items())
        while part := list(islice(said, ROWS_SENT)):
            own = [np.full(len(part), block), pa.array([w.decode() for w, _ in part]), pa.nulls(len(part), pa.int64()), [n for _, n in part]]
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), own[1], own[2], pa.array(own[3], pa.int64())], names)
        words.clear()
        counts.flush(False)
        counts.flush(True)
        counts.fold()
        for at in range(0, len(counts.codes), ROWS_SENT):
            code, n = counts.codes[at : at + ROWS_SENT], counts.counts[at : at + ROWS_SENT]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.nulls(len(code), pa.string()), pa.array(code), pa.array(n)], names)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts, words = None, _Counts(depth), Counter()
        for batch in batches:
            for number, held, text in zip(*(batch.column(c) for c in ("block", "held_out", "text"))):
                if number.as_py() != block:
                    if block is not None:
                        yield from told(block, counts, words)
                    block, counts, words = number.as_py(), _Counts(depth), Counter()
                own = lowered(text.as_py())
                if held.as_py():
                    words.update(dict.fromkeys(own.split(), 0))
                    words[b""] += 0
                else:
                    words.update(own.split())
                    words[b""] += 1
                counts.add(held.as_py(), own)
        if block is not None:
            yield from told(block, counts, words)

    return requests


def requests(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """block, word or run, and ``n``, its count in the training texts of the block; a key has one row in each block that holds it."""
    told = _requests(depth)
    return blocks.mapInArrow(lambda batches: told(_unpacked(batches)), "block long, word string, run long, n long")


def totals(asked: DataFrame) -> DataFrame:
    """word or run, once each, with ``total``, its count over all training texts. Counts are added up before and after the shuffle."""
    return asked.groupBy("word", "run").agg(F.sum("n").alias("total"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 7, led back to x; for x of one half or more."""
    z = x + 7
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    steps = F.log(x)
    for k in range(1, 7):
        steps = steps + F.log(x + k)
    return series - steps


def _estimate(zeros: Column, ones: Column) -> Column:
    """Log of the Krichevsky-Trofimov estimate of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _decisions(run: Column) -> Column:
    """The eight (key, bit) decisions of a run: its context, then the node of the byte's tree."""
    parts = []
    byte, context = run.bitwiseAND(F.lit(255).cast("long")), F.shiftleft(F.shiftright(run, 8), 8)
    for j in range(8):
        node = F.shiftright(byte, 8 - j) + (1 << j)
        parts.append(F.struct((context + node).alias("key"), F.shiftright(byte, 7 - j).bitwiseAND(F.lit(1).cast("long")).cast("int").alias("bit")))
    return F.array(*parts)


def _shorter(key: Column, depth: int) -> Column:
    """The key of the same node in the context of ``depth`` bytes."""
    return key.bitwiseAND(F.lit((1 << (8 * depth + 8)) - 1).cast("long"))


def model(counts: DataFrame, stages: Stages, depth: int = DEPTH) -> list[DataFrame]:
    """For each depth from 0 up the table (key, p0, p1, rest): what the depths down to it give to each bit, and the share left to longer contexts.

    ``counts`` holds each run once, with its ``total`` in training texts.
    """
    seen = counts.where("total > 0").select("total", F.explode(_decisions(F.col("run"))).alias("d"))
    n = F.col("total").cast("double")
    level = seen.groupBy(F.col("d.key").alias("key")).agg(
        F.sum(F.when(F.col("d.bit") == 0, n).otherwise(0.0)).alias("zeros"), F.sum(F.when(F.col("d.bit") == 1, n).otherwise(0.0)).alias("ones")
    )
    level = level.withColumn("weighted", _estimate(F.col("zeros"), F.col("ones"))).withColumn("own", F.lit(1.0))
    levels = [stages.write(level, f"level-{depth}")]
    for d in range(depth - 1, -1, -1):
        folded = levels[0].groupBy(_shorter(F.col("key"), d).alias("key")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer")
        )
        estimated = folded.withColumn("estimate", _estimate(F.col("zeros"), F.col("ones")))
        high, low = F.greatest("estimate", "longer"), F.least("estimate", "longer")
        level = estimated.select(
            "key", "zeros", "ones",
            (high + F.log1p(F.exp(low - high)) - math.log(2)).alias("weighted"),
            (1 / (1 + F.exp(F.least(F.col("longer") - F.col("estimate"), F.lit(700.0))))).alias("own"),
        )
        levels.insert(0, stages.write(level, f"level-{d}"))
    out: list[DataFrame] = []
    all_seen = F.col("zeros") + F.col("ones") + 1
    zero, one = (F.col("zeros") + 0.5) / all_seen, (F.col("ones") + 0.5) / all_seen
    for d, level in enumerate(levels):
        if d == 0:
            above = level.withColumns({"a0": F.lit(0.0), "a1": F.lit(0.0), "share": F.lit(1.0)})
        else:
            parent = out[-1].select(F.col("key").alias("parent"), F.col("p0").alias("a0"), F.col("p1").alias("a1"), F.col("rest").alias("share"))
            above = level.join(parent, _shorter(F.col("key"), d - 1) == F.col("parent"))
        weight = F.col("share") * F.col("own")
        handed = above.select(
            "key", (F.col("a0") + weight * zero).alias("p0"), (F.col("a1") + weight * one).alias("p1"), (F.col("share") - weight).alias("rest")
        )
        out.append(stages.write(handed, f"weights-{d}"))
    stages.drop(*levels)
    return out


def run_scores(counts: DataFrame, weights: list[DataFrame]) -> DataFrame:
    """(run, log_p): the log10 probability of the last byte of each run after the others."""
    left = counts.select("run", F.explode(_decisions(F.col("run"))).alias("d")).select("run", "d.key", "d.bit")
    done = []
    for d in range(len(weights) - 1, -1, -1):
        # A decision that was never met in this context is looked up in the next shorter one; longer ones add one half.
        own = weights[d].withColumnRenamed("key", "known")
        joined = left.join(own, _shorter(F.col("key"), d) == F.col("known"), "left")
        chosen = F.when(F.col("bit") == 0, F.col("p0")).otherwise(F.col("p1")) + F.col("rest") / 2
        done.append(joined.where("known IS NOT NULL").select("run", F.log10(chosen).alias("log_p")))
        left = joined.where("known IS NULL").select("run", "key", "bit")
    done.append(left.select("run", F.lit(math.log10(0.5)).alias("log_p")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.groupBy("run").agg(F.sum("log_p").alias("log_p"))


class _Lookup:
    """Values by 64-bit keys: keys in the order of their hashes, and where each range of hashes begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(int(len(keys)).bit_length(), 1)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.searchsorted(slot[order], np.arange(1 << self.bits)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all known."""
        at = self.first[self._slot(keys)]
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


def _score_block(depth: int, tokens: int, distinct: int):
    base = math.log10(tokens + 0.5 * (distinct + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        is_word = told["word"].is_valid()
        own, looked = told.filter(is_word), told.filter(pc.invert(is_word))
        totals = {w.encode(): int(c) for w, c in zip(own["word"].to_pylist(), own["value"].to_pylist())}
        lookup = _Lookup(looked["run"].to_numpy(), looked["value"].to_numpy())
        del own, looked, told
        log_of = {c: math.log10(c + 0.5) - base for c in set(totals.values()) | {0}}
        end = totals.get(b"", 0)
        n_tokens, n_known, base_score, scores, n_bytes = [], [], [], [], []
        waiting, size = [], 0

        def look_up() -> None:
            if waiting:
                code, owner = runs(waiting, depth)
                scores.extend(np.bincount(owner, lookup(code), len(waiting)).tolist())
                waiting.clear()

        for value in rows["text"]:
            t = lowered(value.as_py())
            counts = [*map(totals.__getitem__, t.split()), end]
            n_tokens.append(len(counts))
            n_known.append(len(counts) - counts.count(0))
            base_score.append(math.fsum(map(log_of.__getitem__, counts)))
            n_bytes.append(len(t))
            if size + len(t) > CHUNK_BYTES:
                look_up()
                size = 0
            if len(t) > CHUNK_BYTES:
                scores.append(math.fsum(_long_scores(t, depth, lookup)))
            else:
                waiting.append(t)
                size += len(t)
        look_up()
        columns = [rows["doc_id"], rows["held_out"], n_tokens, n_known, [tokens] * len(rows), base_score, scores, n_bytes]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names)

    return score


def _long_scores(text: bytes, depth: int, lookup: _Lookup) -> Iterator[float]:
    """Sums of log probabilities of a long text, chunk by chunk."""
    for code in _long_runs(text, depth):
        yield float(lookup(code).sum())


def score_texts(docs: DataFrame, held_out: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Learn from the rows of ``docs`` that are not ``held_out`` and score all.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram words), score, and
    bits_per_byte, the code length under the model.
    """
    stages = Stages(docs.sparkSession, "lm-scoring")
    blocks = stages.write(in_blocks(docs, held_out, block_bytes), "blocks")
    asked = stages.write(requests(blocks, depth), "requests", DELTAS)
    # Runs in their order take less room, here and in the shuffles that read them.
    total = stages.write(totals(asked).sortWithinPartitions("run"), "totals", DELTAS)
    words = stages.write(total.where("word IS NOT NULL").select("word", "total"), "words")
    sizes = words.where("total > 0").agg(F.sum("total").alias("n"), F.count("*").alias("v")).first()
    counts = total.where("run IS NOT NULL").select("run", "total")
    weights = model(counts, stages, depth)
    scores = stages.write(run_scores(counts, weights).sortWithinPartitions("run"), "scores", DELTAS)
    stages.drop(total, *weights)
    no_run, no_word = F.lit(None).cast("long").alias("run"), F.lit(None).cast("string").alias("word")
    values = (
        asked.where("word IS NOT NULL").select("block", "word").join(words, "word").select("block", "word", no_run, F.col("total").cast("double").alias("value"))
    ).unionByName(
        asked.where("run IS NOT NULL").select("block", "run").join(scores, "run").select("block", no_word, "run", F.col("log_p").alias("value"))
    )
    schema = T.StructType([docs.schema["doc_id"]]).add("held_out", "boolean")
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("n_bytes", "long")):
        schema = schema.add(name, kind)
    score = _score_block(depth, sizes["n"] or 0, sizes["v"])

    def of_block(streams: pa.Table, told: pa.Table) -> pa.Table:
        return score(pa.concat_tables([_table(rows) for rows in streams["rows"]]), told)

    scored = blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(of_block, schema)
    return scored.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).drop("n_bytes")
