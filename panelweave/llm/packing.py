"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces of documents are dealt to partitions of bounded size. Each partition is packed by best-fit
decreasing and gets a lower bound on its number of sequences from dual-feasible functions.
Where the two agree, the partition is certified optimal. Partitions with a gap give up their
emptiest sequences; these pieces are dealt anew, packed again, and so on until no gap is left,
a round saves nothing, or ``rounds`` are over. A round's packing takes the place of the one
before it only where it needs fewer sequences.

NULL text is empty; an empty document is its end token alone. Rows with equal ids are packed each
for itself. An empty table packs into no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import Stages
from panelweave.llm.tokenizer import byte_bpe, vocabulary_path

CAPACITY = 1024
END_ID = 2
#: Pieces that one partition packs; a partition's memory and time follow from it.
PARTITION_PIECES = 50_000
ROUNDS = 4


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) into pieces of at most ``capacity`` ids; only the first of a document may be shorter.

    Columns: doc_id, piece, start, length, ids_crc32, and ``row``, a number of its own for each piece.
    """
    path = path or vocabulary_path()
    schema = T.StructType([docs.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("row", "long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, row = byte_bpe(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(bpe.ids(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), row))
                    row += 1
            yield pd.DataFrame(out, columns=schema.names)

    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the fullest bin that still takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    some = 0  # bit r: a bin with r free is open
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            at = open_bins[free].pop()
            if not open_bins[free]:
                some ^= 1 << free
        else:
            free, at = capacity, count
            count += 1
        bins[i], offsets[i] = at, capacity - free
        open_bins[free - need].append(at)
        some |= 1 << (free - need)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of several dual-feasible functions, in whole numbers."""
    sizes, counts = np.unique(lengths.astype(np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 33):  # rounds each length to parts of a bin
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    for least in sizes[2 * sizes <= capacity]:  # long lengths need a bin each, those below ``least`` count for nothing
        value = np.where(sizes > capacity - least, capacity, np.where(sizes >= least, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    return best


def _pack_partition(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(filled) - lower_bound(lengths, capacity)
        emptiest = np.empty(len(filled), np.int64)
        emptiest[np.argsort(filled, kind="stable")] = np.arange(len(filled))
        # A bin is given up when it is among the emptiest, twice as many as the gap and one more.
        given = emptiest[bins] < (2 * gap + 1 if gap > 0 else 0)
        return rows.assign(bin=bins, offset=offsets, bins=len(filled), gap=gap, given=given)

    return pack


def pack_pieces(cut: DataFrame, stages: Stages, capacity: int = CAPACITY, per_partition: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces (``row`` and ``length`` are needed); ``cut`` must be a written table."""
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long"))
    waiting = cut.where(F.col("length") < capacity)
    columns = cut.columns
    schema = T.StructType([*cut.schema.fields]).add("part", "long").add("bin", "long").add("offset", "long").add("bins", "long").add("gap", "long").add("given", "boolean")
    done, before = [whole], None
    for turn in range(rounds):
        parts = max(1, -(-waiting.count() // per_partition))
        dealt = waiting.select(*columns, F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)).alias("part"))
        packed = stages.write(dealt.groupBy("part").applyInPandas(_pack_partition(capacity), schema), f"packed-{turn}")
        named = packed.withColumn("sequence_id", F.lit(turn << 56) + F.col("part") * (1 << 24) + F.col("bin"))
        # Bins by partition are bounded: one row of counts comes back.
        used = packed.groupBy("part").agg(F.max("bins").alias("bins"), F.max("gap").alias("gap")).agg(F.sum("bins"), F.sum("gap")).first()
        if before is not None and (used[0] or 0) >= before[0]:
            done.append(before[1])  # nothing saved: the given bins stay as they were
            return _union(done, columns)
        kept, given = named.where(~F.col("given")), named.where("given")
        done.append(kept)
        if turn == rounds - 1 or parts == 1 or not used[1]:
            done.append(given)
            return _union(done, columns)
        bins = given.select("sequence_id").distinct().count()
        before, waiting = (bins, given), given
    return _union(done, columns)


def _union(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    first, *more = [t.select(*columns, "sequence_id", "offset") for t in tables]
    for t in more:
        first = first.unionByName(t)
    return first


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, per_partition: int = PARTITION_PIECES) -> DataFrame:
    """Pieces of ``docs`` with the sequence each lies in and its offset there; other columns are left out."""
    stages = Stages(docs.sparkSession, "packing")
    return pack_pieces(stages.write(pieces(docs, path, capacity), "pieces"), stages, capacity, per_partition).drop("row")
