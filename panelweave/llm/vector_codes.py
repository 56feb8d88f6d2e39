"""Product-quantised codes of vectors with exact integer arithmetic.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook
that a few rounds of assignment and averaging refine. All distances are exact: a dot product of
integers is taken limb by limb. Numbers are split into limbs of so few bits that a float64 BLAS product of two
limb matrices stays below 2 ** 53, where every whole number is a float64; the products are shifted
and added up in int64. |x - c|^2 = |x|^2 - 2 x.c + |c|^2, and the first least distance wins a tie.
Results therefore do not depend on BLAS, on the order of rows or on partitions.

Rows are coded where they lie. A round sends the codebooks out, at most ``entries`` vectors, and each task sends
back one sum for each component of an entry, which are added up in Spark.

Vectors that are NULL or hold NULL, NaN or infinite components are dropped. NULL ids are coded but start no entry
while there are ids; of rows with equal ids the lesser vector comes first. NULL labels count as one label. Fewer
rows than ``entries`` give as many entries as rows. An empty table has no codes. Vectors of unequal
lengths, lengths that parts do not divide, and components so large that a distance leaves 64 bits are refused.
Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages
from panelweave.operators.joins import keyed_join

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows whose distances to all entries are held at once.
ROWS_TOGETHER = 2048


def limb_bits(length: int) -> int:
    """Bits of a limb: sums of ``length`` products of two limbs stay below 2 ** 53."""
    return (53 - max(length - 1, 0).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 limbs, the lowest first; all but the last are in 0 to 2 ** bits - 1, the last has the sign."""
    out, rest = [], values
    while True:
        if not len(rest) or np.abs(rest).max(initial=0) < 1 << bits:
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits


def exact_dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 matrices, exact as long as the dot products themselves fit in int64."""
    bits = limb_bits(x.shape[1])
    total = np.zeros((len(x), len(c)), np.int64)
    of_c = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(of_c):
            if bits * (i + j) < 64:  # beyond, only zeros are shifted in: the whole sum is taken modulo 2 ** 64
                total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def check_range(length: int, *tables: np.ndarray) -> None:
    """Refuse numbers so large that a squared distance of ``length`` components may leave int64."""
    largest = sum(max(int(t.max(initial=0)), -int(t.min(initial=0))) for t in tables)
    if length * largest * largest >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit distances")


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest row of ``c`` for each row of ``x``, and the squared distance."""
    check_range(x.shape[1], x, c)
    far = (c * c).sum(axis=1) - 2 * exact_dots(x, c)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without NULLs as a matrix."""
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) != 1:
        raise ValueError(f"vectors have different lengths: {lengths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(lengths[0]))


def whole_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``whole``, the components times ``scale`` rounded down, of the rows whose vector is complete."""
    ids, label = rows.schema["vec_id"], rows.schema["label"]
    schema = f"vec_id {ids.dataType.simpleString()}, label {label.dataType.simpleString()}, whole array<long>"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            filled = lists.flatten()
            real = np.asarray(filled.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64)
            # Parts of a row that are no finite number; rows without components have none.
            sizes = np.diff(lists.offsets.to_numpy())
            wrong = np.bincount(np.repeat(np.arange(len(lists)), sizes), ~np.isfinite(real), len(lists)) > 0
            inside = np.repeat(~wrong, sizes)
            scaled = np.floor(np.where(inside, real, 0.0) * scale)
            if np.abs(scaled).max(initial=0) >= 1 << 62:
                raise ValueError("components are too large for exact 64-bit distances")
            whole = scaled.astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            made = pa.ListArray.from_arrays(offsets, pa.array(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["vec_id", "label", "whole"]).filter(pa.array(~wrong))

    kept = rows.where(F.col(vector).isNotNull()).select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector"))
    return kept.mapInArrow(convert, schema)


def _coded(books: list[np.ndarray]):
    """Task helper: entry indexes and distances by part of a matrix of whole vectors."""

    def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.shape[1] != sum(b.shape[1] for b in books):
            raise ValueError(f"vectors have different lengths: {x.shape[1]}, {sum(b.shape[1] for b in books)}")
        at, far = [], []
        for k, book in enumerate(books):
            own = x[:, k * book.shape[1] : (k + 1) * book.shape[1]]
            found = [nearest(own[i : i + ROWS_TOGETHER], book) for i in range(0, len(own), ROWS_TOGETHER)]
            at.append(np.concatenate([f[0] for f in found]))
            far.append(np.concatenate([f[1] for f in found]))
        return np.stack(at, axis=1), np.stack(far, axis=1)

    return code


def _sums(books: list[np.ndarray]):
    """Task function: how many parts each entry got, and their sums by component; one set of rows for each task."""
    width, code = books[0].shape[1], _coded(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(books), len(books[0]))
        counts, sums = np.zeros(shape, np.int64), np.zeros((*shape, width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(0))
            at, _ = code(x)
            for k in range(len(books)):
                np.add.at(counts[k], at[:, k], 1)
                np.add.at(sums[k], at[:, k], x[:, k * width : (k + 1) * width])
        part, entry = np.nonzero(counts)
        if len(part):
            place = np.tile(np.arange(width), len(part))
            values = [np.repeat(part, width), np.repeat(entry, width), place, np.repeat(counts[part, entry], width), sums[part, entry].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values], ["part", "entry", "place", "n", "total"])

    return add


def codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The refined codebooks of ``whole`` (vec_id, label, whole; a written table), one matrix for each part position.

    On the driver: ``entries`` vectors and their sums, whatever the number of rows.
    """
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    if not first:
        return []
    lengths = {len(r["whole"]) for r in first}
    if len(lengths) != 1 or min(lengths) % parts or not min(lengths):
        raise ValueError(f"vectors of lengths {sorted(lengths)} cannot be cut into {parts} equal parts")
    books = np.split(np.array([r["whole"] for r in first], np.int64), parts, axis=1)
    for _ in range(rounds):
        partial = whole.select("whole").mapInArrow(_sums(books), "part long, entry long, place long, n long, total long")
        sums = partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [b.copy() for b in books]
        for r in sums.collect():
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def encode(whole: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of every row of ``whole``."""
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    digits = np.array([f"{i:02x}" for i in range(max(map(len, books), default=0))], object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coded(books)
        for batch in batches:
            if len(batch):
                at, far = code(_matrix(batch.column(2)))
                said = digits[at].sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return whole.select("vec_id", "label", "whole").mapInArrow(assign, schema)


def vector_codes(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of the label) and codebooks_sha256 of every complete row."""
    stages = Stages(rows.sparkSession, "vector-codes")
    whole = stages.write(whole_vectors(rows, vector, scale), "whole")
    books = codebooks(whole, parts, entries, rounds)
    coded = stages.write(encode(whole, books), "codes")
    stages.drop(whole)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = keyed_join(coded, by_label, ["label"], "inner", deal=["vec_id"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
