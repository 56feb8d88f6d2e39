"""Records of delimited files whose quoted fields hold line breaks, each file read by many tasks.

Whether a line break ends a record depends on all quotes before it in the file. So files are scanned
as lines twice: first the quotes of each block are counted and the counts added up along the
file, which tells for each block whether it begins within quotes; then each task puts the lines of its blocks
together, knowing where the first true record begins. What a record leaves in several
blocks comes together by one small shuffle of pieces, and only where there are such records.

Lines end in ``\\n`` or ``\\r\\n``. Quotes stand around whole fields and are doubled within them. A file whose
quotes do not close is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Encodings in which a line feed is one byte, so that files can be cut at any.
SPLITTABLE = ("UTF-8", "US-ASCII", "ISO-8859-1")

# What a task has put together: a whole record, or what a record left in one block.
WHOLE, HEAD, TAIL, INNER = range(4)


def _block() -> Column:
    return F.concat_ws("#", F.col("__start").cast("string"), F.col("__path"))


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    scan = spark.read.option("lineSep", "\n").text(paths)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    place = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")]
    lines = scan.select(value.alias("value"), F.col("_metadata.file_name").alias("__file"), *place)
    return lines.withColumn("__quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))


def _assemble(leading: dict[str, int], inside: set[str]):
    """Task function: records and pieces of records. ``inside`` names the blocks that begin within quotes."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, file, skip, is_open, head, held = None, None, 0, False, False, []

        def made(values: list[str], kinds: list[int]) -> pd.DataFrame:
            return pd.DataFrame({"value": values, "__file": file, "__path": block[1], "__start": block[0], "__kind": kinds})

        for batch in batches:
            change = (batch["__path"] != batch["__path"].shift()) | (batch["__start"] != batch["__start"].shift())
            edges = [*np.flatnonzero(change.to_numpy()).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                part = batch.iloc[a:b]
                own = (int(part["__start"].iloc[0]), part["__path"].iloc[0])
                if own != block:
                    if held:
                        yield made(["\n".join(held)], [INNER if head else TAIL])
                    block, file, held = own, part["__file"].iloc[0], []
                    head = is_open = f"{own[0]}#{own[1]}" in inside
                    skip = leading[own[1]] if own[0] == 0 else 0
                values, quotes = part["value"].tolist()[skip:], part["__quotes"].to_numpy()[skip:]
                skip -= min(skip, len(part))
                after = (int(is_open) + np.cumsum(quotes)) % 2
                ends = np.flatnonzero(after == 0)
                is_open = bool(after[-1]) if len(after) else is_open
                if not len(ends):
                    held += values
                    continue
                first = ends[0] + 1
                out = ["\n".join([*held, *values[:first]])]
                if len(ends) == ends[-1] - ends[0] + 1:  # all others are of one line
                    out += values[first : ends[-1] + 1]
                else:
                    out += ["\n".join(values[i + 1 : j + 1]) for i, j in zip(ends, ends[1:])]
                yield made(out, [HEAD if head else WHOLE, *[WHOLE] * (len(out) - 1)])
                held, head = values[ends[-1] + 1 :], False
        if held:
            yield made(["\n".join(held)], [INNER if head else TAIL])

    return records


def quoted_records(spark: SparkSession, paths: list[str], leading: dict[str, int], encoding: str) -> DataFrame:
    """One row (value, __file) for each record of the files after their ``leading`` lines, line breaks in quotes as ``\\n``.

    ``leading`` is by the path that a scan names. The quotes are counted when the table is built; the driver gets
    the names of blocks that begin or end within quotes.
    """
    lines = _lines(spark, paths, encoding)
    along = W.partitionBy("__path").orderBy("__start")
    counts = lines.groupBy("__path", "__start").agg(F.sum("__quotes").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(along)).withColumn("last", F.lead("__start").over(along).isNull())
    begins, ends = (F.col("upto") - F.col("n")) % 2 == 1, F.col("upto") % 2 == 1
    found = upto.where(begins | ends).select("__path", _block().alias("block"), begins.alias("begins"), "last", ends.alias("ends"))
    inside, touched = set(), []
    for r in found.toLocalIterator():
        if r["last"] and r["ends"]:
            raise ValueError(f"an open quote in {r['__path']}")
        touched.append(r["block"])
        if r["begins"]:
            inside.add(r["block"])
    schema = "value string, __file string, __path string, __start long, __kind int"
    clean = F.rtrim(F.replace("value", F.lit("\r\n"), F.lit("\n")), F.lit("\r")).alias("value")
    whole = lines.mapInPandas(_assemble(leading, inside), schema).where(F.col("__kind") == WHOLE).select(clean, "__file")
    if not touched:
        return whole
    pieces = lines.where(_block().isin(touched)).mapInPandas(_assemble(leading, inside), schema).where(F.col("__kind") != WHOLE)
    # A record begins with a tail; what follows up to the next tail goes on with it. At most two pieces of a block.
    in_order = W.partitionBy("__path").orderBy("__start", F.col("__kind") == TAIL).rowsBetween(W.unboundedPreceding, 0)
    numbered = pieces.withColumn("__record", F.count_if(F.col("__kind") == TAIL).over(in_order))
    parts = F.sort_array(F.collect_list(F.struct("__start", "value")))
    joined = numbered.groupBy("__path", "__record").agg(F.first("__file").alias("__file"), F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined.select(clean, "__file"))
