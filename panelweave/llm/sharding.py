"""Shards of equal row counts by a Feistel permutation of global row numbers.

Rows are numbered 0 to N - 1 in the order of their values, so the numbers depend on the rows alone and
not on files, partitions or retries. A keyed permutation of these numbers is the shuffle: row ``r`` goes to place
``P(r)``, which is shard ``P(r) % shards``, slot ``P(r) // shards``. Nothing is stored: the place of a row
follows from its number, and the row of a place from the inverse.

``P`` is a generalised Feistel network on pairs (x, y) of a times b values, a and b about the root of N:
each round adds to one half a hash of the other, modulo the half's size. Places of N and above are walked on:
the network is applied again until the place is below N. Fewer than a numbers lie there, so a
walk has fewer than a steps, and hardly any row walks at all. Round hashes are MD5, which every engine has.

Equal rows merge before they are numbered and are dealt out again afterwards, in pieces, so a row that
a third of the table repeats is no one's burden. Ranges of the sorted rows are numbered by
themselves and moved on by the counts of the ranges before them.

Every column may be NULL (NULL sorts first); repeated rows get numbers of their own; an empty table has no
shards. Columns of any name are carried along; the new ones have the names that the caller gives. Columns
of map type have no order and are refused by Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, let, whole_number

ROUNDS = 6
SEED = 20240229
#: Rows that one range holds about, while there are no more ranges than the most; a task sorts one range.
RANGE_ROWS = 25_000
MOST_RANGES = 10_000
#: Copies of a row that one task deals out.
COPIES = 100_000
#: Steps of a walk that are tried before the longest possible walk is.
SHORT_WALK = 8


def halves(n: int) -> tuple[int, int]:
    """Sizes a, b of the two halves: a * b is n or more, by less than a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _hash(half: Column, turn: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed, round and half in decimal."""
    said = F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), half.cast("string"))
    return F.conv(F.left(F.md5(said.cast("binary")), F.lit(15)), 16, 10).cast("long")


def _network(value: Column, n: int, seed: int, back: bool) -> Column:
    """The network once over a * b numbers, or its inverse."""
    a, b = halves(n)
    wide, sign = whole_number(b), -1 if back else 1
    start = F.struct(F.floor(value / b).cast("long").alias("x"), F.pmod(value, wide).alias("y"))

    def step(pair: Column, turn: Column) -> Column:
        x = F.pmod(pair["x"] + sign * F.pmod(_hash(pair["y"], turn, seed), whole_number(a)), whole_number(a))
        y = F.pmod(pair["y"] + sign * F.pmod(_hash(pair["x"], turn, seed), wide), wide)
        even = turn % 2 == 0
        return F.struct(F.when(even, x).otherwise(pair["x"]).alias("x"), F.when(even, pair["y"]).otherwise(y).alias("y"))

    turns = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, turns)), start, step, lambda pair: pair["x"] * b + pair["y"])


def _permuted(value: Column, n: int, seed: int, back: bool) -> Column:
    a, b = halves(n)
    most = a * b - n  # numbers beyond n, each of which a walk meets once at most

    def walk(at: Column, steps: int) -> Column:
        if steps < 1:
            return at
        on = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), at, lambda p, _: F.when(p >= n, _network(p, n, seed, back)).otherwise(p))
        return F.when(at >= n, on).otherwise(at)

    first = min(most, SHORT_WALK)
    return let(_network(value, n, seed, back), lambda p: let(walk(p, first), lambda q: walk(q, most - first)))


def place_of(number: Column, n: int, seed: int = SEED) -> Column:
    """The place, 0 to n - 1, of the row of this number."""
    return _permuted(number.cast("long"), n, seed, False)


def number_at(place: Column, n: int, seed: int = SEED) -> Column:
    """The number of the row at this place: the inverse of :func:`place_of`."""
    return _permuted(place.cast("long"), n, seed, True)


def numbered(rows: DataFrame, name: str, stages: Stages, range_rows: int = RANGE_ROWS, copies: int = COPIES) -> DataFrame:
    """Add the global number of each row, 0 to N - 1, in the order of all columns from left to right."""
    columns = rows.columns
    quoted = [F.col(f"`{c}`") for c in columns]
    n, part, start, copy = (f"{name}__{w}" for w in ("n", "part", "start", "copy"))
    kinds = stages.write(rows.groupBy(*quoted).agg(F.count(F.lit(1)).alias(n)), "kinds")
    ranges = min(max(1, -(-kinds.count() // range_rows)), MOST_RANGES)
    # The range of a row is written with it; ranges follow each other in the order of the rows.
    ranged = stages.write(kinds.repartitionByRange(ranges, *quoted).withColumn(part, F.spark_partition_id()), "ranged")
    stages.drop(kinds)
    # One row of counts for each range.
    totals = ranged.groupBy(F.col(part).alias(f"{part}_")).agg(F.sum(n).alias("total"))
    before = F.sum("total").over(W.orderBy(f"{part}_").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(f"{part}_", F.coalesce(before, whole_number(0)).alias(start))
    own = F.coalesce(F.sum(n).over(W.partitionBy(part).orderBy(*quoted).rowsBetween(W.unboundedPreceding, -1)), whole_number(0))
    placed = ranged.withColumn(copy, own).join(offsets, F.col(part) == F.col(f"{part}_"))
    placed = placed.select(*quoted, F.col(n), (F.col(start) + F.col(copy)).alias(start))
    once = placed.where(F.col(n) == 1).select(*quoted, F.col(start).alias(name))
    # Copies: first pieces of a bounded number of copies, dealt over the tasks, then the copies themselves.
    pieces = placed.where(F.col(n) > 1).withColumn(copy, F.explode(F.sequence(whole_number(0), F.col(n) - 1, whole_number(copies))))
    dealt = pieces.repartition(F.col(start), F.col(copy))
    last = F.least(F.col(copy) + copies, F.col(n)) - 1
    several = dealt.withColumn(n, F.explode(F.sequence(F.col(copy), last))).select(*quoted, (F.col(start) + F.col(n)).alias(name))
    return once.unionByName(several)


def shuffled_shards(rows: DataFrame, shards: int, seed: int = SEED, shard: str = "shard", slot: str = "slot", stages: Stages | None = None) -> DataFrame:
    """Every row with its shard and its slot there. Shards differ by one row at most; slots run from 0 without gaps."""
    if shards < 1:
        raise ValueError(f"{shards} shards")
    if clash := {shard, slot} & set(rows.columns):
        raise ValueError(f"the table already has columns {sorted(clash)}; name others")
    stages = stages or Stages(rows.sparkSession, "sharding")
    number = "__number"
    while number in rows.columns:
        number += "_"
    table = numbered(rows, number, stages)
    place = place_of(F.col(number), rows.count(), seed)
    return table.withColumn(number, place).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.pmod(F.col(number), whole_number(shards)).cast("int").alias(shard),
        F.floor(F.col(number) / shards).cast("long").alias(slot),
    )
