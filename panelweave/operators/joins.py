"""Null-safe equi-joins that stay balanced when a few keys hold most of the rows.

Before a shuffled join the left side's heaviest keys are found with a mergeable
frequent-items sketch over the key columns only. Rows of such a key are dealt over
several sub-keys and the matching right rows are repeated once per sub-key, so the
result is the same as that of the plain join while no task holds a whole hot key.
The sketch only decides how rows are spread: if it misses a key, that key is simply
joined unsplit.

Where both sides may hold many rows of one key, :func:`grid_join` lays its rows out as a grid:
left rows go to one row of cells, right rows to one column, so that every pair
meets in exactly one cell, and cells are what tasks join. The sketches also tell how many pairs there will be:
beyond one task's worth the join gets as many tasks as the pairs need, which the bytes shuffled would not show.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALT = "__salt"
RIGHT = "__right_"

# A sketch follows this many items for each key that may be hot; its counts are off by less than rows / items.
SKETCH_ITEMS_PER_KEY = 8
LEAST_SKETCH_ITEMS = 4096
SKETCH_BUCKETS = 1024
# Limits of the sketch function itself, beyond any number of partitions in use.
MOST_SKETCH_KEYS, MOST_SKETCH_ITEMS = 100_000, 1_000_000

# Cells of a grid for each partition's worth of work, so that cells dealt by hash even out, and the most cells of one key.
CELLS_PER_PARTITION = 8
MOST_CELLS = 1 << 20

# Pairs of hot keys for one task of a grid join, and the most tasks of one join.
PAIRS_PER_TASK = 1 << 28
MOST_TASKS = 20_000

# Used where the session leaves the number of shuffle partitions to the cluster.
DEFAULT_PARTITIONS = 200


#: Joins that return columns of the left side only.
KEY_ONLY = ("left_semi", "left_anti")

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _key_hash(df: DataFrame, keys: list[str]) -> Column:
    """Hash of a key that does not depend on how wide its integers are."""
    schema = df.schema
    columns = {k: F.col(f"`{k}`") for k in keys}
    wide = [c.cast("bigint") if isinstance(schema[k].dataType, INTEGRAL) else c for k, c in columns.items()]
    return F.xxhash64(*wide)


def _check_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    for k in keys:
        if k not in left.columns or k not in right.columns:
            raise ValueError(f"join key {k!r} is not on both sides")
        a, b = left.schema[k].dataType, right.schema[k].dataType
        if a != b and not (isinstance(a, INTEGRAL) and isinstance(b, INTEGRAL)):
            raise ValueError(f"join key {k!r} is {a.simpleString()} on the left and {b.simpleString()} on the right")


def _partitions(df: DataFrame) -> int:
    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return int(setting) if setting.isdigit() else DEFAULT_PARTITIONS


def _cut(share: Column, parts: int) -> Column:
    """Slices for a key with this share of all rows: about two for each partition's worth."""
    return F.least(F.ceil(share * (2 * parts)), F.lit(parts)).cast("int")


def key_salts(df: DataFrame, keys: list[str]) -> Column:
    """Map of key hash to number of slices for the hot keys of ``df``, as a scalar subquery.

    A key is hot from one partition's share of the rows on, so there are at most as many
    as partitions. One narrow pass, no shuffle of rows: each task sends one sketch, every
    bucket of tasks reports its heaviest keys, and their counts are added up. Measure once
    on a cheap table and hand the column to several operators that share the key.
    """
    return several_key_salts(df, [keys])[0]


def _sketch_size(df: DataFrame) -> tuple[int, int, int]:
    """Shuffle partitions, keys that may be hot, and items that a sketch follows."""
    parts = _partitions(df)
    return parts, min(max(parts, 64), MOST_SKETCH_KEYS), min(max(SKETCH_ITEMS_PER_KEY * parts, LEAST_SKETCH_ITEMS), MOST_SKETCH_ITEMS)


def _frequent(df: DataFrame, several: list[list[str]]) -> list[DataFrame]:
    """For each key a table (item, count): its frequent hashes, and the number of all rows beside a NULL item."""
    _, most, items = _sketch_size(df)
    all_rows = F.struct(F.lit(None).cast("bigint").alias("item"), F.col("n").alias("count"))
    hashes = df.select(*[_key_hash(df, keys).alias(f"h{i}") for i, keys in enumerate(several)], F.spark_partition_id().alias("task"))
    sketches = hashes.groupBy(F.pmod("task", F.lit(SKETCH_BUCKETS)).alias("bucket")).agg(
        F.count("*").alias("n"), *[F.expr(f"approx_top_k(h{i}, {most}, {items})").alias(f"top{i}") for i in range(len(several))]
    )
    return [
        sketches.select(F.inline(F.concat(f"top{i}", F.array(all_rows)))).groupBy("item").agg(F.sum("count").alias("count"))
        for i in range(len(several))
    ]


def several_key_salts(df: DataFrame, several: list[list[str]]) -> list[Column]:
    """:func:`key_salts` of several keys of one table, measured in one pass over it."""
    parts, most, _ = _sketch_size(df)
    found = []
    for counts in _frequent(df, several):
        heaviest = (
            counts.orderBy(F.desc("count"))
            .limit(most + 1)
            .agg(
                F.max(F.when(F.col("item").isNull(), F.col("count"))).alias("n"),
                F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "count"))).alias("top"),
            )
        )
        share = lambda key: key["count"].cast("double") / F.col("n")
        is_hot = lambda key: share(key) >= 1.0 / parts
        hot = F.transform(F.filter("top", is_hot), lambda key: F.struct(key["item"], _cut(share(key), parts)))
        found.append(heaviest.select(F.map_from_entries(hot)).scalar())
    return found


def salts_of_counts(counts: DataFrame, keys: list[str], n: str) -> Column:
    """:func:`key_salts` from a table that has one row for each key and the number of its rows.

    Where a join needs an aggregate by its key anyway, counting along spares the sketch's pass. Spark makes the
    aggregate once only if both users read the same columns of it: give each a filter over all of them.
    """
    parts = _partitions(counts)
    total = counts.agg(F.sum(n).cast("double").alias("total")).scalar()
    # At most as many keys as partitions.
    hot = counts.where(F.col(n) * parts >= total).select(_key_hash(counts, keys).alias("item"), _cut(F.col(n) / total, parts).alias("slices"))
    return hot.agg(F.map_from_entries(F.collect_list(F.struct("item", "slices"))).alias("salts")).scalar()


def _hot_on_either_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the numbers of all rows of both sides, and as ``top`` the frequent keys (item, l, r) of most pairs."""
    _, most, _ = _sketch_size(left)
    one, none = F.col("count").cast("double"), F.lit(0.0)
    both = _frequent(left, [keys])[0].select("item", one.alias("l"), none.alias("r"))
    both = both.unionByName(_frequent(right, [keys])[0].select("item", none.alias("l"), one.alias("r")))
    return (
        both.groupBy("item")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .orderBy(F.col("item").isNull().desc(), (F.greatest("l", F.lit(1.0)) * F.greatest("r", F.lit(1.0))).desc())
        .limit(2 * most + 1)
        .agg(
            F.max(F.when(F.col("item").isNull(), F.col("l"))).alias("all_l"),
            F.max(F.when(F.col("item").isNull(), F.col("r"))).alias("all_r"),
            F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "l", "r"))).alias("top"),
        )
    )


def _grids(heaviest: DataFrame, parts: int) -> Column:
    """The grids of hot keys for a join of so many tasks, from the row of :func:`_hot_on_either_side`."""
    joined = lambda key: key["l"] * F.greatest(key["r"], F.lit(1.0))
    out = F.aggregate("top", F.greatest("all_l", F.lit(1.0)), lambda sum_, key: sum_ + joined(key))
    weight = lambda key: F.greatest(
        joined(key) / F.col("out"), F.try_divide(key["l"], F.col("all_l")), F.try_divide(key["r"], F.col("all_r"))
    )
    cells = lambda key: F.least(F.ceil(weight(key) * (CELLS_PER_PARTITION * parts)), F.lit(MOST_CELLS))

    def grid(key: Column) -> Column:
        l, r = F.greatest(key["l"], F.lit(1.0)), F.greatest(key["r"], F.lit(1.0))
        columns = F.least(F.greatest(F.round(F.sqrt(cells(key) * r / l)), F.lit(1.0)), r, cells(key))
        rows = F.least(F.ceil(cells(key) / columns), l)
        return F.struct(key["item"], F.struct(F.ceil(rows).cast("int").alias("rows"), F.ceil(columns).cast("int").alias("columns")))

    is_hot = lambda key: weight(key) >= 0.5 / parts
    return heaviest.withColumn("out", out).select(F.map_from_entries(F.transform(F.filter("top", is_hot), grid))).scalar()


def grid_slices(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Map of key hash to the grid (rows, columns) of each key that is hot, as a scalar subquery.

    A key's weight is its share of the joined rows, or of the rows of one side where that is more; from half a
    partition's worth on it gets cells in proportion. Rows and columns follow the counts of
    the two sides, so that a cell takes like numbers of both and copies are fewest.
    """
    return _grids(_hot_on_either_side(left, right, keys), _partitions(left))


def _slices(salts: Column, df: DataFrame, keys: list[str]) -> Column:
    return F.coalesce(F.try_element_at(salts, _key_hash(df, keys)), F.lit(1))


def _disambiguate(left, right, keys, suffixes):
    clash = [c for c in left.columns if c in set(right.columns) - set(keys)]
    if not clash:
        return left, right
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
    )


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    salts: Column | bool | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    deal: list[str] | None = None,
) -> DataFrame:
    """Join ``left`` (many rows per key) to ``right`` (few rows per key) on equal keys.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. NULL keys match NULL keys, repeated
    keys fan out, and other columns present on both sides get ``suffixes``. No broadcast
    is forced: Spark broadcasts ``right`` only when its size is under the session's limit.
    ``salts`` may carry :func:`key_salts` measured elsewhere on the same keys, or ``False``
    where ``left`` is already reduced to few rows per key and needs no splitting.

    Rows of a hot key are dealt by the hash of the ``deal`` columns of ``left``, by default all of
    them. Name a few that tell rows apart, so that the others can be pruned from the scan.
    The hash is of values and of the task's number, never random: a task that is run again
    after a failure must deal its rows as before.

    Filter ``left`` before the join: a filter on the result still runs ahead of the shuffle,
    but the dealing of rows keeps it from moving on into the scan.
    """
    if how not in ("inner", "left", *KEY_ONLY):
        raise ValueError(f"unsupported join type: {how}")
    _check_keys(left, right, keys)
    if salts is None:
        salts = key_salts(left, keys)
    if how in KEY_ONLY:
        right = right.select(*[F.col(f"`{k}`") for k in keys])
    else:
        before = left.columns
        left, right = _disambiguate(left, right, keys, suffixes)
        deal = None if deal is None else [after for name, after in zip(before, left.columns) if name in deal]
    out = left.columns if how in KEY_ONLY else left.columns + [c for c in right.columns if c not in keys]

    carried = [F.col(f"`{c}`").alias(RIGHT + c if c in keys else c) for c in right.columns]
    on = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{RIGHT}{k}`")) for k in keys])
    if salts is not False:
        # The task number in the hash deals out rows that are copies of each other as well.
        dealing = [f for f in left.schema.fields if deal is None or f.name in deal]
        hashable = [f"`{f.name}`" for f in dealing if not isinstance(f.dataType, T.MapType)]
        dealt = F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), _slices(salts, left, keys)).cast("int")
        carried.append(F.explode(F.sequence(F.lit(0), _slices(salts, right, keys) - 1)).alias(RIGHT + SALT))
        left = left.withColumn(SALT, dealt)
        on = on & (F.col(SALT) == F.col(RIGHT + SALT))
    right = right.select(*carried)
    return left.join(right, on, how).select(*[F.col(f"`{c}`") for c in out])


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
    deal: tuple[list[str] | None, list[str] | None] = (None, None),
) -> DataFrame:
    """Join two tables of which both may hold many rows of one key; ``inner`` or ``left``.

    NULL keys match NULL keys, repeated keys fan out, clashing names get ``suffixes``. A hot key's left rows are
    dealt to the rows of its grid and repeated for each column, its right rows are dealt to
    the columns and repeated for each row: a pair meets in one cell, and no task holds
    the key. ``deal`` names the columns by whose hash the rows of each side are dealt, as in
    :func:`keyed_join`. The sketches decide the grids and the number of tasks only, never the result. They are
    taken when this is called; the join itself is lazy.

    In a ``left`` join of a key with several columns, a left row without a partner in a column says nothing
    about the others. So each row of cells also gets one mark of the key in its first
    column, where the right side has the key at all: what matches a mark, and what is unmatched in
    another column, is left out.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    _check_keys(left, right, keys)
    # The number of tasks must be known when the join is planned. Hot keys are few, so their counts are one small row.
    heaviest = _hot_on_either_side(left, right, keys)
    counts = heaviest.first()
    pairs = sum(key["l"] * key["r"] for key in counts["top"])
    tasks = min(math.ceil(pairs / PAIRS_PER_TASK), MOST_TASKS)
    parts = max(tasks, _partitions(left))
    grids = _grids(left.sparkSession.createDataFrame([counts], heaviest.schema), parts)
    before = left.columns, right.columns
    left, right = _disambiguate(left, right, keys, suffixes)
    out = left.columns + [c for c in right.columns if c not in keys]
    own = [
        None if names is None else [after for name, after in zip(old, table.columns) if name in names]
        for names, old, table in zip(deal, before, (left, right))
    ]

    def size(df: DataFrame, side: str) -> Column:
        return F.coalesce(F.try_element_at(grids, _key_hash(df, keys))[side], F.lit(1))

    def place(df: DataFrame, names: list[str] | None, side: str) -> Column:
        dealing = [f for f in df.schema.fields if names is None or f.name in names]
        hashable = [f"`{f.name}`" for f in dealing if not isinstance(f.dataType, T.MapType)]
        return F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), size(df, side)).cast("int")

    def along(df: DataFrame, side: str) -> Column:
        return F.explode(F.sequence(F.lit(0), size(df, side) - 1))

    row, column, mark = f"{SALT}_row", f"{SALT}_column", f"{SALT}_mark"
    # All that a pair must share as one value: a struct of NULLs equals another, and it is what rows are partitioned by.
    # One type on both sides, NULLs allowed, or the join would cast it and shuffle once more.
    cell, own_cell = f"{SALT}_cell", f"{RIGHT}{SALT}_cell"
    kinds = [T.LongType() if isinstance(left.schema[k].dataType, INTEGRAL) else left.schema[k].dataType for k in keys]
    kind = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*kinds, T.IntegerType(), T.IntegerType()])])

    def with_cell(df: DataFrame, name: str, prefix: str) -> DataFrame:
        shared = [F.col(f"`{prefix}{c}`").alias(f"c{i}") for i, c in enumerate([*keys, row, column])]
        df = df.withColumn(name, F.struct(*shared).cast(kind))
        # A number of partitions that is asked for is kept; adaptive execution would merge small ones, whatever their pairs.
        return df.repartition(parts, name) if tasks > 1 else df

    spread = left.select("*", place(left, own[0], "rows").alias(row), along(left, "columns").alias(column))
    carried = [F.col(f"`{c}`").alias(RIGHT + c if c in keys else c) for c in right.columns]
    place_right = place(right, own[1], "columns").alias(RIGHT + column)
    dealt = right.select(*carried, place_right, along(right, "rows").alias(RIGHT + row), F.lit(False).alias(mark))
    if how == "left":
        several = right.where(size(right, "columns") > 1).select(*keys).distinct()
        marks = several.select(*[F.col(f"`{k}`").alias(RIGHT + k) for k in keys], F.lit(0).alias(RIGHT + column), along(several, "rows").alias(RIGHT + row), F.lit(True).alias(mark))
        dealt = dealt.unionByName(marks, allowMissingColumns=True)
    joined = with_cell(spread, cell, "").join(with_cell(dealt, own_cell, RIGHT), F.col(cell) == F.col(own_cell), how)
    if how == "left":
        joined = joined.where(~F.coalesce(F.col(mark), F.col(column) > 0))
    return joined.select(*[F.col(f"`{c}`") for c in out])
