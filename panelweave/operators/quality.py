"""Measure and remove records that contradict each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelweave.operators.joins import keyed_join, salts_of_counts
from panelweave.sources.tables import reused


def percent(part: Column | str, whole: Column | str, rounding: Callable[[Column, int], Column] = F.round) -> Column:
    """``100 * part / whole`` to two places, NULL when the whole is 0; ``rounding`` may be :func:`round_nearest`."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return rounding(F.try_divide(100 * part, whole), 2)


def _low(attr: str) -> str:
    return f"__low_{attr}"


def _high(attr: str) -> str:
    return f"__high_{attr}"


def _ranges(attrs: list[str]) -> list[Column]:
    return [f(a).alias(n(a)) for a in attrs for f, n in ((F.min, _low), (F.max, _high))]


def attribute_conflict_profile(df: DataFrame, entity: str, attrs: list[str], by: str) -> DataFrame:
    """Per ``by``: rows, rows whose entity has several values of each attribute, and percent.

    Columns: ``by``, ``total_rows``, ``<attr>_conflict``, ``<attr>_pct``. Rows are first
    counted per distinct combination, so an entity reaches the window with one row per
    ``by`` value however many records it has. More than one distinct value is the same
    as smallest < largest, which needs no set of values.
    """
    combos = df.groupBy(entity, by, *[a for a in attrs if a not in (entity, by)]).agg(F.count("*").alias("__n"))
    per_period = combos.groupBy(entity, by).agg(F.sum("__n").alias("__n"), *_ranges(attrs))
    whole = W.partitionBy(entity)
    flags = {f"__several_{a}": F.min(_low(a)).over(whole) < F.max(_high(a)).over(whole) for a in attrs}
    counts = (
        per_period.withColumns(flags)
        .groupBy(by)
        .agg(
            F.sum("__n").alias("total_rows"),
            *[
                F.coalesce(F.sum(F.when(F.col(f"__several_{a}"), F.col("__n"))), F.lit(0)).alias(f"{a}_conflict")
                for a in attrs
            ],
        )
    )
    return counts.withColumns({f"{a}_pct": percent(f"{a}_conflict", "total_rows") for a in attrs})


def consistent_entities(df: DataFrame, entity: str, attrs: list[str]) -> DataFrame:
    """Entities with exactly one known value of every attribute, one row each: one aggregate, merged before its shuffle."""
    single = reduce(and_, [F.col(_low(a)) == F.col(_high(a)) for a in attrs])
    return df.groupBy(entity).agg(*_ranges(attrs)).where(single).select(entity)


def drop_conflicting_entities(
    df: DataFrame, entity: str, attrs: list[str], salts: Column | None = None, deal: list[str] | None = None
) -> DataFrame:
    """Keep the rows of entities with exactly one known value of every attribute.

    An entity whose attribute is always NULL goes too.
    """
    return keyed_join(df, consistent_entities(df, entity, attrs), [entity], "left_semi", salts, deal=deal)


def key_multiplicity_profile(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per ``by`` (one of ``keys``): distinct keys, keys seen more than once, and percent."""
    if by not in keys:
        raise ValueError(f"{by!r} must be one of the keys")
    per_key = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    counts = per_key.groupBy(by).agg(
        F.count("*").alias("total_keys"), F.count_if(F.col("__n") > 1).alias("repeated_keys")
    )
    return counts.withColumn("repeated_pct", percent("repeated_keys", "total_keys"))


def keep_singleton_keys(df: DataFrame, keys: list[str], deal: list[str] | None = None) -> DataFrame:
    """Drop every row of a key that occurs more than once; none of its rows is kept.

    Keys are counted first, by a hash aggregate over the key columns alone, and the repeated ones
    are written down (when the query is built), so that Spark knows how many they are: few of
    them it sends to the rows, which then stay where they are read; many meet the rows in a shuffle, in which the
    counts tell the hot ones. ``deal`` is as in :func:`keyed_join`.
    """
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__n"))
    repeated = reused(counts.where("__n > 1"))
    return keyed_join(df, repeated, keys, "left_anti", salts_of_counts(repeated, keys, "__n"), deal=deal)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each row once, as ``distinct``, for tables of wide rows with few copies.

    Rows are counted by a fingerprint of 128 bits. Rows whose fingerprint is theirs alone stay where
    they are read; the others are compared in full, so that equal fingerprints of different rows do
    no harm. Where the repeated fingerprints are few, only copies are shuffled. The fingerprints are written
    down when the query is built. Columns of map type cannot be compared and are refused by Spark.
    """
    marks = ("__mark_a", "__mark_b")
    columns = [F.col(f"`{c}`") for c in df.columns]
    # A hash passes over NULLs, so which columns are NULL is hashed beside the values.
    nulls = [c.isNull() for c in columns]
    marked = df.withColumns({m: F.xxhash64(F.lit(i), *columns, *nulls) for i, m in enumerate(marks)})
    counts = marked.groupBy(*marks).agg(F.count("*").alias("__n"))
    repeated = reused(counts.where("__n > 1"))
    salts = salts_of_counts(repeated, list(marks), "__n")
    alone = keyed_join(marked, repeated, list(marks), "left_anti", salts, deal=list(marks))
    several = keyed_join(marked, repeated, list(marks), "left_semi", salts, deal=list(marks))
    return alone.drop(*marks).unionByName(several.drop(*marks).distinct())
