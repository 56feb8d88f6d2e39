"""Keep the entities seen in every period, and report what balancing did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.missing import count_distinct
from panelweave.functions.periods import period_number
from panelweave.operators.joins import keyed_join, salts_of_counts


#: Periods that one word of an entity's bitmap holds.
WORD = 64


def presence(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Which periods each entity has, as bitmaps: columns ``entity``, ``__word``, ``__other``, ``__bits`` and ``__n`` (rows).

    A period's number gives its word and its bit there; bits merge with OR, in the map tasks
    first, so an entity reaches the shuffle with one row for each word of 64 periods. Periods without a number have a row
    each (``__other``), unknown ones a row with neither.
    """
    number = period_number(period, df.schema[period].dataType)
    other = F.col(f"`{period}`")
    if number is None:
        numbered = df.select(entity, F.lit(None).cast("long").alias("__number"), other.alias("__other"))
    else:
        numbered = df.select(entity, number.alias("__number"), other.alias("__other"))
        numbered = numbered.withColumn("__other", F.when(F.col("__number").isNull(), F.col("__other")))
    word, bit = F.expr(f"__number div {WORD} - cast(__number % {WORD} < 0 as long)"), F.expr(f"shiftleft(1L, cast(pmod(__number, {WORD}) as int))")
    return numbered.groupBy(entity, word.alias("__word"), "__other").agg(F.bit_or(bit).alias("__bits"), F.count("*").alias("__n"))


def _periods(count_na: bool) -> Column:
    """Periods of a group of :func:`presence` rows of which no two share a word."""
    one = F.when(F.col("__word").isNotNull(), F.bit_count("__bits")).when(F.col("__other").isNotNull(), 1).otherwise(int(count_na))
    return F.coalesce(F.sum(one), F.lit(0))


def _entities(df: DataFrame, entity: str, period: str, length: int | None, count_na: bool) -> tuple[DataFrame, Column]:
    """(entity, __periods, __n) of all entities, and the number of periods that a balanced one has."""
    seen = presence(df, entity, period)
    if length is None:
        whole = seen.where("__n > 0").groupBy("__word", "__other").agg(F.bit_or("__bits").alias("__bits"))
        target = whole.agg(_periods(count_na).alias("n")).scalar()
    else:
        target = F.lit(length)
    return seen.groupBy(entity).agg(_periods(count_na).alias("__periods"), F.sum("__n").alias("__n")), target


def balanced_entities(
    df: DataFrame, entity: str, period: str, length: int | None = None, count_na: bool = False
) -> DataFrame:
    """Entities with as many distinct periods as the panel has, or as ``length`` says."""
    entities, target = _entities(df, entity, period, length, count_na)
    return entities.where((F.col("__periods") == target) & (F.col("__n") > 0)).select(entity)


def balance_panel(
    df: DataFrame,
    entity: str,
    period: str,
    length: int | None = None,
    count_na: bool = False,
    salts: Column | None = None,
    deal: list[str] | None = None,
) -> DataFrame:
    """Rows of the entities that appear in every period.

    The panel length is computed, or given as ``length``. One aggregate gives each entity's bitmap of periods, the
    panel's own, and the numbers of rows by which hot entities are split in the join back.
    """
    entities, target = _entities(df, entity, period, length, count_na)
    kept = entities.where((F.col("__periods") == target) & (F.col("__n") > 0)).select(entity)
    if salts is None:
        # The same columns as ``kept`` reads, so that Spark makes the aggregate once.
        salts = salts_of_counts(entities.where("__periods >= 0 AND __n > 0"), [entity], "__n")
    return keyed_join(df, kept, [entity], "left_semi", salts, deal=deal)


def balance_check(df: DataFrame, entity: str, by: str, name: str = "entities", count_na: bool = False) -> DataFrame:
    """Distinct entities per ``by``."""
    return df.groupBy(by).agg(count_distinct(entity, count_na=count_na).alias(name))


def retention(balanced: DataFrame, unbalanced: DataFrame) -> DataFrame:
    """One row: rows kept, rows before, and their ratio."""
    kept = balanced.agg(F.count("*").alias("kept_rows")).withColumn("all_rows", F.lit(0).cast("bigint"))
    before = unbalanced.agg(F.count("*").alias("all_rows")).withColumn("kept_rows", F.lit(0).cast("bigint"))
    sums = kept.unionByName(before).agg(F.sum("kept_rows").alias("kept_rows"), F.sum("all_rows").alias("all_rows"))
    return sums.withColumn("retained", F.try_divide("kept_rows", "all_rows"))
