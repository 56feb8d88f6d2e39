"""Descriptive tables: group differences, composition shares, distinct entities.

Report rows carry ``row_no`` (and ``part_no`` once stacked) because row order has no
meaning in Spark. Every table is one aggregate over the panel plus work on a few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.exact import exact_deviation, exact_mean
from panelweave.functions.missing import is_in, row_sum


@dataclass(frozen=True)
class Variable:
    """A reported value, as a column or as SQL text, with its label and section."""

    value: Column | str
    label: str
    section: str | None = None

    @property
    def column(self) -> Column:
        return F.expr(self.value) if isinstance(self.value, str) else self.value


def pick(value: Column, group: str, level) -> Column:
    """Aggregate that takes one level's value out of a grouped result."""
    return F.max(F.when(F.col(group) == F.lit(level), value))


def group_difference_table(
    df: DataFrame, group: str, levels: dict[str, object], variables: list[Variable], minuend: str, exact: bool = False
) -> DataFrame:
    """Per variable: mean of two levels, their difference and its standard error.

    ``levels`` maps two result column names to group values; ``diff`` is the ``minuend``
    column less the other. Means and deviations skip NULL, the standard error divides by
    all rows of the level. All variables share one scan and one partial aggregation. ``exact``
    makes them the same for any order of rows.
    """
    if len(levels) != 2 or minuend not in levels:
        raise ValueError("give two levels and name one of them as minuend")
    subtrahend = next(name for name in levels if name != minuend)
    aggregates = [F.count("*").alias("__n")]
    averaged, spread = (exact_mean, exact_deviation) if exact else (F.avg, F.stddev_samp)
    for i, v in enumerate(variables):
        aggregates += [averaged(v.column).alias(f"__mean_{i}"), spread(v.column).alias(f"__sd_{i}")]
    grouped = df.where(F.col(group).isin(list(levels.values()))).groupBy(group).agg(*aggregates)

    rows = [
        F.struct(
            F.lit(i + 1).alias("row_no"),
            F.lit(v.section).cast("string").alias("section"),
            F.lit(v.label).alias("variable"),
            F.col(f"__mean_{i}").cast("double").alias("mean"),
            (F.col(f"__sd_{i}") * F.col(f"__sd_{i}") / F.col("__n")).alias("error"),
        )
        for i, v in enumerate(variables)
    ]
    long = grouped.select(F.col(group).alias("__level"), F.inline(F.array(*rows)))
    picks = [pick(F.col("mean"), "__level", value).alias(name) for name, value in levels.items()]
    errors = [pick(F.col("error"), "__level", value) for value in levels.values()]
    wide = long.groupBy("row_no", "section", "variable").agg(*picks, F.sqrt(errors[0] + errors[1]).alias("se_diff"))
    return wide.withColumn("diff", F.col(minuend) - F.col(subtrahend)).select(
        "row_no", "section", "variable", *levels, "diff", "se_diff"
    )


def composition_table(
    df: DataFrame, group: str, levels: dict[str, object], parts: list[Variable], where: Column | None = None
) -> DataFrame:
    """Per part: its share of the parts' total in each level, one column per level.

    ``where`` filters rows before the sums. Shares of a level add up to 1; they are NULL
    where the total is 0.
    """
    rows = df if where is None else df.where(where)
    names = [f"__part_{i}" for i in range(len(parts))]
    sums = (
        rows.where(is_in(group, levels.values()))
        .groupBy(group)
        .agg(*[F.coalesce(F.sum(p.column), F.lit(0)).alias(n) for n, p in zip(names, parts)])
        .withColumn("__total", row_sum(*names).cast("double"))
    )
    shares = sums.select(group, *[F.try_divide(F.col(n).cast("double"), F.col("__total")).alias(n) for n in names])
    long = shares.unpivot([group], names, "__part", "__share")
    wide = long.groupBy("__part").pivot(group, list(levels.values())).agg(F.first("__share"))
    wide = wide.toDF("__part", *levels)
    facts = {
        "row_no": {n: i + 1 for i, n in enumerate(names)},
        "section": {n: p.section for n, p in zip(names, parts)},
        "variable": {n: p.label for n, p in zip(names, parts)},
    }

    def from_part(values: dict) -> Column:
        pairs = [F.when(F.col("__part") == n, F.lit(v)) for n, v in values.items() if v is not None]
        return F.coalesce(*pairs) if pairs else F.lit(None).cast("string")

    return wide.select(*[from_part(v).alias(c) for c, v in facts.items()], *levels)


def distinct_entity_row(
    df: DataFrame,
    entity: str,
    group: str,
    levels: dict[str, object],
    label: str,
    section: str | None = None,
    count_na: bool = False,
) -> DataFrame:
    """One report row: distinct entities per level; difference and error are missing.

    ``count_na=True`` adds one to each level when the group, or the entity inside the
    level, is missing somewhere.
    """
    pairs = df.select(group, entity).distinct()
    counts = []
    for name, value in levels.items():
        inside = F.col(group) == F.lit(value)
        n = F.count_if(inside & F.col(entity).isNotNull())
        if count_na:
            n = n + F.coalesce(F.max((F.col(group).isNull() | (inside & F.col(entity).isNull())).cast("int")), F.lit(0))
        counts.append(n.cast("double").alias(name))
    missing = F.lit(None).cast("double")
    return pairs.agg(*counts).select(
        F.lit(1).alias("row_no"),
        F.lit(section).cast("string").alias("section"),
        F.lit(label).alias("variable"),
        *levels,
        missing.alias("diff"),
        missing.alias("se_diff"),
    )


def stack_report(*parts: DataFrame) -> DataFrame:
    """Stack report parts by name in the given order; a column a part lacks is NULL."""
    numbered = [p.withColumn("part_no", F.lit(i + 1)) for i, p in enumerate(parts)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return stacked.select("part_no", *[c for c in stacked.columns if c != "part_no"])


def present(
    table: DataFrame, digits: int = 2, titles: dict[str, str] | None = None, rounding: Callable[[Column, int], Column] = F.round
) -> DataFrame:
    """Round the numbers for reading, as :func:`round_nearest` if told so, and give columns their display titles."""
    rounded = {c: rounding(F.col(f"`{c}`"), digits) for c, kind in table.dtypes if kind in ("double", "float")}
    return table.withColumns(rounded).withColumnsRenamed(titles or {})
