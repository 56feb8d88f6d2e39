"""Operators that add or recode columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions import codes
from panelweave.functions.missing import row_max, trimmed
from panelweave.operators.joins import keyed_join


def upper_case_names(df: DataFrame) -> DataFrame:
    """Upper-case every column name."""
    return df.toDF(*[c.upper() for c in df.columns])


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names in which a case-insensitive pattern is found."""
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def across(df: DataFrame, pattern: str, fn: Callable[[Column], Column], name: str = "{col}") -> DataFrame:
    """Apply ``fn`` to every matching column, naming results by ``name``."""
    return df.withColumns({name.format(col=c): fn(F.col(c)) for c in matching(df, pattern)})


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Drop the columns whose name ends with ``suffix``."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def zero_fill(df: DataFrame, pattern: str) -> DataFrame:
    """Replace NULL by 0 in the matching columns."""
    return df.fillna(0, subset=matching(df, pattern))


def recode(df: DataFrame, column: str, rules, otherwise=codes.KEEP, name: str | None = None) -> DataFrame:
    """Recode one column by first matching rule (see :func:`panelweave.functions.codes.recode`)."""
    return df.withColumn(name or column, codes.recode(column, rules, otherwise))


def earliest_dates(df: DataFrame, entity: str, date: str, name: str | None = None) -> DataFrame:
    """Earliest known date per entity, one row each."""
    return df.groupBy(entity).agg(F.min(date).alias(name or date))


def add_years_since(df: DataFrame, year: str, since: dict[str, str]) -> DataFrame:
    """For each (new column, date column), ``year`` less the date's calendar year."""
    return df.withColumns({name: F.col(year) - F.year(date) for name, date in since.items()})


def first_activity(
    df: DataFrame,
    entity: str,
    date: str,
    year: str,
    born: str | None = None,
    first: str | None = None,
    tenure: str = "tenure",
    age: str = "age",
    salts: Column | None = None,
    deal: list[str] | None = None,
) -> DataFrame:
    """Earliest date per entity on every row, with tenure and age as calendar-year differences.

    The earliest date replaces ``date`` unless ``first`` names another column. Only one
    aggregated row per entity is joined back; no entity's rows are gathered in one task.
    """
    name = first or date
    earliest = earliest_dates(df, entity, date, name)
    dated = keyed_join(df.drop(name), earliest, [entity], "left", salts, deal=deal)
    dated = dated.select(*(df.columns if name in df.columns else dated.columns))
    return add_years_since(dated, year, {tenure: name} | ({age: born} if born else {}))


def split_labels(df: DataFrame, column: str, sep: str, n: int, keep: bool = False) -> DataFrame:
    """Split text on a regex into ``<column>_1 .. _n``, trimmed; extra parts go, missing are NULL."""
    parts = F.split(F.col(column), sep, n + 1)
    out = df.withColumns({f"{column}_{i + 1}": trimmed(F.get(parts, F.lit(i))) for i in range(n)})
    return out if keep else out.drop(column)


def ordinal_from_labels(
    df: DataFrame,
    column: str,
    sep: str,
    n: int,
    dictionary: dict[str, str],
    levels: list[str],
    rank: str = "rank",
    label: str = "level",
    keep: bool = False,
) -> DataFrame:
    """Split a label list, map each label to an ordered level and keep the highest.

    Adds ``<column>_1 .. _n``, an integer ``rank`` from 1 and the level's ``label``; both
    are NULL when no label is known.
    """
    out = split_labels(df, column, sep, n, keep)
    position = {level: i + 1 for i, level in enumerate(levels)}
    ranks = {text: position[level] for text, level in dictionary.items()}
    best = row_max(*[codes.lookup(f"{column}_{i + 1}", ranks) for i in range(n)])
    out = out.withColumn(rank, best)
    return out.withColumn(label, F.get(F.array(*[F.lit(v) for v in levels]), F.col(rank) - 1))
