"""Column helpers that fix how missing values behave.

Every helper returns a plain Spark column, so the work stays in generated JVM code.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_column(value: Column | str) -> Column:
    """A column as it is, or a column by name."""
    return value if isinstance(value, Column) else F.col(value)


def is_in(col: Column | str, values) -> Column:
    """Membership test that is false, not unknown, for NULL."""
    values = list(values)
    known = [v for v in values if v is not None]
    col = as_column(col)
    test = F.coalesce(col.isin(known), F.lit(False)) if known else F.lit(False)
    return test | col.isNull() if None in values else test


def not_in(col: Column | str, values) -> Column:
    """Exclusion test that keeps NULL rows."""
    return ~is_in(col, values)


def if_else(test: Column, yes, no) -> Column:
    """Two-way choice; an unknown test gives NULL."""
    return F.when(test, yes).when(~test, no)


def row_sum(*cols: Column | str) -> Column:
    """Sum across columns with NULL skipped; all NULL gives 0."""
    return reduce(add, [F.coalesce(as_column(c), F.lit(0)) for c in cols])


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns with NULL skipped; all NULL gives NULL, never NaN."""
    present = reduce(add, [as_column(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(row_sum(*cols).cast("double"), present)


def row_max(*cols: Column | str) -> Column:
    """Largest value across columns with NULL skipped; all NULL gives NULL."""
    cols = [as_column(c) for c in cols]
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def flag(test: Column) -> Column:
    """A condition as 1.0 / 0.0, NULL where it is unknown."""
    return test.cast("double")


def number(col: Column | str) -> Column:
    """Text to double; anything that is not a number gives NULL."""
    col = as_column(col)
    return F.when(col.rlike(NUMBER_TEXT), F.trim(col).try_cast("double"))


def number_to_text(col: Column | str) -> Column:
    """Whole number to text without an exponent."""
    return as_column(col).cast("bigint").cast("string")


def trimmed(col: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(as_column(col), r"^\s+|\s+$", "")


def count_distinct(col: Column | str, where: Column | None = None, count_na: bool = False) -> Column:
    """Distinct values, optionally only where a condition holds.

    ``count_na=True`` lets a missing value, or a row whose condition is unknown,
    count once as a value of its own.
    """
    col = as_column(col)
    counted = col if where is None else F.when(where, col)
    result = F.count_distinct(counted)
    if not count_na:
        return result
    missing = col.isNull() if where is None else where.isNull() | (where & col.isNull())
    return result + F.coalesce(F.max(missing.cast("int")), F.lit(0))
