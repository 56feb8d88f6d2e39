"""Period text (``MMYY``) and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.missing import as_column

# Fixed value: two-digit years from here on belong to the 1900s when a date is parsed.
TWO_DIGIT_YEAR_PIVOT = 69


def leading_date(col: Column | str) -> Column:
    """Parse ``d/m/yyyy`` at the start of a text, ignoring what follows; else NULL."""
    text = F.regexp_substr(as_column(col), F.lit(r"^\d{1,2}/\d{1,2}/\d{4}"))
    return F.try_to_date(text, "d/M/yyyy")


def period_in_text(col: Column | str) -> Column:
    """First run of four digits in a text, NULL when there is none."""
    return F.regexp_substr(as_column(col), F.lit(r"\d{4}"))


def period_year(mmyy: Column | str) -> Column:
    """Calendar year of an ``MMYY`` period, always in the 2000s."""
    return F.concat(F.lit("20"), F.substring(as_column(mmyy), 3, 2)).try_cast("int")


def period_start(mmyy: Column | str) -> Column:
    """First day of an ``MMYY`` period; an impossible month gives NULL."""
    mmyy = as_column(mmyy)
    year = F.substring(mmyy, 3, 2)
    century = F.when(year.try_cast("int") >= TWO_DIGIT_YEAR_PIVOT, "19").otherwise("20")
    return F.try_to_date(F.concat(F.lit("01"), F.substring(mmyy, 1, 2), century, year), "ddMMyyyy")


def days_in_month(day: Column | str) -> Column:
    """Length of the month a date falls in, leap years included."""
    return F.dayofmonth(F.last_day(as_column(day)))


def period_of(day: Column | str) -> Column:
    """``MMYY`` text of a date or zone-free timestamp."""
    day = as_column(day)
    return F.concat(F.lpad(F.month(day).cast("string"), 2, "0"), F.right(F.year(day).cast("string"), F.lit(2)))


def period_number(period: str, kind: T.DataType) -> Column | None:
    """A whole number for each period, near for periods that are near; NULL where a text has none.

    Different periods have different numbers. ``MMYY`` texts are months in a row, dates are months in a row for each day of the
    month, other texts of up to 17 digits are told apart by their length too. Other types
    have no number (``None``).
    """
    col = F.col(f"`{period}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return col.cast("long")
    if isinstance(kind, T.DateType):
        return (F.dayofmonth(col) - 1).cast("long") * (1 << 20) + F.year(col) * 12 + F.month(col)
    if isinstance(kind, T.StringType):
        month = F.left(col, F.lit(2)).try_cast("long") - 1 + 12 * F.right(col, F.lit(2)).try_cast("long")
        digits = F.concat(F.lit("1"), col).try_cast("long")
        return F.when(col.rlike(r"\A(0[1-9]|1[0-2])[0-9]{2}\z"), month - 1200).when(col.rlike(r"\A[0-9]{1,17}\z"), digits)
    return None
