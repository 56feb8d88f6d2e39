"""Code normalisation and value recoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.missing import as_column, is_in

KEEP = object()


def keep_last(col: Column | str, width: int, pad: str = "0") -> Column:
    """Pad on the left and keep the last ``width`` characters."""
    return F.right(F.concat(F.lit(pad * width), as_column(col)), F.lit(width))


def replace_prefix(col: Column | str, prefix: str) -> Column:
    """Overwrite as many leading characters as ``prefix`` has; shorter text is left alone."""
    return F.regexp_replace(as_column(col), "^" + "." * len(prefix), prefix)


def recode(col: Column | str, rules, otherwise=KEEP) -> Column:
    """First matching rule wins; each rule is ``(values, replacement)``.

    Unmatched values stay as they are, or become ``otherwise``. NULL matches only a
    rule that lists ``None``.
    """
    col = as_column(col)
    result = F
    for values, replacement in rules:
        result = result.when(is_in(col, values), F.lit(replacement))
    return result.otherwise(col if otherwise is KEEP else F.lit(otherwise))


def lookup(col: Column | str, entries: dict) -> Column:
    """Value of a short literal dictionary; an unknown or NULL key gives NULL."""
    pairs = [F.lit(part) for entry in entries.items() for part in entry]
    return F.try_element_at(F.create_map(*pairs), as_column(col))
