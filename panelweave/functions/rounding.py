"""Rounding as published tables round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.missing import as_column

#: From here on a double has no digits after the point.
WHOLE_FROM = float(1 << 52)


def round_nearest(value: Column | str, digits: int = 2) -> Column:
    """Round to the nearest double that has ``digits`` decimal places; of two equally near, to that of even last digit.

    Both neighbours are made as doubles and the nearer one to the value itself is taken, so 0.15 becomes
    0.1 and 2.675 becomes 2.67, as their doubles lie below the decimal texts, and 0.125 becomes 0.12.
    Half-up rounding (``F.round``) gives 0.2, 2.68 and 0.13. Signs do not matter. NULL, NaN and
    infinities stay, and so do numbers too large to have such digits.
    """
    if digits < 0:
        raise ValueError("digits before the point are not rounded")
    value = as_column(value).cast("double")
    scale = F.lit(10.0**digits)
    size = F.abs(value)
    fits = size * scale < WHOLE_FROM  # false for NaN and infinities too
    scaled = F.when(fits, size * scale).otherwise(0.0)
    low, high = F.floor(scaled), F.ceil(scaled)
    below, above = low.cast("double") / scale, high.cast("double") / scale
    down, up = size - below, above - size
    near = F.when((down < up) | ((down == up) & (low % 2 == 0)), below).otherwise(above)
    return F.when(fits, F.when((value < 0) & (near > 0), -near).otherwise(near)).otherwise(value)
