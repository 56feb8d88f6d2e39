"""Sums of doubles that do not depend on the order of rows, as aggregate columns.

A double is cut into whole-number limbs of 32 bits, from 2 ** 84 down to 2 ** -96, each with the value's sign. Limbs are
summed as whole numbers, which is exact however rows are grouped, and only the totals become one
double again. So tasks, partitions and shuffles leave no trace in the last digits.

Parts of a value below 2 ** -96 are cut off. A group with a value of 2 ** 84 or more, with an infinity or a
NaN, falls back to the plain sum. NULL is skipped; nothing known gives NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.missing import as_column

BITS = 32
#: Limbs below one, and the size from which a value has more than the others hold.
BELOW = 3
TOO_LARGE = 2.0**84

_LIMB, _SUM = "decimal(18,0)", "decimal(38,0)"


def _limbs(value: Column) -> list[Column]:
    """The value's limbs as signed whole numbers, the highest first; the second one counts ones."""
    size = F.when(F.abs(value) < TOO_LARGE, F.abs(value)).otherwise(0.0)
    base = float(1 << BITS)
    limbs = [F.floor(size / base)]
    rest = size - limbs[0].cast("double") * base
    for k in range(BELOW + 1):
        limbs.append(F.floor(rest))
        if k < BELOW:
            rest = (rest - limbs[-1].cast("double")) * base
    return [F.when(value < 0, -limb).otherwise(limb).cast(_LIMB) for limb in limbs]


def _joined(totals: Column) -> Column:
    """One double from the sums of limbs (fields ``s0``, ``s1`` ...)."""
    base = F.lit(1 << BITS).cast(_LIMB)

    def carried(sums: list[Column]) -> tuple[Column, list[Column]]:
        """Ones as a whole number, and the limbs below them from 0 to 2 ** 32 - 1."""
        low, carry = [], F.lit(0).cast(_SUM)
        for total in reversed(sums[2:]):
            total = (total + carry).cast(_SUM)
            rest = F.pmod(total, base).cast(_LIMB)
            carry = F.floor(((total - rest).cast(_SUM) / base).cast("decimal(38,6)")).cast(_SUM)
            low.insert(0, rest)
        return (sums[0] * base + sums[1] + carry).cast(_SUM), low

    def as_double(sums: list[Column]) -> Column:
        ones, low = carried(sums)
        parts = [limb.cast("double") * 2.0 ** (-BITS * (k + 1)) for k, limb in enumerate(low)]
        return ones.cast("double") + reduce(lambda a, b: b + a, reversed(parts))

    sums = [totals[f"s{k}"] for k in range(BELOW + 2)]
    # A negative sum is made of its opposite, or a small one would drown in its carry.
    return F.when(carried(sums)[0] < 0, -as_double([(-s).cast(_SUM) for s in sums])).otherwise(as_double(sums))


def exact_sum(value: Column | str) -> Column:
    """Aggregate: the sum of the known values, the same for every order of rows."""
    value = as_column(value).cast("double")
    sums = [F.coalesce(F.sum(limb), F.lit(0)).cast(_SUM).alias(f"s{k}") for k, limb in enumerate(_limbs(value))]
    plain = F.coalesce(F.max(F.isnan(value) | (F.abs(value) >= TOO_LARGE)), F.lit(False))
    joined = F.get(F.transform(F.array(F.struct(*sums)), _joined), F.lit(0))
    return F.when(F.count(value) == 0, F.lit(None).cast("double")).when(plain, F.sum(value)).otherwise(joined)


def exact_mean(value: Column | str) -> Column:
    """Aggregate: the mean of the known values; NULL without any."""
    value = as_column(value).cast("double")
    return F.try_divide(exact_sum(value), F.count(value))


def exact_deviation(value: Column | str) -> Column:
    """Aggregate: the sample standard deviation of the known values, NULL for fewer than two.

    It comes from the sums of values and of squares, so it keeps about 16 digits less twice those by which
    the mean exceeds the deviation.
    """
    value = as_column(value).cast("double")
    n, total = F.count(value), exact_sum(value)
    spread = exact_sum(value * value) - total * total / n
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1)))
