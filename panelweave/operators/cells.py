"""Roll a panel up to cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.exact import exact_sum
from panelweave.functions.missing import as_column, flag
from panelweave.operators.joins import keyed_join


@dataclass(frozen=True)
class Metric:
    """One result column of :func:`panel_cells`; build it with the functions below."""

    name: str
    kind: str
    value: Column | None = None
    count_na: bool = False


def entities(name: str, where: Column | None = None, count_na: bool = False) -> Metric:
    """Distinct entities in the cell, or those with a row for which ``where`` holds."""
    return Metric(name, "entities", where, count_na)


def total(name: str, value: Column | str) -> Metric:
    """Sum with NULL skipped; 0 when nothing is known."""
    return Metric(name, "total", as_column(value))


def mean(name: str, value: Column | str) -> Metric:
    """Mean with NULL skipped."""
    return Metric(name, "mean", as_column(value))


def share(name: str, condition: Column) -> Metric:
    """Share of rows meeting a condition among the rows where it is known."""
    return Metric(name, "mean", flag(condition))


def derived(name: str, value: Column) -> Metric:
    """Expression over cell keys and metrics listed before it."""
    return Metric(name, "derived", value)


def panel_cells(df: DataFrame, keys: list[str], entity: str, metrics: list[Metric], exact: bool = False) -> DataFrame:
    """One row per cell with the listed metrics, in order.

    Rows are first reduced to one per (cell, entity), then to one per cell. Distinct
    counts become plain counts, all metrics share one scan, and the rows of a large cell
    spread over tasks by entity. ``exact`` makes totals and means the same for any order of
    rows, to the last digit, as doubles.

    An exact sum takes some hundred bytes for each group until it is a double again. So exact totals and means go straight
    from rows to cells, each task with a group for each cell instead of each entity; beside counts of
    entities they are an aggregate of their own.
    """
    stored = [(i, m) for i, m in enumerate(metrics) if m.kind != "derived"]
    first, second, straight = [], [], []
    hit, unknown = (lambda i: f"__hit_{i}"), (lambda i: f"__unknown_{i}")
    for i, m in stored:
        if m.kind == "entities":
            met = F.lit(True) if m.value is None else m.value
            if m.value is not None:
                first += [F.max(met).alias(hit(i)), F.max(met.isNull()).alias(unknown(i))]
                met, missing = F.col(hit(i)), F.col(unknown(i))
            else:
                missing = F.lit(False)
            result = F.count_if(met & F.col(entity).isNotNull())
            if m.count_na:
                none = missing | (F.coalesce(met, F.lit(False)) & F.col(entity).isNull())
                result = result + F.max(none.cast("int"))
        elif exact:
            known = exact_sum(m.value)
            known = F.coalesce(known, F.lit(0)) if m.kind == "total" else F.try_divide(known, F.count(m.value))
            straight.append(known.alias(m.name))
            continue
        else:
            first.append(F.sum(m.value).alias(f"__sum_{i}"))
            result = F.sum(f"__sum_{i}")
            if m.kind == "total":
                result = F.coalesce(result, F.lit(0))
            else:
                first.append(F.count(m.value).alias(f"__count_{i}"))
                result = F.try_divide(result.cast("double"), F.sum(f"__count_{i}"))
        second.append(result.alias(m.name))
    sums = df.groupBy(*keys).agg(*straight) if straight else None
    if second or sums is None:
        per_entity = df.groupBy(*keys, entity).agg(*(first or [F.count("*").alias("__n")]))
        cells = per_entity.groupBy(*keys).agg(*second)
        if sums is not None:
            cells = keyed_join(cells, sums, keys, salts=False) if keys else cells.crossJoin(sums)
    else:
        cells = sums
    for m in metrics:
        if m.kind == "derived":
            cells = cells.withColumn(m.name, m.value)
    return cells.select(*keys, *[m.name for m in metrics])
