"""Report how completely tables link, and assemble the linked panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.missing import as_column
from panelweave.functions.periods import days_in_month, period_start
from panelweave.operators.columns import zero_fill
from panelweave.operators.joins import grid_join, key_salts, keyed_join, several_key_salts
from panelweave.operators.quality import percent


@dataclass(frozen=True)
class Link:
    """A table to left-join on ``keys``; a joined row is matched where ``probe`` is known."""

    name: str
    table: DataFrame
    keys: tuple[str, ...]
    probe: str


def link_coverage(base: DataFrame, links: list[Link], by: str, both: str | None = None) -> DataFrame:
    """Per ``by``: rows after left-joining every link, rows matched per link, and percent.

    Columns: ``by``, ``total_rows``, then ``<link>`` and ``<link>_pct``; ``both`` names a
    further pair for rows matched by every link. Repeated keys fan out in the counts as
    they would in the joins, but no joined row is ever made: both sides shrink to counts
    per key, and the size of each key's fan-out is the product of its counts.
    """
    keys = list(dict.fromkeys([by, *[k for link in links for k in link.keys]]))
    exact = [i for i, link in enumerate(links) if set(link.keys) == set(keys)]
    rows, known = (lambda i: f"__rows_{i}"), (lambda i: f"__known_{i}")

    # Links on the whole key need no join: stack base and links, add up counts per key.
    columns = ["__n", *[f(i) for i in exact for f in (rows, known)]]
    zeros = {c: F.lit(0).cast("bigint") for c in columns}

    def tagged(table: DataFrame, ones: dict[str, Column]) -> DataFrame:
        values = {**zeros, **ones}
        return table.select(*keys, *[values[c].cast("bigint").alias(c) for c in columns])

    stacked = tagged(base, {"__n": F.lit(1)})
    for i in exact:
        known_here = F.col(links[i].probe).isNotNull().cast("int")
        stacked = stacked.unionByName(tagged(links[i].table, {rows(i): F.lit(1), known(i): known_here}))
    counts = stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns]).where("__n > 0")

    # Where a link's key and ``by`` make up the whole key, a link key has one row of counts for each ``by``.
    rest = [i for i in range(len(links)) if i not in exact]
    wide = [i for i in rest if {by, *links[i].keys} != set(keys)]
    measured = dict(zip(wide, several_key_salts(base, [list(links[i].keys) for i in wide]))) if wide else {}
    for i in rest:
        link = links[i]
        per_key = link.table.groupBy(*link.keys).agg(F.count("*").alias(rows(i)), F.count(link.probe).alias(known(i)))
        counts = keyed_join(counts, per_key, list(link.keys), "left", measured.get(i, False), deal=keys)
        counts = counts.fillna(0, subset=[rows(i), known(i)])

    def fan_out(matched: set[int]) -> Column:
        factors = [
            F.col(known(i)) if i in matched else F.greatest(F.col(rows(i)), F.lit(1)) for i in range(len(links))
        ]
        return F.sum(reduce(lambda a, b: a * b, factors, F.col("__n")))

    named = {link.name: {i} for i, link in enumerate(links)}
    if both:
        named[both] = set(range(len(links)))
    result = counts.groupBy(by).agg(
        fan_out(set()).alias("total_rows"), *[fan_out(which).alias(name) for name, which in named.items()]
    )
    ordered = [c for name in named for c in (name, f"{name}_pct")]
    return result.withColumns({f"{name}_pct": percent(name, "total_rows") for name in named}).select(
        by, "total_rows", *ordered
    )


@dataclass(frozen=True)
class Fact:
    """A table with the base's grain, joined ``inner`` or ``left``, less the ``drop`` columns.

    ``few`` says that no key has many rows in it, which spares looking for keys that are hot on both sides of a join.
    """

    table: DataFrame
    how: str = "left"
    drop: tuple[str, ...] = ()
    few: bool = False


@dataclass(frozen=True)
class Dim:
    """A descriptive table with one or few rows per key."""

    table: DataFrame
    keys: tuple[str, ...]


def join_facts(base: DataFrame, facts: list[Fact], keys: list[str], salts: Column | bool | None = None) -> DataFrame:
    """Join every fact to ``base`` on one shared key. ``salts`` is ``False`` where no key has many rows in ``base``.

    Facts share the key, so they are joined to each other first and meet the large base
    in a single shuffle. Without an inner fact the left joins run one after another. Facts whose
    keys may repeat are joined cell by cell of a grid, as a key may be hot on both sides.
    """
    if any(f.how not in ("inner", "left") for f in facts):
        raise ValueError("a fact is joined 'inner' or 'left'")

    def joined(panel: tuple[DataFrame, bool], fact: tuple[DataFrame, bool], how: str) -> tuple[DataFrame, bool]:
        (left, left_few), (right, right_few) = panel, fact
        if not right_few:
            return grid_join(left, right, keys, how), False
        return keyed_join(left, right, keys, how, False if left_few else salts if left is base else None), left_few

    tables = [((f.table.drop(*f.drop), f.few), f.how) for f in facts]
    inner = [t for t, how in tables if how == "inner"]
    left = [t for t, how in tables if how == "left"]
    start = (base, salts is False)
    if not inner:
        salts = key_salts(base, keys) if salts is None and any(f.few for f in facts) else salts
        return reduce(lambda panel, t: (keyed_join(panel[0], t[0], keys, "left", salts), panel[1]) if t[1] else joined(panel, t, "left"), left, start)[0]
    merged = reduce(lambda a, b: joined(a, b, "inner"), inner)
    merged = reduce(lambda a, b: joined(a, b, "left"), left, merged)
    return joined(start, merged, "inner")[0]


def join_dims(panel: DataFrame, dims: list[Dim], salts: Column | None = None) -> DataFrame:
    """Inner-join descriptive tables.

    When one table's key covers every other key the tables are joined to each other first,
    so that the panel is shuffled at most once.
    """
    widest = max(dims, key=lambda d: len(d.keys))
    if all(set(d.keys) <= set(widest.keys) for d in dims):
        rest = [d for d in dims if d is not widest]
        merged = reduce(lambda a, d: keyed_join(a, d.table, list(d.keys), "inner", salts=False), rest, widest.table)
        return keyed_join(panel, merged, list(widest.keys), "inner", salts)
    return reduce(lambda a, d: keyed_join(a, d.table, list(d.keys), "inner"), dims, panel)


def add_rate(df: DataFrame, name: str, part: Column | str, whole: Column | str) -> DataFrame:
    """``part / whole``, NULL when the whole is 0."""
    return df.withColumn(name, F.try_divide(as_column(part).cast("double"), as_column(whole)))


def assemble_panel(
    base: DataFrame,
    facts: list[Fact],
    keys: list[str],
    dims: list[Dim],
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    zero: str | None = None,
    period: str | None = None,
    month_days: str | None = None,
    rate: tuple[str, str] | None = None,
    fact_salts: Column | bool | None = None,
    dim_salts: Column | None = None,
) -> DataFrame:
    """Entity-by-month panel from a base, facts on its key and descriptive tables.

    ``prepare`` runs after the facts (code normalisation), ``zero`` is a name pattern whose
    NULLs become 0, ``month_days`` receives the month length of the ``MMYY`` column
    ``period``, after zero-filling, and ``rate`` is (new column, numerator) over it.
    """
    panel = join_facts(base, facts, keys, fact_salts)
    if prepare is not None:
        panel = panel.transform(prepare)
    if dims:
        panel = join_dims(panel, dims, dim_salts)
    if zero:
        panel = zero_fill(panel, zero)
    if month_days:
        panel = panel.withColumn(month_days, days_in_month(period_start(period)))
    if rate:
        panel = add_rate(panel, rate[0], rate[1], month_days)
    return panel
