"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import BROADCAST_ROWS, Stages


def components(links: DataFrame, stages: Stages, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links``.

    Each round hangs the neighbours of a node under the least of them; a node's rows meet
    only in minima, which merge before the shuffle. Rounds end when no link changes, after
    a number that grows with the logarithm of the longest path.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    edges = stages.write(_down(links), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if state[0] > BROADCAST_ROWS:
            both = both.hint("merge")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stages.write(_down(small.unionByName(lower.withColumnRenamed("m", "v"))), "edges")
        stages.drop(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stages.unsent(stages.write(hung.unionByName(tops), "components"))


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the links; equal states are taken as equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
