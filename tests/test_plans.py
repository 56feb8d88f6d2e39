"""What the plans of selected queries read, and how often."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR, queries
from panelweave.operators.joins import key_salts, keyed_join

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="supplied tables are not here")


def scans(spark, name, table):
    """(columns, pushed filters) of each scan of a table in a query's plan before it runs; equal scans count each time."""
    plan = queries()[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(rf"FileScan parquet \[[^\]]*\][^\n]*{table}\.parquet[^\n]*", plan)
    return [(re.search(r"ReadSchema: struct<(.*?)>", s)[1], re.search(r"PushedFilters: \[(.*?)\]", s)[1]) for s in found]


def columns(schema):
    return set(re.findall(r"(\w+):", schema))


def test_composition_reads_what_it_needs_and_pushes_its_filter(spark):
    found = scans(spark, "composition", "orders")
    assert found
    for schema, pushed in found:
        assert columns(schema) <= {"o_custkey", "o_orderpriority", "o_totalprice"}
        assert "GreaterThan(o_totalprice,2000.0)" in pushed


def test_no_more_reads_than_needed(spark):
    found = [columns(s) for s, _ in scans(spark, "first_activity", "orders")]
    assert {frozenset(c) for c in found} == {
        frozenset({"o_custkey"}),  # the sketch
        frozenset({"o_custkey", "o_orderdate"}),
        frozenset({"o_custkey", "o_orderdate", "o_orderkey"}),
    }
    events = [columns(s) for s, _ in scans(spark, "left_join_facts", "events")]
    assert sum("event_id" in c for c in events) == 1


def test_as_many_keys_as_partitions_can_be_hot(spark):
    """1500 keys that each hold more than one of 2000 partitions' share of the rows are all split."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        left = spark.range(150_000).select((F.col("id") % 1500).alias("k"), "id")
        found = spark.range(1).select(key_salts(left, ["k"]).alias("m")).first()["m"]
        assert len(found) == 1500 and min(found.values()) >= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dealing_by_named_columns_gives_the_same_rows(spark, collect):
    left = spark.range(4000).select((F.col("id") % 3).alias("k"), "id", F.lit("x").alias("c"))
    right = spark.createDataFrame([(0, "a"), (2, "b")], "k long, c string")
    named = keyed_join(left, right, ["k"], deal=["id", "c"])
    assert collect(named) == collect(keyed_join(left, right, ["k"]))
