"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from panelweave.plans.ingest_queries import INGEST_QUERIES
from panelweave.plans.staff_queries import STAFF_QUERIES
from panelweave.plans.table_queries import TABLE_QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMOKE_DIR}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted({**TABLE_QUERIES, **STAFF_QUERIES, **INGEST_QUERIES}))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, SMOKE_DIR)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == ordered(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_every_query_has_a_counterpart_and_the_entry_runs(spark):
    assert {*TABLE_QUERIES, *STAFF_QUERIES, *INGEST_QUERIES} <= set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
