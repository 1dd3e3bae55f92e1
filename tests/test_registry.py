"""Registered queries against their SQL in DuckDB.

A cross-section runs by default; set LOGWEIR_ALL_QUERIES=1 for every query.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from logweir.plans import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "conversations")
QUICK = (
    "parse_all", "parse_documents", "route_fanout", "forward_truncated",
    "jsonl_documents", "filter_combined", "page_forward_summary", "search_numbered",
    "segments_exact", "stored_tail", "log_chain_all", "chain_tail", "grid_view_local", "completeness",
    "completeness_batches",
)
NAMES = sorted(registry.queries()) if os.environ.get("LOGWEIR_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracles.sql())
    assert set(registry.queries()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry_points.queries()[name](spark, SF)
    want = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r) for r in got.collect()]
    assert normal(got.columns, rows) == normal(names, want.fetchall())
