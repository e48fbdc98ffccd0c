"""The driver contract, and registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# a spread of operators; ATLASLEDGER_ALL=1 compares every query that has SQL
SPREAD = [
    "composition_hash", "lod_pyramid", "version_groups", "composition_diff", "map_versions",
    "nearest_version", "area_document", "late_tile_sweep", "zone_panel", "event_log_batches",
]
QUERIES, SQL = contract.queries(), contract.oracle_sql()
CHOSEN = sorted(SQL) if os.environ.get("ATLASLEDGER_ALL") else SPREAD


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = contract.entry(spark)
    assert {"map_id", "build_id", "group_no"} <= set(out.columns) and not out.isEmpty()


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, sf, tables, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    cursor = tables.execute(SQL[name])
    named = [c[0] for c in cursor.description]
    assert sorted(named) == columns
    want = [dict(zip(named, row)) for row in cursor.fetchall()]
    left = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    right = sorted(repr([plain(r[c]) for c in columns]) for r in want)
    assert left == right
