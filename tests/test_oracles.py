"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from cairn import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, float) else v if isinstance(v, (bool, str)) else float(v) if hasattr(v, "__float__") else v


#: Queries that SQL can't express in reasonable time; the other modules here hold them against plain versions.
WITHOUT_SQL = {
    "k_core", "linkage_matches", "linkage_clusters", "linkage_proposals", "cut_points", "bridges", "community_hierarchy",
    "platt_calibration", "permutation_test", "bootstrap_interval", "topic_map", "inverted_file_topk",
}


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    answer = sql.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    theirs = sorted((tuple(plain(dict(zip(columns, r, strict=True))[n]) for n in names) for r in answer.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-3 for x, y in zip(a, b, strict=True)), (a, b)
