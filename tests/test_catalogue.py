"""Every query with SQL gives the rows that SQL gives."""

import math
import os

import duckdb
import pytest

from gridspan.plans import case_queries, catalogue, order_queries, stream_queries, tile_queries, volume_queries  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir():
    # A larger table shows halves and ties that a small one has not.
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(None if v is None else f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in (row[i] for i in order)) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, sf_dir, sql, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cursor = sql.execute(catalogue.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.collect()]
    want = cursor.fetchall()
    a, b = plain(got, df.columns), plain(want, names)
    differing = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    assert len(a) == len(b) > 0
    assert not differing, (len(differing), differing[:3])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
