"""Every named query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

from rasterlab.plans import catalog
from tools.check_queries import TABLES, canonical, close, sort_key


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(canonical(r[c]) for c in cols) for r in df.collect()), key=sort_key)
    if name not in catalog.ORACLES:
        return
    rel = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(canonical(r[i]) for i in at) for r in rel.fetchall()), key=sort_key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(close(a, b) for a, b in zip(g, w)), (g, w)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
