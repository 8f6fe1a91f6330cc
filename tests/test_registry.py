"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math

import pytest

duckdb = pytest.importorskip("duckdb")
from factgraph import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels embeddings conversations events orders nation".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in registry.ORACLE:
        rel = con.sql(registry.ORACLE[name])
        names = list(rel.columns)
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
