"""Queries against their SQL on tables in which urls repeat and vectors nearly do, as they do on larger tables."""

from __future__ import annotations

import pytest

duckdb = pytest.importorskip("duckdb")
from factgraph import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["dedup_semantic", "external_reference", "insert_counters", "insert_ignore", "upsert_articles", "upsert_articles_in_place"]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Every fifth page has the url of another one, an odd or an even one; every fourth vector is near the one before it."""
    at = tmp_path_factory.mktemp("repeated")
    c = duckdb.connect()
    near = "list_transform(p.embedding, lambda x, i: (x + i / 5000)::FLOAT)"
    c.execute(f"copy (select * from '{SF}/documents.parquet') to '{at}/documents.parquet'")
    c.execute(f"copy (select a.* replace (coalesce(b.url, a.url) as url) from '{SF}/pages.parquet' a left join '{SF}/pages.parquet' b on a.page_id % 5 = 0 and b.page_id = a.page_id // 2 + 1) to '{at}/pages.parquet'")
    c.execute(f"copy (select a.* replace (case when p.vec_id is null then a.embedding else {near} end as embedding) from '{SF}/embeddings.parquet' a left join '{SF}/embeddings.parquet' p on a.vec_id % 4 = 3 and p.vec_id = a.vec_id - 1) to '{at}/embeddings.parquet'")
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    assert c.execute("select count(*) - count(distinct url) from pages").fetchall()[0][0] > 3
    return str(at), c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, repeated, name):
    at, c = repeated
    df = registry.QUERIES[name](spark, at)
    names = [x[0] for x in c.execute(registry.ORACLE[name]).description]
    want = c.execute(registry.ORACLE[name]).fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
