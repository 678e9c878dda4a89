"""Every core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lectern.plans import registry


@pytest.fixture(scope="module")
def con(tiny):
    con = duckdb.connect()
    for f in Path(tiny).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, float) else int(value) if isinstance(value, int | bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, tiny, con, name):
    df = registry.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    ref = con.sql(registry.SQL[name])
    assert sorted(ref.columns) == columns
    at = [ref.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in ref.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_context_whole_is_uncut(spark, tiny):
    rows = registry.QUERIES["context_whole"](spark, tiny).collect()
    texts = {(r["chunk_id"], r["content"]) for r in spark.read.parquet(f"{tiny}/refined_document_chunks.parquet").select("chunk_id", "content").collect()}
    assert all((r["id"], r["content"]) in texts for r in rows) and max(len(r["content"]) for r in rows) > 500
    bm25 = {(r["qid"], r["id"]) for r in registry.QUERIES["context_numbering"](spark, tiny).collect()}
    assert bm25 < {(r["qid"], r["id"]) for r in rows}
