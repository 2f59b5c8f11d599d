"""Every query against its SQL, and those without SQL against plain versions, on the smallest tables."""

import decimal
import os

import brute
import duckdb
import pytest

import __spark_entry__ as entry
from engram.embed import HashingEmbedder, with_embeddings
from engram.session import read_table

CORE = [n for n in entry.queries() if n not in (dict(entry.llm_queries.QUERIES) if entry.llm_queries else {})]


def _norm(rows):
    return sorted(repr(tuple(float(x) if isinstance(x, decimal.Decimal) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tables}/{f}'")
    return con


def compare(spark, tables, duck, name):
    df = entry.queries()[name](spark, tables)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert _norm(got) == _norm([tuple(r[names.index(c)] for c in cols) for r in found.fetchall()])


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_sql(spark, tables, duck, name):
    compare(spark, tables, duck, name)


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p6_found"])
def test_brute(spark, tables, name):
    got = [tuple(r) for r in entry.queries()[name](spark, tables).collect()]
    want = getattr(brute, name.split("_")[0])(tables)
    assert len(got) == len(set(got)) and set(got) == want


def test_tree_paths(spark, tables):
    rows = entry.queries()["p2_tree"](spark, tables).collect()
    want = {x[:4]: x[4:] for x in brute.p2(tables)}
    for r in rows:
        assert (r.root_id, r.depth) == want[r.origin, r.project_id, r.source_uri, r.node_id]
        if r.depth >= 0:
            path = r.path.split("/")
            assert len(path) == r.depth + 1 and path[0] == r.root_id and path[-1] == r.node_id
    assert sum(r.descendants for r in rows) == sum(max(r.depth, 0) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_embed_documents(spark, tables):
    rows = entry.queries()["embed_documents"](spark, tables).collect()
    assert rows and {r.dim for r in rows} == {5} and {x for r in rows for x in (r.v0, r.v1, r.v2, r.v3, r.v4)} == {0, 1}
    texts = read_table(spark, tables, "documents").where("text is not null").select("doc_id", "text")
    vectors = [r.embedding for r in with_embeddings(texts, HashingEmbedder(64)).collect()]
    assert vectors and {len(v) for v in vectors} == {64} and {round(sum(x * x for x in v), 3) for v in vectors} <= {0.0, 1.0}
