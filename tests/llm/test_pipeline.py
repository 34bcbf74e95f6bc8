"""The pipeline and the queries of this part."""

import os

import pytest

import corpus_pipeline
from vellum.llm import common, queries


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, sf), "test")
        out.append(docs)
    return out


def test_stages(stages):
    given, clean, lines, unique, mixed, encoded = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "mixing", "bpe"]
    assert all(s.columns == given.columns for s in stages[:-1])
    assert clean.count() > 0.8 * given.count()
    assert lines.where("text = ''").count() <= given.where("text = ''").count()
    assert unique.count() == unique.select("doc_id").distinct().count() <= lines.count()
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in unique.select("doc_id").collect()}
    assert encoded.count() == mixed.count()


def test_stages_equal_brute_force(stages):
    from tests.llm.test_text_operators import brute_components, brute_passages

    _, clean, lines, unique, *_ = [s.select("doc_id", "text").orderBy("doc_id").collect() for s in stages[:-1]]
    want = [(r.doc_id, t) for r, (t, n) in zip(clean, brute_passages([r.text for r in clean])) if n == 0 or t]
    assert [(r.doc_id, r.text) for r in lines] == want
    component, _ = brute_components([r.text for r in lines])
    assert [r.doc_id for r in unique] == [lines[i].doc_id for i in sorted(set(component))]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in order]).fetchall()))
