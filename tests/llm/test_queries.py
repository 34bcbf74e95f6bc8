"""The query functions with the columns of their contracts, over a whole small table, and the pipeline's stages on odd tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import neighbours, queries, toxicity

COLUMNS = {
    "op1_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_odd_sketch_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_multiset_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5_nn_descent": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_wavelet_shards": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op13_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
}


def rows_of(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    return df.collect()


@pytest.fixture(scope="module")
def given(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1_query(spark, sf, given):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    out = rows_of(spark, sf, "op1_bpe_round_trip")
    assert {r.doc_id for r in out} == set(given)
    for r in out:
        ids = lib.encode(given[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_query(spark, sf, given):
    from tests.llm.test_text_operators import brute_components

    ids = sorted(given)
    component, _ = brute_components([given[i].text for i in ids])
    out = {r.doc_id: r for r in rows_of(spark, sf, "op2_odd_sketch_near_duplicates")}
    assert {i: out[i].component_id for i in ids} == {i: ids[c] for i, c in zip(ids, component)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.values())


def test_op3_query(spark, sf, given):
    out = {r.doc_id: r for r in rows_of(spark, sf, "op3_multiset_fingerprints")}
    ids = sorted(given, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b = given[i].text or "", given[j].text or ""
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    texts = {}
    for i, r in out.items():
        assert texts.setdefault(given[i].text or "", r.fingerprint) == r.fingerprint
    assert len(set(texts.values())) == len(texts)


def test_op5_query(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    found = {}
    for r in rows_of(spark, sf, "op5_nn_descent"):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in vectors if i % 50 == 0}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    right = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos(vectors[q], vectors[v])) < 1e-9 for _, v, s in rows)
        best = sorted(vectors.keys() - {q}, key=lambda v: -cos(vectors[q], vectors[v]))[:5]
        right += len({r[1] for r in rows} & set(best))
    assert right >= 0.9 * 5 * len(found)


def test_cosine_of_any_scale(spark):
    rows = [([1e-200] * 4, [1e-200] * 4), ([1e200, 0.0], [1e200, 1e200]), ([1e-320, 0.0], [0.0, 3.0]), ([3.0, 4.0], [4.0, 3.0])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(neighbours.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert np.allclose(got, [1.0, 0.5**0.5, 0.0, 0.96])


def test_op7_query(spark, sf, given):
    """Scores against plain loops: the network over each window by itself, and the highest counts."""
    out = {r.doc_id: r for r in rows_of(spark, sf, "op7_toxicity")}
    assert set(out) == set(given)
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    train = [(given[i].text, y) for i, y in sorted(labels.items()) if i in given and given[i].text and zlib.crc32(str(i).encode()) % 5]
    net = toxicity.train([t for t, _ in train], [y for _, y in train])
    scorer = toxicity.Scorer(net)
    texts = [given[i].text or "" for i in sorted(given)][:60]
    together = scorer.scores(texts)
    for text, score in zip(texts, together):
        words = text.split()
        alone = toxicity.Scorer(net).scores([text])[0]
        assert abs(alone - score) < 1e-5
        if words:
            places, first = toxicity.windows(np.array([len(words)]))
            each = [toxicity.Scorer(net).scores([" ".join(words[p - 1] for p in w if p)])[0] for w in places]
            assert abs(max(each) - score) < 1e-4


def test_op9_query(spark, sf, given):
    out = {r.doc_id: r for r in rows_of(spark, sf, "op9_language")}
    held = [i for i, r in out.items() if r.held_out and given[i].lang and (given[i].text or "").strip()]
    assert set(out) == set(given) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert sum(out[i].lang_pred == given[i].lang for i in held) >= 0.9 * len(held)


def test_op10_query(spark, sf, given):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    lib.no_truncation()
    lib.no_padding()
    out, start = {r.doc_id: r for r in rows_of(spark, sf, "op10_wavelet_shards")}, 0
    for i in sorted(given):
        ids = np.array([*lib.encode(given[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_conversation_repair"])
def test_queries_have_rows(spark, sf, name):
    assert rows_of(spark, sf, name)


ODD = "doc_id long, text string, lang string, source string, n_chars long, removed_lines string, toxic_score string, mix_key string, token_ids string, n_tokens string, decoded string, h string, label string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, sf, empty):
    texts = [None, "", "  \n", "one two three four five six.", "one two three four five six.", "é 😀   x", "word " * 30_000, "A\nB\nC\nD\nE"]
    rows = [(i if i != 2 else None, t, None, [None, "s", "t"][i % 3], None, "r", "x", "m", "t", "n", "d", "h", "l") for i, t in enumerate(texts)]
    rows += rows[3:4] * 2
    docs = spark.createDataFrame([] if empty else rows, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert bool(kept) != empty
        assert all(r.removed_lines == "r" and r.toxic_score == "x" and r.label == "l" for r in kept)
        docs = spark.createDataFrame(kept, docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and len(set(out.columns)) == len(out.columns)
