"""The queries over all definitions, against spans written down by hand."""

from collections import Counter

import pytest

from vellum.functions import patterns as P
from vellum.plans import catalogue as C

TEXTS = [
    ("Subject ID: AB-123 and x@y.io", [("SUBJECT_ID", "AB-123"), ("EMAIL", "x@y.io")]),
    ("Random code: ZX81Q", [("RANDOMIZATION_CODE", "ZX81Q")]),
    ("mail x@y.io x@y.io", [("EMAIL", "x@y.io"), ("EMAIL", "x@y.io")]),
]
SPANS = [(i, k, v) for i, (_, found) in enumerate(TEXTS) for k, v in found]


@pytest.fixture
def few(monkeypatch):
    """Only the definitions that the texts meet: planning all of them takes minutes for each query."""
    kinds = {k for _, k, _ in SPANS}
    monkeypatch.setattr(P, "LABELLED", tuple(d for d in P.LABELLED if d[0] in kinds))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(path + "/documents.parquet")
    return path


def test_email_spans_of_all_documents(spark, small):
    got = sorted((r.doc_id, r.value, r.start, r.end) for r in C.pii_email_spans(spark, small).collect())
    assert got == [(0, "x@y.io", 23, 29), (2, "x@y.io", 5, 11), (2, "x@y.io", 12, 18)]


def test_report_counts_all_kinds(spark, small, few):
    assert {(r.doc_id, r.entity_type, r.original_value): r.occurrences for r in C.entry(spark, small).collect()} == Counter(SPANS)


def test_pseudonyms_of_all_kinds(spark, small, few):
    for r in C.pii_pseudonymise(spark, small).collect():
        values = {v for i, _, v in SPANS if i == r.doc_id}
        assert r.n_tokens == len(values) and not any(v in r.pseudo_text for v in values)
