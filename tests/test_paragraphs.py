"""Vaults over paragraphs, spans of table rows, reading order and the short listings, on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from vellum.functions.text import SPAN
from vellum.operators import entities as E
from vellum.operators import files, matching, paging
from vellum.operators import paragraphs as G


def spanned(spark, rows):
    return spark.createDataFrame(rows, f"doc_id int, text string, entities array<{SPAN}>")


def span(text, value, kind, nth=0, score=0.9):
    at = -1
    for _ in range(nth + 1):
        at = text.index(value, at + 1)
    return (value, kind, at, at + len(value), score, "regex")


def test_vault_over_paragraphs(spark):
    text = "none\nann bob ann\n\nbob eve"
    spans = [span(text, "ann", "A"), span(text, "bob", "B"), span(text, "ann", "C", 1), span(text, "bob", "D", 1), span(text, "eve", "E"), span(text, "ann\n\nbob", "X")]
    df = spanned(spark, [(1, text, spans), (2, "", []), (3, None, []), (4, "bob", [span("bob", "bob", "Z")])])
    got = [tuple(r) for r in G.vault(G.spans_by_paragraph(df)).select("doc_id", "row_no", "original_value", "entity_type", "first_para", "occurrences").orderBy("doc_id", "row_no").collect()]
    assert got == [(1, 1, "ann", "C", 1, 2), (1, 2, "bob", "B", 1, 2), (1, 3, "eve", "E", 3, 1), (4, 1, "bob", "Z", 0, 1)]


def test_paragraphs_anonymised(spark):
    text = "x@y.io a@b.org\n10.0.0.7 x@y.io"
    df = E.detect(spark.createDataFrame([(1, text), (2, None), (3, "plain\ntext"), (None, "q@w.io")], "doc_id int, text string"), kinds=["EMAIL", "IP_ADDRESS"])
    rows = {r.doc_id: r for r in G.anonymise_paragraphs(df, "s").collect()}
    one = rows[1]
    assert [m.original_value for m in one.mapping] == ["a@b.org", "x@y.io", "10.0.0.7"]
    token = {m.original_value: m.token for m in one.mapping}
    assert one.pseudo_text == f"{token['x@y.io']} {token['a@b.org']}\n{token['10.0.0.7']} {token['x@y.io']}"
    assert one.full_text == "****@y.io ****@b.org\nXXX.XXX.XXX.XXX ****@y.io"
    assert rows[3].pseudo_text == "plain\ntext" and rows[3].mapping == [] and rows[2].mapping == []
    assert "q@w.io" not in rows[None].pseudo_text
    for bad in ({"salt": ""}, {"salt": "s", "mode": "x"}):
        with pytest.raises(ValueError):
            G.anonymise_paragraphs(df, **bad)


ROWS = "doc_id int, row_no int, cells array<struct<cell_id:string,paragraphs:array<struct<start:int,text:string>>>>"


def test_row_spans(spark):
    cell = lambda i, *ps: (i, list(ps))
    rows = spark.createDataFrame(
        [
            (1, 0, [cell("a", (0, "Age")), cell("a", (0, "Age")), cell("b", (4, "x"), (6, "47 years"))]),  # the merged cell counts once
            (1, 1, [cell("c", (20, "Age")), cell("d", (24, "51 years"))]),  # known already
            (1, 2, [cell("e", (40, "Age")), cell("f", (44, "62 years"))]),
            (1, 3, [cell("g", (40, "Age")), cell("h", (44, "62 years"))]),  # the same place again
            (2, 0, [cell("a", (0, "")), cell("b", (1, None))]),
            (2, 1, []),
        ],
        ROWS,
    )
    known = spark.createDataFrame([(1, 24, 26)], "doc_id int, start int, end int")
    plain = rows.where("row_no > 0 OR doc_id = 2")
    got = [tuple(r) for r in G.row_spans(plain, known, ["AGE"]).select("doc_id", "text", "start", "end").collect()]
    assert got == [(1, "62 years", 44, 52)]
    assert G.row_spans(plain, known.where("false"), ["AGE"]).count() == 2
    cells = rows.where("doc_id = 1 AND row_no = 0").select(F.transform(G.distinct_cells(F.col("cells")), lambda c: c["cell_id"]).alias("c")).first().c
    assert cells == ["a", "b"]


def test_first_isolated(spark):
    cases = [
        ([(10, "an anna"), (30, "ann an")], "an", 10),
        ([(10, "anna"), (30, ""), (40, "ann an")], "an", 44),
        ([(10, "anna")], "an", None),
        ([(10, "anna")], "", None),
        ([], "an", None),
        ([(10, "aaa"), (20, "aa")], "aa", 20),
    ]
    rows = spark.createDataFrame([(ps, v, w) for ps, v, w in cases], "ps array<struct<start:int,text:string>>, v string, want int")
    assert all(r.got == r.want for r in rows.select("want", G.first_isolated(F.col("ps"), F.col("v")).alias("got")).collect())


def test_reading_order(spark):
    parts = [("body", 0, None, None, 0), ("body", 0, None, None, 1), ("table", 1, 0, 0, 0), ("table", 1, 0, 1, 0), ("table", 2, 0, 0, 0), ("header", 1, None, None, 0), ("footer", 1, None, None, 0), ("header", 2, None, None, 0)]
    rows = spark.createDataFrame([("f", *p, n) for n, p in enumerate(parts)][::-1], "file string, part string, section int, row_no int, cell_no int, i int, want int")
    assert all(r.ord == r.want for r in G.reading_order(rows).collect())


def test_snippets(spark):
    rows = [
        ("a.PDF", [" one", "two", "3", "4", "5", "6"], None, None, None, "one\ntwo\n3\n4\n5", None),
        ("b.docx", None, "lead", None, None, "lead", None),
        ("b.docx", None, "lead", None, "bad", None, "docx_extract_failed: bad"),
        ("c.txt", None, "lead", None, None, None, "unsupported_type"),
        ("c.txt", None, "lead", "gone", None, None, "read_failed: gone"),
        ("d.pdf", ["x" * 20000], None, None, None, "x" * 14000, None),
    ]
    frame = spark.createDataFrame(rows, "path string, pages array<string>, lead string, read_error string, extract_error string, s string, e string")
    want = sorted([(r[0], r[5], r[6]) for r in rows], key=repr)
    assert sorted(map(tuple, files.snippets(frame).collect()), key=repr) == want


def test_jobs_upserts_reports(spark):
    listing = spark.createDataFrame([("json/a.json", 5), ("assets/a/1.png", 1), ("assets/a/2.png", 1), ("assets/a/2.txt", 1), ("pdf/a.pdf", 9), ("json/b.json", 7), ("assets/c/1.png", 1), ("x", 1)], "path string, size long")
    assert sorted(map(tuple, files.job_listing(listing).collect())) == [("a", "a.json", "a.pdf", 2, 5), ("b", "b.json", None, 0, 7)]
    index = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "old", 1), (2, None, 2), (3, "c", 1)], "id int, v string, at int")
    assert sorted(map(tuple, matching.upsert(index, changes, "id", "at").collect())) == [(1, "a"), (2, None), (3, "c")]
    reports = spark.createDataFrame([({"m1": ([("m1", "x")],), "m2": ([],)},), (None,)], "modules map<string, struct<items: array<struct<module: string, status: string>>>>")
    assert [tuple(r) for r in matching.flattened(reports).collect()] == [("m1", "x")]
    names = spark.createDataFrame([("z", 1), ("b", 1), ("a", 1), ("a", 2)], "name string, w int")
    assert [(r.w, r.name) for r in paging.ordered_sections(names, "name", ("b",), "w").orderBy("w", "place").collect()] == [(1, "b"), (1, "a"), (1, "z"), (2, "a")]
