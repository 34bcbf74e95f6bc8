"""Rows on which the reviewed code differed or did less."""

from pyspark.sql import functions as F

from vellum.operators import cases


def test_priority_rounds_tenths_as_sql(spark, sf):
    """seeds whose score is just under a half of a tenth (1.5 + 3.5 * 0.7 is 3.9499999999999997)."""
    import duckdb

    seeds = [f"s{i}" for i in range(4000)]
    rows = spark.createDataFrame([(s, level) for s in seeds for level in ("high", "medium", "low")], "seed string, level string")
    got = rows.select(cases.hash31(F.col("seed")).alias("h"), "level", cases.priority(F.col("level"), F.col("seed")).alias("p")).collect()
    base, width = {"high": 8.5, "medium": 5.5, "low": 1.5}, {"high": 1.5, "medium": 2.5, "low": 3.5}
    scores = [base[r.level] + width[r.level] * ((r.h % 1000) / 1000) for r in got]
    assert 1.5 + 3.5 * 0.7 in scores
    want = duckdb.execute("SELECT list_transform($1::DOUBLE[], lambda x: round(x, 1))", [scores]).fetchone()[0]
    assert [r.p for r in got] == want


def test_matches_in_one_pass(spark):
    """Places of matches, in texts with the noncharacter that marks them too."""
    import re

    from vellum.functions import text as T

    texts = ["", "a", "ab1 ab22", "ab1ab2﷐ab3", "﷐", "xx ab7", "ab", "\U0001d4b3ab5 éab66", "ab$1 ab\\2 ab3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.finditer(F.col("t"), r"ab(\d+)").alias("m")).collect()
    want = {t: [(m.start(), m.end(), m[0], m[1]) for m in re.finditer(r"ab(\d+)", t)] for t in texts}
    assert {r.t: [tuple(m) for m in r.m] for r in rows} == want


def test_detection_uses_all_cores(spark, sf, monkeypatch):
    """A file of one row group was one task for all definitions."""
    from vellum.functions import patterns as P
    from vellum.operators import entities

    monkeypatch.setattr(P, "LABELLED", tuple(d for d in P.LABELLED if d[0] in ("EMAIL", "AGE")))
    docs = spark.createDataFrame([(i, f"Age: {i + 20} years") for i in range(60)], "doc_id int, text string").coalesce(1)
    found = entities.exploded(entities.detect(docs))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(i, f"{i + 20} years") for i in range(60)]


def test_places_of_tokens_stay_flat():
    """a batch of long texts took an object for each token."""
    import pyarrow as pa

    from vellum.operators import recogniser

    got = recogniser._pieces(pa.array(["ab, c", None, "", "é\U0001d4b3 x1"]))
    assert isinstance(got, pa.ListArray) and got.nbytes < 200
    assert got.to_pylist() == [[{"start": a, "end": b} for a, b in p] for p in ([(0, 2), (2, 3), (4, 5)], [], [], [(0, 1), (1, 2), (3, 5)])]


def test_words_are_placed_without_a_group_for_each_page(spark):
    """rows of words, with words without a place or an id, and one shuffle of words that are dealt by id."""
    from vellum.operators import geometry

    words = [(1, 0, 30.0, 0.0, 40.0, 10.0, "b"), (1, 0, 0.0, 1.0, 10.0, 11.0, " a "), (1, 0, 12.0, 30.0, 20.0, 40.0, "c"), (1, 2, 0.0, 0.0, 5.0, 9.0, "d"), (1, 2, 6.0, None, 9.0, 9.0, "e"), (None, 0, 0.0, 0.0, 1.0, 1.0, "f"), (1, 0, 0.0, 0.0, 1.0, 1.0, " ")]
    df = spark.createDataFrame(words, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string").repartition(3, "doc_id")
    placed = geometry.placed_words(df)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange") == 2  # the deal of the words, and one behind Python
    got = sorted((r.doc_id or 0, r.page, r.w_start, r.w_end, r.row_no, r.sep, r.text) for r in placed.collect())
    assert got == [(0, 0, 0, 1, 0, "", "f"), (1, 0, 0, 1, 0, "", "a"), (1, 0, 2, 3, 0, "\t", "b"), (1, 0, 4, 5, 1, "\n", "c"), (1, 2, 7, 8, 0, "", "d"), (1, 2, 9, 10, 1, "\n", "e")]
    rows = geometry.rows_of_words(df, doc_id="doc_id")
    assert sorted((r.doc_id or 0, r.page, r.row_no, r.row_text) for r in rows.collect()) == [(0, 0, 0, "f"), (1, 0, 0, "a\tb"), (1, 0, 1, "c"), (1, 2, 0, "d"), (1, 2, 1, "e")]


def test_normal_forms_of_all_ten_fields(spark, sf):
    """fields 2 to 6 had gone with the inline rows."""
    from vellum.plans import catalogue

    counts = {r.field_number: r["count"] for r in catalogue.QUERIES["field_normal_forms"](spark, sf).groupBy("field_number").count().collect()}
    assert counts == dict.fromkeys(range(1, 11), spark.read.parquet(f"{sf}/part.parquet").count())


def test_anchors_of_the_fields_asked_for(spark):
    """all ten fields were searched for where one was wanted."""
    from vellum.operators import consistency

    rows = spark.createDataFrame([(1, "M3", "Shelf life: 24 months\nStrength: 5 mg")], "dossier_id int, module string, text string")
    every = {r.field_number: r.raw for r in consistency.extract_fields(rows).collect()}
    some = {r.field_number: r.raw for r in consistency.extract_fields(rows, (9,)).collect()}
    assert len(every) == 10 and some == {9: every[9]} and "24 months" in some[9]


def test_common_words_meet_over_their_sets(spark, monkeypatch):
    """every source met every file that shares a common word with it."""
    from vellum.operators import files

    a = spark.createDataFrame([(f"{i} page 2 ref x.pdf",) for i in range(0, 400, 2)] + [("top top ref.pdf",), ("401 none.pdf",), ("3 page.pdf",)], "source_name string")
    b = spark.createDataFrame([(f"{i} page 2 ref.pdf" if i % 3 else f"{i} top.pdf", i) for i in range(1, 402, 2)], "name string, ord int")
    rows = lambda x, key: x.select(*x.columns, files.stem_words(F.col(key)).alias("ws"))
    for common in (10, 1000):  # with common words, and without any
        monkeypatch.setattr(files, "COMMON", common)
        found = files.most_shared(rows(a, "source_name"), rows(b, "name")).groupBy("source_name").agg(F.collect_set("f.ord").alias("o")).collect()
        got = {r.source_name: set(r.o) for r in found}
        assert all(len(o) <= 2 for o in got.values())
        assert got["0 page 2 ref x.pdf"] == {1} and 3 in got["top top ref.pdf"] and got["401 none.pdf"] == {401} and 1 in got["3 page.pdf"]
        every = a.crossJoin(b).withColumn("score", files.name_score(F.col("source_name"), F.col("name"))).where("score > 0").collect()
        want = {}
        for r in sorted(every, key=lambda r: (-r.score, r.ord)):
            want.setdefault(r.source_name, (r.name, r.score))
        assert {r.source_name: (r.name, r.score) for r in files.best_files(a, b).collect()} == want


def test_brief_passages_need_no_runs_of_characters(spark, monkeypatch):
    """texts were cut into all runs of three characters for passages of one or two words."""
    from vellum.operators import provenance

    texts = {1: "One two  three four", None: "xone\ntwoy", 3: None, 4: "", 5: "é ö two"}
    passages = {1: "ne two", 2: "o", 3: "E TWO thr", 4: "", 5: "one", 6: "zz", 7: "é", 8: "two"}
    t, p = spark.createDataFrame(list(texts.items()), "doc_id int, text string"), spark.createDataFrame(list(passages.items()), "item_id int, text string")
    plain = lambda x: " ".join(x.lower().split())
    want = {(i, d, plain(x).index(plain(b)) + 1) for d, x in texts.items() for i, b in passages.items() if x and plain(b) and plain(b) in plain(x)}
    for most in (0, 6, 1000):  # none, brief ones, all of them
        monkeypatch.setattr(provenance, "SCANNED", most)
        rows = [(r.item_id, r.doc_id, r.pos) for r in provenance.located(p, t).collect()]
        assert len(rows) == len(want) and set(rows) == want
    monkeypatch.setattr(provenance, "grams", None)
    monkeypatch.setattr(provenance, "_runs", None)
    assert provenance.located(p, t).count() == len(want)


def test_pages_are_prepared_once_for_all_snippets(spark):
    """items were lower-cased anew for each word of each snippet."""
    from vellum.operators import provenance

    pages = [["A lively  Horse", " ", "the HORSE runs"], [], [""], None, ["lively horse runs and horse", "x"]]
    snippets = ["lively horse", "runs horse", "", "with from", "horse  the", "Horse horse"]
    rows = spark.createDataFrame([(s, p) for s in snippets for p in pages], "s string, p array<string>")
    rows = rows.withColumn("page", provenance.page_of(F.col("p"))).select("s", "p", provenance.items_of(F.col("s"), F.col("p")).alias("a"), provenance.items_of(F.col("s"), F.col("p"), F.col("page")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    got = {(r.s, tuple(r.p)): (r.b.strong, r.b.weak) for r in rows if r.p is not None}
    assert got["lively horse", tuple(pages[0])] == ([0], []) and got["runs horse", tuple(pages[0])] == ([], [2]) and got["horse  the", tuple(pages[0])] == ([0, 2], [])
    assert got["Horse horse", tuple(pages[0])] == ([], [0, 2]) and got["with from", tuple(pages[0])] == ([], []) and got["", tuple(pages[0])] == ([], [])


def test_a_model_gets_windows_in_slices(spark):
    """a model and pandas got a whole batch of up to 10,000 windows."""
    import pandas as pd

    from vellum.operators import paging

    windows = spark.range(350).coalesce(1).select(F.col("id").alias("file"), F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("n_pages"), F.when(F.col("id") != 7, F.concat(F.lit("t"), "id")).alias("text"), F.create_map(F.col("id"), F.array(F.lit(1))).alias("mapping"))
    rows = paging.map_windows(windows, lambda texts: pd.Series([None if t is None else f"{t} of {len(texts)}" for t in texts], index=texts.index)).collect()
    assert {r.file: r.text for r in rows} == {i: f"t{i}" if i != 7 else None for i in range(350)}
    assert all(int(r.partial.split()[-1]) <= paging.SLICE_ROWS and r.partial.startswith(f"{r.text} of") for r in rows if r.file != 7)
    assert [r.partial for r in rows if r.file == 7] == [None]


def test_files_are_read_one_by_one(spark):
    """contents and texts of a whole batch were pandas objects, with a frame for each file."""
    from vellum.sources import files as sources

    def reader(content: bytes):
        if content == b"bad":
            raise ValueError("no file")
        yield from content.decode().split("|")

    docs = spark.createDataFrame([("a", bytearray(b"x|y")), (None, bytearray(b"bad")), ("c", None), ("d", bytearray())], "path string, content binary")
    found = sources.pdf_texts(docs, reader)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "MapInPandas" not in found._jdf.queryExecution().toString()
    rows = {r.path: (r.text, r.n_pages, (r.error or "").split(":")[0]) for r in found.collect()}
    assert rows == {"a": ("x\ny", 2, ""), None: (None, 0, "ValueError"), "c": (None, 0, "TypeError"), "d": ("", 1, "")}
    many = spark.range(2500).select(F.col("id").cast("string").alias("path"), F.lit("p|q").cast("binary").alias("content"))
    assert sources.pdf_texts(many, reader).where("text = 'p\\nq' AND n_pages = 2").select("path").distinct().count() == 2500
