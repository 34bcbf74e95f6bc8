"""Pages, matching, files, sources, geometry and streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cases, consistency, files, geometry, matching, paging, registry
from vellum.sources import files as sources
from vellum.streaming import registry as streaming


@pytest.mark.parametrize("n, chunks", [(1, 1), (20, 1), (21, 2), (39, 2), (40, 3)])
def test_windows(spark, n, chunks):
    pages = spark.createDataFrame([("f", i + 1, "t") for i in range(n)], "file string, page int, raw_text string")
    rows = paging.window_members(pages).collect()
    got = {}
    for r in rows:
        got.setdefault(r.chunk, []).append(r.page)
    want, start = [], 0
    while True:
        want.append(list(range(start + 1, min(start + 20, n) + 1)))
        if start + 20 >= n:
            break
        start += 19
    assert len(got) == chunks and [sorted(got[c]) for c in sorted(got)] == want


def test_window_texts(spark):
    pages = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "file string, page int, raw_text string")
    r = paging.window_texts(paging.window_members(pages)).first()
    assert r.text == "\n--- [FILE: f | PAGE: 1] ---\na\n--- [FILE: f | PAGE: 2] ---\nb" and r.mapping == {"f": [1, 2]}


def test_greedy(spark):
    sims = spark.createDataFrame([("m", "A", 1, 0, 0, 0.90), ("m", "A", 1, 1, 1, 0.85), ("m", "B", 2, 0, 0, 0.95), ("m", "B", 2, 1, 1, 0.40)], "module string, item string, item_ord long, doc long, doc_ord long, sim double")
    numbered = sims.withColumn("item", F.when(F.col("item") == "A", 1).otherwise(2).cast("long"))
    got = {r["item"]: (r.doc, r.sim, r.status) for r in matching.greedy(numbered).collect()}
    assert got == {1: (0, 0.90, "matched"), 2: (None, 0.40, "missing")}


def test_hints(spark):
    names = ["1.1 cover.pdf", "1.1_cover.pdf", "1.1.pdf", "2.3.S cover.pdf"]
    got = [r.h for r in spark.createDataFrame([(n,) for n in names], "n string").select(matching.hints(F.col("n")).alias("h")).collect()]
    assert got == [["1.1"], [], ["1.1.pdf"], ["2.3.S"]]
    rows = spark.createDataFrame([("1.1 cover.pdf", "1.10", 0.5), ("1.1 cover.pdf", "2.1", 0.5), ("1.1 a.pdf", "1.1", 0.95)], "filename string, section_id string, sim double")
    assert [(round(r.sim, 2), r.boost_applied) for r in matching.hinted(rows).collect()] == [(0.7, "filename_hint:1.1"), (0.5, None), (1.0, "filename_hint:1.1")]


def test_relevance(spark):
    titles, texts = spark.createDataFrame([(1, "Stability Data"), (2, ""), (3, "of it")], "item_id int, title string"), spark.createDataFrame([(1, "stability of tablets"), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in matching.relevance(titles, texts).collect()] == [(1, 1, 0.5)]


def test_reviewed_and_query_text(spark):
    m = spark.createDataFrame([("m", 1, "needs_user_confirmation"), ("m", 2, "matched")], "module string, item int, status string")
    v = spark.createDataFrame([("m", 1, "not_a_match"), ("m", 2, "not_a_match")], "module string, item int, verdict string")
    assert {r["item"]: r.status for r in matching.reviewed(m, v).collect()} == {1: "missing", 2: "matched"}
    row = spark.createDataFrame([("a", None, "c", ["d", "e"])], "a string, b string, c string, d array<string>")
    assert row.select(matching.query_text(*[F.col(c) for c in "abcd"]).alias("q")).first().q == "a | c | d. e"


def test_months(spark):
    rows = [("24 months", 24), ("2 years", 24), ("45 days", 1), ("36M", 36), ("none", None)]
    got = spark.createDataFrame(rows, "t string, want int").select("want", consistency.months(F.col("t")).alias("m")).collect()
    assert all(r.m == r.want for r in got)


def test_snippets(spark):
    t = "x" * 10 + " Shelf life: 24 months" + "y" * 300 + "\nTable 1\nexpiry: 2 years"
    r = spark.createDataFrame([(t,)], "t string").select(consistency.snippets(F.col("t"), 9).alias("s")).first().s
    starts = r.split("\n---\n")
    assert starts[0].startswith("Shelf life: 24 months") and any(s.startswith("expiry: 2 years") for s in starts)
    assert spark.createDataFrame([("ab\nSection 1\nvalue 1",)], "s string").select(consistency.line_value(F.col("s")).alias("v")).first().v == "value 1"


def test_look_up(spark):
    db = spark.createDataFrame([(1, "Paracetamol tablets", "500 mg"), (2, "Ibuprofen", None), (3, "Paracetamol", "650 mg")], "row_id int, drug_name string, strength string")
    q = spark.createDataFrame([(1, "paracetamol", None), (2, "PARACETAMOL", "650"), (3, "", None), (4, "buprofen", "nan"), (5, "zz", None), (6, "ib", None)], "query_id int, name string, strength string")
    assert {r.query_id: r.row_id for r in registry.look_up(q, db).collect()} == {1: 1, 2: 3, 3: None, 4: 2, 5: None, 6: 2}


def test_product_name(spark):
    rows = [
        ("Product name: Acmedol Forte\n", "Acmedol Forte"),
        ("we took ibuprofen", "ibuprofen"),
        ("nothing", None),
        ("Name of the product: \n\n Table 1\nN/A\n  Vel  dorin 5 mg \nmore", "Vel dorin 5 mg"),
        ("Proposed name: B\x20\nGamma\nProduct name: Alpha", "Gamma"),
        ("product name:", None),
        ("product name: n/a, ibuprofen", "n/a, ibuprofen"),
    ]
    got = spark.createDataFrame(rows, "t string, want string").select("want", registry.product_in(F.col("t")).alias("p")).collect()
    assert all(r.p == r.want for r in got)


def test_cases(spark):
    r = spark.createDataFrame([("admitted, later fatal",)], "t string").select(cases.severity(F.col("t")).alias("s")).first().s
    assert (r.event, r.severity) == ("Death", "High")
    rows = spark.createDataFrame([(1, "f", "a"), (2, "g", "A"), (3, "f", "b"), (4, None, None)], "case_ord int, file_name string, signature string")
    got = {r.case_ord: (r.duplicate_of, r.similarity) for r in cases.duplicates(rows).collect()}
    assert got == {1: (None, 0.0), 2: (1, 0.95), 3: (1, 1.0), 4: (None, 0.0)}
    h = 0
    for c in "SAE|x":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert spark.range(1).select(cases.hash31(F.lit("SAE|x")).alias("h")).first().h == h


def test_version_diff(spark):
    rows = spark.createDataFrame([("a", "m1/a.PDF"), ("a", "m2/b.docx"), ("b", "x/A.pdf"), ("b", "c.pdf"), ("b", "__MACOSX/b.docx")], "archive string, path string")
    assert {(r.only_in, r.path) for r in files.version_diff(rows).collect()} == {("a", "m2/b.docx"), ("b", "c.pdf")}


def test_unwrap_and_images(spark):
    rows = spark.createDataFrame([("top/a",), ("top/b/c",), ("__MACOSX/x",)], "path string")
    assert {r.path for r in files.unwrapped(rows).collect()} == {"a", "b/c"}
    images = spark.createDataFrame([("r/a/1.png",), ("r/a/b/2.jpg",), ("r/c/3.jpeg",), ("r/d.txt",)], "path string")
    assert {r.folder for r in files.leaf_image_folders(images).collect()} == {"r/a/b", "r/c"}


def test_name_scores(spark):
    rows = [("Report.pdf (page 3)", "a\\report.PDF", 100), ("report.docx", "report.pdf", 95), ("Re-port.pdf", "report.pdf", 90), ("my report.pdf", "report.pdf", 80), ("annual stability stability x.pdf", "stability y.pdf", 2), ("a.pdf", "zz.docx", -1), ("map3.pdf", "ma.txt", -1), ("\u6587.\u66f8", "x.pdf", 80), ("", "x", -1)]
    got = spark.createDataFrame(rows, "a string, b string, want int").select("want", files.name_score(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_best_files(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4)))
    name = lambda: rnd.choice(["", "x/"]) + rnd.choice(["-", " ", "_"]).join(word() for _ in range(rnd.randrange(1, 4))) + rnd.choice([".pdf", ".docx", "", " (Page 2)", ".\u66f8"])
    sources, names = [name() for _ in range(60)] + ["\u6587", ""], [name() for _ in range(40)] + ["\u6587.\u66f8", "annualreport2024.pdf"]
    sources.append("report.pdf")
    a, b = spark.createDataFrame([(x,) for x in sources], "source_name string"), spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, ord int")
    every = a.distinct().crossJoin(b).withColumn("score", files.name_score(F.col("source_name"), F.col("name"))).where("score > 0").collect()
    want = {}
    for r in sorted(every, key=lambda r: (-r.score, r.ord)):
        want.setdefault(r.source_name, (r.name, r.score))
    assert {r.source_name: (r.name, r.score) for r in files.best_files(a, b).collect()} == want


def test_provenance(spark):
    from vellum.operators import provenance as V

    rnd = random.Random(6)
    pick = lambda n: [rnd.choice(["alpha", "Beta", "beta\x01", "with", "gam", " ", "gamma\t", "", "delta x"]) for _ in range(n)]
    cases_ = [(" ".join(pick(rnd.randrange(0, 5))), pick(rnd.randrange(0, 6))) for _ in range(150)]

    def clean(x):
        out, at, space = "", [], True
        for i, c in enumerate(x):
            if c.isspace() or ord(c) < 32 or ord(c) == 127:
                if not space:
                    out, at = out + " ", [*at, i]
                space = True
            else:
                out, at, space = out + c.lower(), [*at, i], False
        return (out[:-1], at[:-1]) if out.endswith(" ") else (out, at)

    def brute(snippet, items):
        needle, (hay, at) = clean(snippet)[0], clean(" ".join(items))
        k = hay.find(needle) if needle else -1
        if k >= 0 and needle:
            a, b, cursor, strong = at[k], at[k + len(needle) - 1] + 1, 0, []
            for i, x in enumerate(items):
                if x.strip() and cursor + len(x) > a and cursor < b and clean(x)[0]:
                    strong.append(i)
                cursor += len(x) + 1
            return strong, []
        import re

        words = [w for w in re.split("[^a-z0-9]+", snippet.lower()) if len(w) >= 4 and w not in V.STOP_WORDS]
        return [], [i for i, x in enumerate(items) if x.strip() and sum(w in x.lower() for w in words) >= 2] if needle else []

    frame = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(cases_)], "i int, s string, x array<string>")
    for r in frame.select("i", V.items_of(F.col("s"), F.col("x")).alias("o")).collect():
        assert (r.o.strong, r.o.weak) == brute(*cases_[r.i]), cases_[r.i]
    texts = spark.createDataFrame([(1, "One two  three four five six"), (2, "xone twoy"), (3, None), (4, "")], "doc_id int, text string")
    passages = spark.createDataFrame([(1, "ne two thr"), (2, "o"), (3, "two three four five si"), (4, ""), (5, "one"), (6, "zz")], "item_id int, text string")
    assert sorted((r.item_id, r.doc_id, r.pos) for r in V.located(passages, texts).collect()) == [(1, 1, 2), (2, 1, 1), (2, 2, 2), (3, 1, 5), (5, 1, 1), (5, 2, 2)]


def test_cases_as_shown(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    empty = F.array().cast("array<string>")
    assert value(cases.narrative(none, text("fall"), text(""), none, none, text("X"), text("47"), none, [empty])) == "Event: fall. Suspected drug: X. Patient: 47"
    snippets = [F.array(F.lit(" "), F.lit("Rule-Based engine output: x")), F.array(F.lit(" a "), F.lit("b"))]
    assert value(cases.narrative(none, *[none] * 7, snippets)) == "a b"
    assert value(cases.narrative(none, *[none] * 7, [empty])) == "No narrative available."
    assert value(cases.eligibility_message(text("Generic Drug Application"))).startswith("This drug is already listed")
    assert [value(cases.bucket(text(x))) for x in ("Hospitalization", "no DEATH", "x")] == ["Hospitalisation", "Death", "Others"]
    assert value(consistency.line_value(text("ab\nSection 1"))) == "ab\nSection 1"
    keys = [value(files.natural_key(text(x))) for x in ("a2", "a10", "a12345678901234567", "a012345678901234568")]
    assert keys == sorted(keys)


def word_file(paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{ns}"><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        z.writestr("m1/a.docx", word_file(["one", "two"]))
        z.writestr("__MACOSX/x", "no")
        z.writestr("../y", "no")
    (tmp_path / "in/b.zip").write_bytes(b"no archive")
    members = sources.archive_members(sources.binary_files(spark, str(tmp_path / "in"), "*.zip"))
    rows = sorted(members.collect(), key=lambda r: r.archive)
    assert [r.member for r in rows] == ["m1/a.docx", None] and "BadZipFile" in rows[1].error
    texts = sources.word_documents(members.where("error IS NULL").select(F.col("member").alias("path"), "content")).collect()
    assert [r.text for r in texts] == ["one\ntwo\nhead"]
    raw = spark.createDataFrame([("u.txt", "é".encode()), ("l.txt", "é".encode("latin-1"))], "path string, content binary")
    assert [r.text for r in sources.text_files(raw).collect()] == ["é", "é"]
    pages = spark.createDataFrame([("f", 1, "x"), ("g", 1, "y")], "file string, page int, raw_text string")
    sources.save_pages(pages, str(tmp_path / "pages"))
    assert sources.saved_pages(spark, str(tmp_path / "pages")).count() == 2


def test_checklist(spark):
    rows = [("Module 1", 1, "x", None, None, None), ("Module 1", 2, "Section ID", "Document Title", "d", "a"), ("Module 1", 3, "1.1", " Cover\n letter ", "nan", "mandatory"), ("Module 1", 4, "1.2", "B", "d", "unknown"), ("Module 1", 5, "Total documents", "2", None, None), ("Module 1", 6, "1.3", "C", "d", "Optional")]
    got = sources.checklist(spark.createDataFrame(rows, "sheet string, row int, section_id string, title string, description string, applicability string")).collect()
    assert [(r.module, r.section_id, r.title, r.description, r.applicability) for r in got] == [("m1", "1.1", "Cover letter", "", "Mandatory")]


def test_text_helpers(spark):
    row = spark.createDataFrame([('Sure:\n```json\n{"a": 1}\n```',)], "t string")
    assert row.select(T.outer_json(F.col("t")).alias("j")).first().j == '{"a": 1}'
    assert row.select(T.display_label(F.lit("DATE_OF_birth")).alias("j")).first().j == "DATE OF Birth"
    assert row.select(T.truncated(F.lit("abcdef"), 5).alias("j")).first().j == "ab..."


def test_dedup_and_iou(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        x, y = rnd.randrange(20), rnd.randrange(20)
        rows.append((i % 3, i, float(x), float(y), float(x + 10), float(y + 6)))
    lines = spark.createDataFrame(rows, "page_id int, line_ord int, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / (120 - w * h + 1e-6)

    kept = []
    for r in rows:
        if not any(k[0] == r[0] and iou(k, r) > 0.3 for k in kept):
            kept.append(r)
    assert sorted(r.line_ord for r in geometry.deduplicated(lines, 0.3).collect()) == sorted(k[1] for k in kept)
    box = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert abs(box.select(geometry.iou(F.col("a"), F.col("b")).alias("i")).first().i - 25 / 175) < 1e-6


def test_stream_of_cases(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "case_ord long, signature string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = streaming.stream_duplicates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = found.writeStream.outputMode("append").format("memory").queryName("found_cases").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.case_ord, r.duplicate_of) for r in spark.sql("SELECT * FROM found_cases").collect()} == {(1, None), (2, 1), (3, None)}
