"""Words placed in text, spans over words, snippets in Word files, folders of modules, capped reading: against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.operators import entities, files, geometry, matching, ordering, paging, provenance
from vellum.sources import files as sources

# --- words in text ---


def plain_stream(words, reach=3.2, gap=16.0):
    """words: (page, x0, y0, x1, y1, text) of one document; its text and (page, text, start, end) of each word."""
    pieces, spans, pos = [], [], 0

    def put(s):
        nonlocal pos
        pieces.append(s)
        pos += len(s)

    last = max(w[0] for w in words if w[5].strip())
    for page in range(last + 1):
        ws = sorted((w for w in words if w[0] == page and w[5].strip(" \t\n\x0b\f\r")), key=lambda w: ((w[2] + w[4]) / 2, w[1], w[3], w[5]))
        rows, current, mean = [], [], None
        for w in ws:
            cy = (w[2] + w[4]) / 2
            if mean is None or abs(cy - mean) <= reach:
                current.append(w)
                mean = cy if mean is None else (mean * (len(current) - 1) + cy) / len(current)
            else:
                rows.append(sorted(current, key=lambda w: w[1]))
                current, mean = [w], cy
        if current:
            rows.append(sorted(current, key=lambda w: w[1]))
        for i, row in enumerate(rows):
            if i:
                put("\n")
            for j, w in enumerate(row):
                if j:
                    put("\t" if w[1] - row[j - 1][3] >= gap else " ")
                text = w[5].strip(" \t\n\x0b\f\r")
                spans.append((page, text, pos, pos + len(text)))
                put(text)
        if page < last:
            put("\n")
    return "".join(pieces), spans


def random_words(seed):
    rng = random.Random(seed)
    out = []
    for page in rng.sample(range(6), 4):
        for _ in range(rng.randrange(1, 25)):
            x, y = rng.randrange(60) * 7.0, rng.randrange(6) * 9.0 + rng.choice([0, 1.5, 3])
            out.append((page, x, y, x + rng.randrange(5, 30), y + 8.0, rng.choice(["Name", " x ", "é😀", "a@b.org", "47", "", "  "])))
    out.append((5, 0.0, 0.0, 5.0, 8.0, "end"))
    return list({(w[0], w[1], w[2]): w for w in out}.values())


def test_placed_words_and_their_text(spark):
    docs = {i: random_words(i) for i in range(12)} | {None: random_words(99)}
    df = spark.createDataFrame([(d, *w) for d, ws in docs.items() for w in ws], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    placed = geometry.placed_words(df)
    texts = {r.doc_id: r.text for r in geometry.stream_of(placed).collect()}
    rows = placed.collect()
    for d, ws in docs.items():
        text, spans = plain_stream(ws)
        assert texts[d] == text
        assert sorted((r.page, r.text, r.w_start, r.w_end) for r in rows if r.doc_id == d) == sorted(spans)
        assert all(text[r.w_start : r.w_end] == r.text for r in rows if r.doc_id == d)
    assert geometry.stream_of(geometry.placed_words(df.limit(0))).count() == 0


@pytest.mark.parametrize("width", [1, 7, 64])
def test_words_under_spans(spark, width):
    rng = random.Random(4)
    words = [(rng.choice([1, 2, None]), rng.randrange(3), float(rng.randrange(90)), float(rng.randrange(90)), (s := rng.randrange(400)), s + rng.randrange(1, 30)) for _ in range(150)]
    spans = [(rng.choice([1, 2, None]), s := rng.randrange(400), s + rng.randrange(1, 120)) for _ in range(60)]
    w = spark.createDataFrame([(d, p, x, y, x + 5, y + 5, a, b) for d, p, x, y, a, b in words], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, w_start int, w_end int")
    s = spark.createDataFrame(sorted(set(spans), key=repr), "doc_id long, start int, end int")
    want = {}
    for d, a, b in set(spans):
        for e, p, x, y, c, f in words:
            if d == e and c < b and a < f:
                box = want.get((d, a, b, p), (1e9, 1e9, -1.0, -1.0))
                want[d, a, b, p] = (min(box[0], x), min(box[1], y), max(box[2], x + 5), max(box[3], y + 5))
    got = {(r.doc_id, r.start, r.end, r.page): (r.x0, r.y0, r.x1, r.y1) for r in entities.words_under_spans(w, s, width=width).collect()}
    assert got == want


# --- snippets in Word files ---


def plain_form(text):
    out, where, space = "", [], True
    for i, c in enumerate(text):
        if re.match("[a-zA-Z0-9]", c):
            out, space = out + c.lower(), False
            where.append(i)
        elif not space:
            out, space = out + " ", True
            where.append(i)
    return (out[:-1], where[:-1]) if out.endswith(" ") else (out, where)


def plain_lookup(blocks, snippet, page):
    """blocks: (block, page, text) in order."""
    needle = plain_form(re.sub(r"(\.\.\.|…)+", " ", snippet or ""))[0]
    at = 0
    starts = []
    for b in blocks:
        starts.append(at)
        at += len(b[2] or "")
    if needle:
        whole = "".join(b[2] or "" for b in blocks)
        form, where = plain_form(whole)
        i = form.find(needle)
        if i >= 0:
            start, end = where[i], where[i + len(needle) - 1] + 1
            return "document", start, end, next(b[0] for b, s in zip(blocks, starts) if s + len(b[2] or "") > start)
        for b, s in zip(blocks, starts):
            form, where = plain_form(b[2] or "")
            i = form.find(needle)
            if i >= 0:
                return "block", s + where[i], s + where[i + len(needle) - 1] + 1, b[0]
    for b in blocks:
        if page is not None and b[1] == page:
            return "page", None, None, b[0]
    return "none", None, None, None


def test_in_word_files(spark):
    rng = random.Random(6)
    parts = ["Study", "No.", "12", " — ", "é", "K", "end...", "…", "\t", "A-B", "  ", "😀", "x"]
    docs = {d: [(i, i // 3 + 1, rng.choice([None, "", *["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(6)]])) for i in range(9)] for d in (1, 2, 3, None)}
    snippets = []
    for d, bs in docs.items():
        whole = "".join(b[2] or "" for b in bs)
        for k in range(25):
            a = rng.randrange(len(whole) + 1)
            s = whole[a : a + rng.randrange(12)]
            s = rng.choice([s, s.upper(), "..." + s + "…", s.replace(" ", " - "), "no such words", "", None])
            snippets.append((d, k, s, rng.choice([None, 1, 2, 9])))
    snippets.append((7, 0, "of no document", 1))
    b = spark.createDataFrame([(d, *x) for d, bs in docs.items() for x in bs], "doc_id long, block int, page int, text string").repartition(5)
    s = spark.createDataFrame(snippets, "doc_id long, snippet_id int, snippet string, page int")
    got = {(r.doc_id, r.snippet_id): (r.stage, r.start, r.end, r.block) for r in provenance.in_word_files(s, b).collect()}
    want = {(d, k): plain_lookup(docs.get(d, []), t, p) for d, k, t, p in snippets}
    assert got == want
    assert {w[0] for w in want.values()} >= {"document", "page", "none"}
    assert provenance.in_word_files(s.limit(0), b).count() == 0


def test_block_where_the_whole_does_not_hold_it(spark):
    """A block's edge may fall within a word of the whole text; the block alone is then asked."""
    b = spark.createDataFrame([(1, 0, 1, "pre"), (1, 1, 1, "fix b"), (1, 2, 2, "c end")], "doc_id long, block int, page int, text string")
    s = spark.createDataFrame([(1, 0, "prefix bc", 1), (1, 1, "c END!", 1), (1, 2, "zzz", 2)], "doc_id long, snippet_id int, snippet string, page int")
    got = {r.snippet_id: (r.stage, r.start, r.end, r.block) for r in provenance.in_word_files(s, b).collect()}
    assert got == {0: ("document", 0, 9, 0), 1: ("document", 8, 13, 2), 2: ("page", None, None, 2)}


# --- folders of modules, exports, capped reading ---


def plain_modules(paths, keys):
    """Root first, then its folders by name."""

    def key(name):
        name = name.strip().lower()
        for pattern in (r"^m(\d+)$", r"(?:^|[^a-z0-9])m(\d+)(?:[^a-z0-9]|$)", r"module[\s_-]*(\d+)"):
            m = re.search(pattern, name)
            if m and f"m{int(m.group(1))}" in keys:
                return f"m{int(m.group(1))}"
        return None

    split = [[s for s in p.replace("\\", "/").split("/") if s] for p in paths]
    split = [p for p in split if len(p) > 1]
    root = split[0][0] if split else None
    if root and key(root):
        return {key(root): root}
    return {key(c): f"{root}/{c}" for c in sorted({p[1] for p in split if len(p) > 2}) if key(c)}


def test_detected_modules(spark):
    keys = ("m1", "m2", "m3", "m4", "m5")
    names = ["m1", "M01", "Module 2", "1.m3", "m9 module 4", "docs", "m3_old", "module-2b", " m5 ", "m12"]
    rng = random.Random(3)
    dossiers = {i: [f"{root}/{rng.choice(names)}/{rng.choice(['a.pdf', 'x/b.pdf'])}" for _ in range(rng.randrange(1, 7))] + [f"{root}/m2.pdf"] for i in range(40) for root in [rng.choice(["dossier", "dossier", "m2", "Module 7"])]}
    df = spark.createDataFrame([(d, p) for d, ps in dossiers.items() for p in ps + ps[:1]] + [(99, "alone.pdf"), (98, ""), (97, None)], "dossier long, path string")
    got = {}
    for r in files.detected_modules(df, keys).collect():
        got.setdefault(r.dossier, {})[r.module] = r.folder
    assert got == {d: m for d, ps in dossiers.items() if (m := plain_modules(ps, keys))}


def test_newest_first(spark):
    df = spark.createDataFrame([("a_1.xlsx",), ("b.txt",), ("a_3.xlsx",), (None,), ("a_2.xlsx",)], "name string")
    assert [r.name for r in sources.newest_first(df).collect()] == ["a_3.xlsx", "a_2.xlsx", "a_1.xlsx"]


def test_reading_stops_at_its_limits(spark):
    def reader(content):
        n = int(content)
        if n < 0:
            raise ValueError("no pages")

        def broken():
            raise RuntimeError("damaged page")

        for i in range(n):
            if i >= 7:
                raise AssertionError("read too far")
            yield broken if i == 2 else (lambda i=i: f"page {i}") if i % 2 else f"page {i}"

    df = spark.createDataFrame([("a", b"3"), ("b", b"5"), ("c", b"-1"), ("d", b"0"), ("e", b"50")], "path string, content binary")
    got = {r.path: (r.text, r.n_pages, r.error) for r in sources.pdf_texts(df, reader, most_pages=5).collect()}
    assert got["a"] == ("page 0\npage 1\n", 3, None)
    assert got["b"] == got["e"] == ("page 0\npage 1\n\npage 3\npage 4", 5, None)
    assert got["c"] == (None, 0, "ValueError: no pages") and got["d"] == ("", 0, None)
    short = {r.path: (r.text, r.n_pages) for r in sources.pdf_texts(df, reader, most_pages=6, most_chars=10).collect()}
    assert short["b"] == ("page 0\npag", 2)


# --- matching ---


def test_greedy_needs_the_best_of_each_item_only(spark):
    rng = random.Random(8)
    rows = [(m, i, i % 7, d, d, rng.choice([0.0, -0.1, 0.5, 0.66, 0.7, 0.79, 0.9, round(rng.random(), 2)])) for m in ("a", "b") for i in range(12) for d in range(60)]
    df = spark.createDataFrame(rows, "module string, item long, item_ord long, doc long, doc_ord long, sim double")
    want = {}
    for m in ("a", "b"):
        used = set()
        for o, i in sorted({(r[2], r[1]) for r in rows if r[0] == m}):
            free = [(-r[5], r[4], r[3]) for r in rows if r[0] == m and r[1] == i and r[3] not in used and r[5] > 0]
            s, _, d = min(free, default=(0.0, 0, None))
            if -s >= matching.PARTIAL:
                used.add(d)
            want[m, i] = (d if -s >= matching.PARTIAL else None, -s)
    got = {(r.module, r.item): (r.doc, r.sim) for r in matching.greedy(df).collect()}
    assert got == want


def test_relevance_by_either_way(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["stability", "data", "report", "tablets", "study", "of", "batch", "release", "site", "dose"])
    titles = [(i, " ".join(word() for _ in range(rng.randrange(6)))) for i in range(30)] + [(98, None), (99, "")]
    texts = [(i, " ".join(word() for _ in range(rng.randrange(8)))) for i in range(60)] + [(97, None)]
    t, d = spark.createDataFrame(titles, "item_id long, title string"), spark.createDataFrame(texts, "doc_id long, text string")
    words = lambda x: {w for w in re.findall("[a-z0-9]+", (x or "").lower()) if len(w) > 2}
    want = {(i, j, round(len(a & b) / len(a), 6)) for i, x in titles for j, y in texts if (a := words(x)) and len(a & (b := words(y))) >= 0.35 * len(a) and a & b}
    for most in (10**6, 0):
        assert {(r.item_id, r.doc_id, r.overlap) for r in matching.relevance(t, d, most_broadcast=most).collect()} == want


def test_names_lose_two_pages(spark):
    rows = [("Report (page 1) (page 2)", "report.pdf", 95), ("x/Report.pdf (Page 3)", "report.pdf", 100), ("a.pdf", "b.pdf", -1)]
    df = spark.createDataFrame(rows, "a string, b string, want int").select("want", files.name_score(F.col("a"), F.col("b")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_passages_in_texts_without_an_id(spark):
    texts = spark.createDataFrame([(None, "A b  C d e f g"), (1, "nothing of it"), (2, "x a b c d e f")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "b c D e")], "item_id long, text string")
    assert sorted(((r.item_id, r.doc_id, r.pos) for r in provenance.located(passages, texts).collect()), key=repr) == [(7, 2, 5), (7, None, 3)]


def test_places_and_sums_over_a_whole_table(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v long").repartition(5)
    order = [F.col("k").asc_nulls_first(), F.col("id")]
    want, at = {}, 0
    for n, (i, k, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])), 1):
        want[i] = (n, at)
        at += v or 0
    out = ordering.numbered(ordering.running(df, order, F.col("v"), "before"), order)
    assert {r.id: (r.place, r.before) for r in out.collect()} == want
    assert ordering.numbered(df.limit(0), order).count() == 0


def test_order_across_files(spark):
    rows = [(f, p) for f in (3, 1, 2) for p in range(1, f + 3)]
    df = spark.createDataFrame([(f, p, "t") for f, p in rows], "file long, page int, raw_text string")
    got = {(r.file, r.page): (r.ord, r.n) for r in paging.with_order(df, across_files=True).collect()}
    assert got == {fp: (i, len(rows)) for i, fp in enumerate(sorted(rows))}
