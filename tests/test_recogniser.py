"""Windows of a tagger and joined tokens against plain loops."""

import random

from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.operators import entities, recogniser

LABELS = ["O", "B-PER", "I-PER", "PER", "ORG", "B-DATE", "DATE", "B-LOC", "OTHER", "O"]


def plain_windows(text, window, stride):
    tokens = []
    i = 0
    while i < len(text):
        if text[i] in " \t\n\x0b\f\r":
            i += 1
            continue
        j = i + 1
        if text[i].isascii() and text[i].isalnum():
            while j < len(text) and text[j].isascii() and text[j].isalnum():
                j += 1
        tokens.append((i, j))
        i = j
    out, at = [], 0
    while tokens:
        out.append(tokens[at : at + window])
        if at + window >= len(tokens):
            break
        at += window - stride
    return out


def plain_spans(text, tokens, tags):
    out, now = [], None

    def flush():
        if now is not None:
            word = text[now[1] : now[2]].strip(" \t\n\x0b\f\r")
            if len(word) >= 2 and word.lower() not in P.RECOGNISER_SPURIOUS:
                out.append((word, now[0], now[1], now[2], round(now[3], 4)))

    for (s, e), (label, score) in zip(tokens, tags):
        bare = label.split("-", 1)[1] if "-" in label else label
        kind = P.RECOGNISER_LABELS.get(bare, bare)
        if label == "O" or kind == "DATE" or score < 0.75:
            flush()
            now = None
        elif now is not None and kind == now[0] and s <= now[2]:
            now = (kind, now[1], max(now[2], e), min(now[3], score))
        else:
            flush()
            now = (kind, s, e, score)
    flush()
    return out


def texts(n, seed=2):
    rng = random.Random(seed)
    parts = ["Anna", "bo", "12", "x", ".", "-", "é", "Sponsor", "Meier-Huber", "A", "\n", "  ", "😀"]
    return [None, "", "   ", "one"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(120))) for _ in range(n)] + ["word " * 6000]


def tag(words):
    """A tagger by the hash of a word and its neighbour's length."""
    return [(LABELS[(len(w) * 7 + ord(w[0])) % 10], 0.7 + (ord(w[-1]) % 7) / 20) for w in words]


def tagger(windows):
    from pyspark.sql.functions import pandas_udf

    f = pandas_udf(lambda s: s.map(lambda ws: [{"label": a, "score": b} for a, b in tag(ws)]), recogniser.TAGS)
    return windows.withColumn("tags", f("words"))


def test_windows_and_spans_equal_plain_loops(spark):
    rows = list(enumerate(texts(60)))
    df = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, window string")
    cut = recogniser.windows(df, window=10, stride=3)
    got = {}
    for r in tagger(cut).select("doc_id", "window", "tokens", "words", F.col("tags"), recogniser.joined(F.col("tokens"), F.col("tags"), F.col("part")).alias("s")).collect():
        got[r.doc_id, r.window] = ([(t.start, t.end) for t in r.tokens], [(s.text, s.entity_type, s.start, s.end, s.score) for s in r.s])
    want = {}
    for i, t in rows:
        if t is not None and len(t) <= recogniser.MOST_CHARS:
            for k, tokens in enumerate(plain_windows(t, 10, 3)):
                want[i, k] = (tokens, plain_spans(t, tokens, tag([t[a:b] for a, b in tokens])))
    assert got == want
    twice = recogniser.spans(tagger(recogniser.windows(df.unionByName(df), window=10, stride=3))).collect()  # repeated rows change nothing
    found = {r.doc_id: [(s.text, s.entity_type, s.start, s.end, s.score) for s in r.recognised] for r in twice}
    assert found == {i: s for i, _ in rows if (s := [x for (d, k), (_, ss) in sorted(want.items()) if d == i for x in ss])}
    assert any(len(s) != len(set(s)) for s in found.values())  # common parts of windows give a span twice


def test_detect_with_a_tagger(spark):
    df = spark.createDataFrame([(1, "Anna Meier a@b.org 😀 Anna"), (2, None), (3, "nothing")], "doc_id long, text string")
    found = {r.doc_id: [(s.text, s.source) for s in r.entities] for r in recogniser.detect(df, tagger, kinds=("EMAIL",)).collect()}
    assert set(found) == {1, 2, 3} and found[2] == [] and ("a@b.org", "regex") in found[1]
    assert recogniser.detect(df, tagger, kinds=("EMAIL",)).columns == ["doc_id", "text", "entities"]
    assert recogniser.detect(df.limit(0), tagger).count() == 0


def test_fused_marks_spans_of_two_windows(spark):
    span = lambda: F.struct(F.lit("Anna").alias("text"), F.lit("PERSON").alias("entity_type"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.9).alias("score"), F.lit("ner").alias("source"))
    r = spark.range(1).select(entities.fused(F.array(span(), span()).cast(entities.HOOK_SCHEMA)).alias("f")).first()
    assert len(r.f) == 1
