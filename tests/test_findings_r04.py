"""Rows on which the code of the fourth review differed or did less."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import entities, recogniser
from vellum.plans import extended

LONG = "Anna met Bo-12 at a@b.org. " * 1200  # 32,400 characters, some 13,000 tokens


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(1, LONG), (2, "Anna Meier"), (3, None), (4, "")], "doc_id long, text string").coalesce(1).write.parquet(path + "/documents.parquet")
    return path


def test_long_texts_have_windows(spark, long_texts):
    """texts of more than 25,000 characters had none, in code and SQL."""
    import duckdb

    query = extended.recogniser_spans(spark, long_texts)
    order = sorted(query.columns)
    got = query.select(*order).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{long_texts}/documents.parquet/*.parquet'")
    want = con.sql(extended.catalogue.ORACLES["recogniser_spans"]).select(*[f'"{c}"' for c in order]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.doc_id for r in got} == {1, 2} and max(r.end for r in got) > 32_000


def test_long_texts_are_recognised(spark, long_texts):
    """a tagger's spans were left out of texts of more than 25,000 characters."""
    rows = extended.pii_fused_recognised(spark, long_texts).where("doc_id = 1").collect()
    assert sum(r.entity_type == "EMAIL" for r in rows) == 1200
    assert max(r.end for r in rows if r.source == "ner") > 32_000
    assert all(LONG[r.start : r.end] == r.text for r in rows)

    def hook(body):
        span = F.struct(F.lit("Anna").alias("text"), F.lit("PER").alias("entity_type"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.9).alias("score"), F.lit("ner").alias("source"))
        return F.when(F.length(body) > 0, F.array(span)).otherwise(F.array()).cast(entities.HOOK_SCHEMA)

    docs = spark.read.parquet(f"{long_texts}/documents.parquet")
    found = entities.detect(docs, kinds=("IP_ADDRESS",), recogniser=hook).collect()
    assert {r.doc_id: len(r.entities) for r in found} == {1: 1, 2: 1, 3: 0, 4: 0}


ODD = ["D.O.D.: 12 Jan 2001", "Contract lab: Acme (x)", "Contract lab address: 7 High street", "Age:47 years;Age: 7\nDOB # 1/2/2000", "a@b.co.d@e.fr x.y.@z.org", "1.2.3.4.5 at 10.0.0.7, 256.1.1.1", "Sponsor contact phone: +1 (212) 555-0199", "Study dates: 1/2/2000 to 3/4/2001", "", "P.A.N. ABCDE1234F pan: abcde1234f", "Protocol IDPROT. X-12"]
UNICODE = {
    "Aadhaar: ١234 5678 9012": [("AADHAAR", 9, 23)],
    "ſite addreſſ: 7 High ſtreet": [("SITE_ADDRESS", 14, 27)],
    "mail é.b@ü-x.de \U0001d4b3 a@b.orǵ": [("EMAIL", 5, 15)],  # a mark goes on with a word
    "MİND ID, Member ıd: QL12345": [("HEALTH_PLAN_INSURANCE_ID", 20, 27)],
    "Dosage: ́ 5 mg of it": [("MEDICATION_DOSAGE", 8, 20)],
    "DOB 1/2/2000": [("DATE_OF_BIRTH", 4, 12)],
    "DOB\x1c1/2/2000": [],  # no white space to Java
}


def test_definitions_are_found_at_their_labels():
    """all definitions' patterns went over a text, and D.O.D. and parts of contract labs were missed by the words they were thought to need."""
    import re

    import pyarrow as pa

    from vellum.functions import detection
    from vellum.functions import patterns as P
    from vellum.plans import forms

    rng = random.Random(4)
    values = [before + re.sub(r"\{\w+\}", lambda m: str(rng.randrange(9999)), v) for before, _, _, _, vs in forms.LINES for v, _ in vs]
    many = ODD + ["".join(rng.choice(values + ODD)[rng.randrange(3) :] + rng.choice(["\n", " ", "", ", "]) for _ in range(8)) for _ in range(300)]
    want = []
    for t in many:
        row = []
        for kind, label, value, score in P.LABELLED:
            for m in re.finditer(P.pattern(label, value).replace("(?iU)", ""), t, re.IGNORECASE | re.ASCII):
                v = m[1].strip(detection.SPACES)
                if detection.valid(kind, v):
                    a = m.end() - len(m[1].lstrip(detection.SPACES))
                    row.append((v, kind, a, a + len(v), score, "regex"))
        want.append(row)
    got = [[tuple(s.values()) for s in r] for r in detection.spans_of(pa.array(many), P.LABELLED, False).to_pylist()]
    assert got == want and got[0][0][1] == "DEATH_DATE" and got[2][0][1] == "CONTRACT_LAB_NAME"
    odd = detection.entities_of(pa.array(list(UNICODE)), P.LABELLED, False).to_pylist()
    assert [[(s["entity_type"], s["start"], s["end"]) for s in r] for r in odd] == list(UNICODE.values())


def test_reports_in_one_pass(spark):
    """reports and general forms of forms went through several passes over spans, and a shuffle of all values."""
    texts = [*ODD, *UNICODE, None, "Gender: Male\nSex: Male\nGender: Female", "Age: 47 years, a@b.org", "a@b.org and Age: 47 years and a@b.org"]
    df = spark.createDataFrame([(None if i % 9 == 4 else i // 2, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    one = entities.reported(df, "s")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Aggregate" not in plan and "Window" not in plan  # the deal above and one by ids
    several = entities.change_report(entities.anonymise(entities.detect(df), "s"))
    assert one.columns == several.columns and one.dtypes == several.dtypes
    no_serial = [c for c in one.columns if c != "serial_no"]  # rows that share an id have the same places
    assert sorted(map(repr, one.select(no_serial).collect())) == sorted(map(repr, several.select(no_serial).collect()))
    alone = df.withColumn("doc_id", F.xxhash64("text")).where("text IS NOT NULL")
    assert sorted(map(repr, entities.reported(alone, "s").collect())) == sorted(map(repr, entities.change_report(entities.anonymise(entities.detect(alone), "s")).collect()))
    want = entities.anonymise(entities.detect(df), "s", "full").select("doc_id", "text", "full_text").collect()
    assert sorted(map(repr, entities.full_texts(df).collect())) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        entities.reported(df, "")


def test_spans_that_may_be_empty_fuse_as_in_columns(spark):
    """fusion over flat arrays against the columns of one document, with empty spans too."""
    import numpy as np

    from vellum.functions import detection

    rng = random.Random(3)
    docs = [[(a, a + rng.randrange(0, 6), rng.choice([0.8, 0.82, 0.9])) for a in (rng.randrange(14) for _ in range(rng.randrange(9)))] for _ in range(400)]
    rows = spark.createDataFrame([(i, [("t", "X", a, b, s, "regex") for a, b, s in d]) for i, d in enumerate(docs)], f"i int, spans {entities.HOOK_SCHEMA}")
    want = {r.i: [(x.start, x.end, x.score, x.source) for x in r.f] for r in rows.select("i", entities.fused(F.col("spans")).alias("f")).collect()}
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.array([x for d in docs for x in d])
    kept, score, two = detection.fuse(row, flat[:, 0].astype(int), flat[:, 1].astype(int), flat[:, 2])
    got = {i: [] for i in range(len(docs))}
    for k, s, t in zip(kept, score, two):
        got[row[k]].append((int(flat[k, 0]), int(flat[k, 1]), s, "hybrid" if t else "regex"))
    assert got == want


def test_a_tagger_in_one_pass(spark, monkeypatch):
    """windows, tags and spans were rows and columns of Spark; texts and all spans were shuffled to meet."""
    from vellum.functions import detection

    rng = random.Random(6)
    parts = ["Anna", "bo", "12", "x", ".", "-", "é", "Sponsor", "sponſor", "Meier-Huber", "A", "\n", "  ", "😀", "@", "a@b.org", "10.0.0.7", "10.0.0.7é", "a.b@c.de.", "ORG", "K1"]
    texts = [None, "", "   ", "one", "é", LONG[:3000]] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[8]), (9, texts[10]), (None, texts[11]), (None, texts[12]), (8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    cut = {"window": 10, "stride": 3}
    tagger = extended._stand_in
    want = recogniser.detect(df, tagger, kinds=("EMAIL", "IP_ADDRESS"), **cut).select("doc_id", F.inline("entities")).collect()
    many = tagger(recogniser.windows(df, **cut)).select("doc_id", F.col("window").alias("win"), F.inline(recogniser.joined(F.col("tokens"), F.col("tags"), F.col("part"))))
    want_windows = many.select("doc_id", "win", "entity_type", F.col("text").alias("value"), "start", "end", "score").collect()
    shared = {7, 9, None}  # of windows with one number in texts of one id, the order is open
    plain = lambda found: sorted(map(repr, [r for r in found if r.doc_id not in shared]))
    kept = lambda found: {(r.doc_id, r.start, r.end) for r in found if r.doc_id in shared}
    for most in (1 << 20, 300, 1):  # slices of many texts, few and one
        monkeypatch.setattr(detection, "SLICE_BYTES", most)
        monkeypatch.setattr(detection.slices, "__defaults__", (most,))
        import pyarrow as pa

        from vellum.functions import tagging

        found = recogniser.entity_rows(df, tagger, kinds=("EMAIL", "IP_ADDRESS"), **cut)
        assert found.schema == spark.createDataFrame([], found.schema).schema and found.columns == want[0].__fields__
        assert plain(found.collect()) == plain(want) and len(plain(want)) > 1000
        ids = sorted({r for r, _ in rows if r is not None})
        ordered = [(i, t) for i in [*ids, None] for j, t in rows if j == i]
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in ordered], pa.int32()), "text": pa.array([t for _, t in ordered], pa.string())})
        schema = recogniser._schema(df, "doc_id", recogniser.SPAN.removeprefix("struct<").removesuffix(">"))[1]
        here = [r for b in tagging.entity_rows(iter([batch.slice(0, 5), batch.slice(5)]), tagger.tag, entities.definitions(("EMAIL", "IP_ADDRESS")), 10, 3, 0.75, schema) for r in b.to_pylist()]
        assert sorted((r["doc_id"], r["start"], r["end"], r["text"], r["entity_type"], r["score"], r["source"]) for r in here if r["doc_id"] not in shared) == sorted((r.doc_id, r.start, r.end, r.text, r.entity_type, r.score, r.source) for r in want if r.doc_id not in shared)
        assert {(r["doc_id"], r["start"], r["end"]) for r in here if r["doc_id"] in shared} == kept(found.collect()) == kept(want)
        assert sorted(map(repr, recogniser.window_spans(df, tagger, **cut).collect())) == sorted(map(repr, want_windows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Aggregate" not in plan and "Join" not in plan  # the deal above and one by ids
    with pytest.raises(ValueError):
        recogniser.entity_rows(df, tagger, window=3, stride=3)


def test_tags_of_any_labels_join_in_one_pass(spark):
    """runs of tokens over flat arrays against the columns, with nulls, unknown labels and halves in scores."""
    import pyarrow as pa

    def tag(words):
        labels = ["O", "B-PER", "I-PER", "PER", "B-DATE", "DATE", "X-Y-Z", None, "loc", ""]
        flat = words.flatten().to_pylist()
        score = [None if len(w) == 4 else 0.75 + (sum(map(ord, w)) % 40) * 0.00005 - (w == "b") * 0.01 for w in flat]
        tags = pa.StructArray.from_arrays([pa.array([labels[sum(map(ord, w)) % 10] for w in flat], pa.string()), pa.array(score, pa.float64())], ["label", "score"])
        upto = words.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(upto - upto[0]), tags)

    rng = random.Random(8)
    texts = ["".join(rng.choice("abéß.-@1 ") for _ in range(rng.randrange(200))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tagger = recogniser.InArrow(tag)
    many = tagger(recogniser.windows(df, window=20, stride=5)).select("doc_id", F.col("window").alias("win"), F.inline(recogniser.joined(F.col("tokens"), F.col("tags"), F.col("part"))))
    want = many.select("doc_id", "win", "entity_type", F.col("text").alias("value"), "start", "end", "score").collect()
    assert sorted(map(repr, recogniser.window_spans(df, tagger, window=20, stride=5).collect())) == sorted(map(repr, want)) and len(want) > 500
