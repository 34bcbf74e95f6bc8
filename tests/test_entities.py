"""Detection, fusion and anonymisation against direct statements of their rules."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions.text import SPAN, finditer, splice
from vellum.operators import entities as E


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def found(spark, text, kinds=None):
    return [(e.entity_type, e.text, e.start, e.end) for e in E.detect(texts(spark, text), kinds=kinds).first().entities]


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("Age: 47 years", "AGE", "47 years"),
        ("Age: 7", "AGE", None),
        ("Age: 104", "AGE", "104"),
        ("Diagnosis: Hypertension", "DIAGNOSIS_CONDITION", None),
        ("Diagnosis: Type-2 diabetes mellitus", "DIAGNOSIS_CONDITION", "Type-2 diabetes mellitus"),
        ("BP: 120/80 mmHg", "VITAL_SIGNS", None),
        ("BP: 120/80 mmHg supine", "VITAL_SIGNS", "120/80 mmHg supine"),
        ("Subject ID: yes", "SUBJECT_ID", None),
        ("Subject ID: AB-123", "SUBJECT_ID", "AB-123"),
        ("mail a.b@site.org now", "EMAIL", "a.b@site.org"),
        ("at 10.0.0.7.", "IP_ADDRESS", "10.0.0.7"),
        ("xa.b@site.org", "EMAIL", "xa.b@site.org"),
    ],
)
def test_values(spark, text, kind, value):
    got = [f for f in found(spark, text, [kind])]
    assert [g[1] for g in got] == ([value] if value else [])
    for _, v, s, e in got:
        assert text[s:e] == v


def test_offsets_equal_finditer(spark):
    rnd = random.Random(1)
    rows = ["".join(rnd.choice("ab1 é😀@.\n") for _ in range(50)) for _ in range(100)] + [""]
    for pattern in (r"(\d+)", r"a\s*(b+)", r"[ab]+@([a-z]+)"):
        for r in texts(spark, *rows).select("text", finditer(F.col("text"), pattern).alias("m")).collect():
            assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m.group(1)) for m in re.finditer(pattern, r.text)]


def fuse(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], -s[2])):
        over = [k for k in kept if k[0] < s[1] and s[0] < k[1]]
        for k in over:
            if (k[0], k[1]) == (s[0], s[1]):
                k[3], k[2] = "hybrid", max(k[2], s[2])
        if all(k[2] < s[2] for k in over):
            kept = [k for k in kept if k not in over] + [list(s)]
    return kept


def test_fusion(spark):
    rnd = random.Random(2)
    cases = [[(a, a + rnd.randrange(1, 6), rnd.choice([0.8, 0.82, 0.9]), "regex") for a in (rnd.randrange(12) for _ in range(rnd.randrange(8)))] for _ in range(300)]
    cases += [[(0, 10, 0.80, "regex"), (5, 12, 0.93, "regex")], [(0, 5, 0.90, "regex"), (0, 5, 0.82, "regex")]]
    rows = spark.createDataFrame([(i, [("t", "X", a, b, s, src) for a, b, s, src in c]) for i, c in enumerate(cases)], f"i int, spans array<{SPAN}>")
    for r in rows.select("i", E.fused(F.col("spans")).alias("f")).collect():
        assert [[x.start, x.end, x.score, x.source] for x in r.f] == fuse(cases[r.i])
        ends = sorted((x.start, x.end) for x in r.f)
        assert all(p[1] <= q[0] for p, q in zip(ends, ends[1:]))


def test_generalised(spark):
    rows = [("AGE", "47 years", "40-49"), ("AGE", "104", "100-109"), ("EMAIL", "a.b@site.org", "****@site.org"), ("IP_ADDRESS", "10.0.0.7", "XXX.XXX.XXX.XXX"), ("DIAGNOSIS_CONDITION", "Type-2 diabetes mellitus", "common endocrine disorder"), ("DATE_OF_BIRTH", "1/2/2000", "[DATE_REDACTED]"), ("CRO_NAME", "x", "[CRO_NAME_REDACTED]")]
    frame = spark.createDataFrame(rows, "k string, v string, want string")
    assert all(r.g == r.want for r in frame.select("want", E.generalised(F.col("k"), F.col("v")).alias("g")).collect())


def test_tokens_and_reidentification(spark):
    frame = texts(spark, "x@y.io", "write x@y.io or x@y.io, at 10.0.0.7", "nothing", "")
    done = E.anonymise(E.detect(frame, kinds=["EMAIL", "IP_ADDRESS"]), "s").collect()
    assert done[0].pseudo_text == "EML_136331C3" == "EML_" + hmac.new(b"s", b"x@y.io", hashlib.sha256).hexdigest()[:8].upper()
    assert done[1].full_text == "write ****@y.io or ****@y.io, at XXX.XXX.XXX.XXX"
    back = E.anonymise(E.detect(frame, kinds=["EMAIL", "IP_ADDRESS"]), "s").select("text", E.reidentified(F.col("pseudo_text"), F.col("mapping")).alias("b"))
    assert all(r.b == r.text for r in back.collect())
    with pytest.raises(ValueError):
        E.anonymise(frame, "")


def test_report_counts_values(spark):
    report = E.change_report(E.anonymise(E.detect(texts(spark, "b@y.io a@y.io b@y.io"), kinds=["EMAIL"]), "s")).orderBy("serial_no").collect()
    assert [(r.serial_no, r.original_value, r.occurrences) for r in report] == [(1, "b@y.io", 2), (2, "a@y.io", 1)]


def test_recogniser_hook(spark):
    def model(text):
        return F.array(F.struct(F.lit("John Doe").alias("text"), F.lit("B-PER").alias("entity_type"), F.lit(0).alias("start"), F.lit(8).alias("end"), F.lit(0.9).alias("score"), F.lit("ner").alias("source"))).cast(f"array<{SPAN}>")

    got = E.detect(texts(spark, "John Doe, x@y.io"), kinds=["EMAIL"], recogniser=model).first().entities
    assert [(e.entity_type, e.source) for e in got] == [("PERSON", "ner"), ("EMAIL", "regex")]


def test_splice(spark):
    row = spark.createDataFrame([("héllo wörld", [("x", "X", 0, 5, 1.0, "r"), ("y", "X", 6, 11, 1.0, "r")])], f"t string, s array<{SPAN}>")
    assert row.select(splice(F.col("t"), F.col("s"), lambda s: F.upper(s["text"])).alias("o")).first().o == "X Y"


def test_whole_words(spark):
    row = texts(spark, "an anna ann an.").select(E.replace_words(F.col("text"), {"an": "X", "ann": "Y$1"}).alias("o")).first()
    assert row.o == "X anna Y$1 X."


def test_catalogue(spark):
    assert E.catalogue(spark).count() == 74 and len(P.LABELLED) == 76
    assert E.catalogue(spark).where("entity_type = 'PATIENT_NAME_REGIONAL_FORMS'").count() == 1


def test_table_rows(spark):
    rows = spark.createDataFrame([(1, ["Age", "47 years"]), (2, ["Age: 55", "x"])], "row_id int, cells array<string>")
    got = {(r.row_id, r.cell, r.cell_start, r.value) for r in E.table_row_spans(rows, ["AGE"]).collect()}
    assert got == {(1, 1, 0, "47 years"), (2, 0, 5, "55")}
