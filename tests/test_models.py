"""Model calls, batches, JSON and index changes."""

import datetime
import decimal
import hashlib
import json
import math
import threading
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import models


def answerer(prompt):
    if "bad" in prompt:
        raise RuntimeError("no answer")
    return '{"a": 1}' if "json" in prompt else f"said {prompt}"


def test_called(spark):
    rows = [(i, p) for i, p in enumerate(["json one", "bad two", None, "", "plain", "bad", "json " + "x" * 100_000])]
    df = spark.createDataFrame(rows, "id long, prompt string")
    got = {r.id: (r.answer, r.error) for r in models.called(df, "prompt", answerer).collect()}
    assert got == {0: ('{"a": 1}', None), 1: (None, "RuntimeError: no answer"), 2: (None, None), 3: ("said ", None), 4: ("said plain", None), 5: (None, "RuntimeError: no answer"), 6: ('{"a": 1}', None)}
    assert models.called(df.limit(0), "prompt", answerer).count() == 0
    other = models.called(df.withColumn("answer", F.lit("x")), "prompt", answerer, "reply", "failure")
    assert other.columns == ["id", "prompt", "answer", "reply", "failure"]


def test_calls_of_a_task_run_side_by_side(spark):
    def slow(prompt):
        now = slow.__dict__.setdefault("now", [0, 0, threading.Lock()])
        with now[2]:
            now[0] += 1
            now[1] = max(now[1], now[0])
        time.sleep(0.05)
        with now[2]:
            now[0] -= 1
        return str(now[1])

    most = [int(r.answer) for r in models.called(spark.range(40).select(F.col("id").cast("string").alias("p")).coalesce(1), "p", slow, at_once=4).collect()]
    assert max(most) == 4


def test_json_answer(spark):
    given = ['{"a": 1}', 'Here:\n```json\n{"a": {"b": [1]}}\n```\nDone.', "no json", '{"a": ', "", None, "[1]"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(given)], "id int, answer string").select("id", models.json_answer(F.col("answer")).alias("j"))
    got = {r.id: (r.v, r.error, r.raw_response) for r in df.select("id", F.to_json("j.value").alias("v"), "j.error", "j.raw_response").collect()}
    assert got[0] == ('{"a":1}', None, None) and got[1] == ('{"a":{"b":[1]}}', None, None) and got[5] == (None, None, None)
    for i in (2, 3, 4, 6):
        assert got[i] == (None, models.NOT_JSON, given[i])


def test_field_verdicts_and_overall_summaries(spark):
    rows = [(0, "Dose", '{"Dose": "10 mg", "consistency": "Inconsistent"}', None), (1, "Dose", '{"Dose": "10 mg"}', None), (2, "Dose", None, "RuntimeError: x"), (3, "Dose", "prose", None)]
    df = spark.createDataFrame(rows, "id int, field string, answer string, error string")
    got = {r.id: (r.value, r.consistency) for r in models.field_verdicts(df).collect()}
    assert got == {0: ("10 mg", "Inconsistent"), 1: ("10 mg", "Consistent"), 2: ("Error: RuntimeError: x", "Consistent"), 3: (f"Error: {models.NOT_JSON}", "Consistent")}
    rows = [(0, '{"value": "All well.", "confidence": "high", "source": ["p1"]}', None), (1, "prose", None), (2, None, "E: x"), (3, '{"error": "limit"}', None), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, answer string, error string").select("id", models.overall_summary(F.col("answer"), F.col("error")).alias("s"))
    got = {r.id: (r.s.value, r.s.confidence, r.s.source) for r in df.collect()}
    assert got == {0: ("All well.", "high", ["p1"])} | {i: (models.NO_SUMMARY, "low", []) for i in (1, 2, 3, 4)}


def test_batch_goes_on_and_counts(spark):
    files = spark.createDataFrame([("a.pdf", "one"), ("b.PDF", "bad"), ("c.txt", "three"), (None, "four"), ("d.pdf", "five")], "path string, content string")
    rows, seen = models.batch(files, "path", lambda f: models.called(f, "content", answerer))
    got = {(r.path, r.answer, r.error, r.skipped) for r in rows.collect()}
    assert got == {("a.pdf", "said one", None, False), ("b.PDF", None, "RuntimeError: no answer", False), ("c.txt", None, None, True), (None, None, None, True), ("d.pdf", "said five", None, False)}
    assert models.message(seen) == "Successfully processed 2 of 5 files."
    rows, seen = models.batch(files.limit(0), "path", lambda f: models.called(f, "content", answerer))
    rows.collect()
    assert models.message(seen) == "Successfully processed 0 of 0 files."


def test_json_safe(spark):
    inner = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("b", T.BinaryType())])
    schema = T.StructType([
        T.StructField("f", T.FloatType()), T.StructField("d", T.DecimalType(10, 2)), T.StructField("t", T.TimestampType()), T.StructField("day", T.DateType()),
        T.StructField("a", T.ArrayType(inner)), T.StructField("m", T.MapType(T.IntegerType(), T.ArrayType(T.DoubleType()))), T.StructField("s", inner), T.StructField("odd.name", T.DoubleType()),
    ])
    rows = [
        (float("nan"), decimal.Decimal("1.50"), datetime.datetime(2020, 1, 2, 3, 4, 5, 6), datetime.date(2020, 1, 2), [(math.inf, b"ab"), None, (1.5, None)], {1: [math.nan, 2.0], 2: None}, (-math.inf, b""), math.inf),
        (None,) * 8,
    ]
    df = models.json_safe(spark.createDataFrame(rows, schema))
    assert df.columns == schema.names
    out = [json.loads(x) for x in df.toJSON().collect()]  # strict: NaN would not be JSON
    assert json.dumps(out, allow_nan=False)
    first = next(o for o in out if o)
    assert first["d"] == 1.5 and first["t"] == "2020-01-02T03:04:05.000006" and first["day"] == "2020-01-02"
    assert first["a"] == [{"b": "YWI="}, None, {"x": 1.5}] and "f" not in first and "odd.name" not in first
    assert dict(df.dtypes)["m"] == "map<string,array<double>>" and first["m"]["1"] == [None, 2.0]
    assert {} in out


def test_index_follows_its_items(spark):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    items = spark.createDataFrame([("a", "same"), ("b", "new text"), ("c", "fresh"), ("e", None), (None, "nameless"), ("c", "fresh")], "key string, content string")
    index = spark.createDataFrame([("a", sha(b"same"), "m1", [1.0]), ("b", sha(b"old text"), "m1", [2.0]), ("d", sha(b"x"), "m1", [3.0])], "key string, digest string, model string, vector array<double>")
    got = {r.key: (r.digest, r.status) for r in models.changes(items, index, "m1").collect()}
    assert got == {"a": (sha(b"same"), "same"), "b": (sha(b"new text"), "changed"), "c": (sha(b"fresh"), "new"), "d": (sha(b"x"), "gone"), "e": (sha(b""), "new"), None: (sha(b"nameless"), "new")}
    asked = spark.sparkContext.accumulator(0)

    def embed(df):
        def run(batches):
            for b in batches:
                asked.add(len(b))
                yield b.assign(vector=[[float(len(c or ""))] for c in b["content"]])[["key", "vector"]]

        return df.mapInPandas(run, "key string, vector array<double>")

    after = models.refreshed(items, index, embed, "m1").collect()
    assert {r.key: (r.digest, r.model, r.vector) for r in after} == {"a": (sha(b"same"), "m1", [1.0]), "b": (sha(b"new text"), "m1", [8.0]), "c": (sha(b"fresh"), "m1", [5.0]), "e": (sha(b""), "m1", [0.0]), None: (sha(b"nameless"), "m1", [8.0])}
    assert asked.value == 4  # only what changed
    assert {r.status for r in models.changes(items, index, "m2").where("key = 'a'").collect()} == {"changed"}  # another model
