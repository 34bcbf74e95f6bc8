"""Sensitive entities in text: detection, fusion of spans, pseudonyms, generalised forms and reports.

Everything up to the reports is one narrow projection over a document: spans
are an array of structs beside the text, and rows are made of it only where a
report counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import detection
from vellum.functions import patterns as P
from vellum.functions.text import SPAN, canonical_type, display_label, finditer, let, splice
from vellum.session import ship, tasks

HOOK_SCHEMA = "array<" + SPAN + ">"


def valid(kind: Column, value: Column) -> Column:
    """Whether a labelled value counts as an entity of its type."""
    return let(F.lower(value), lambda low: _valid(kind, value, low))


def _valid(kind: Column, value: Column, low: Column) -> Column:
    among = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: low.contains(p))
    words = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
    always = (F.length(value) > 0) & ~value.rlike(P.DOTS) & ~value.rlike(P.MARKS_ONLY) & ~low.rlike(P.BRACKETED)
    broad = (F.length(F.regexp_replace(value, "[^A-Za-z0-9]+", "")) >= 4) & ~value.rlike(P.SHORT_NUMBER) & ~among(P.NOISE)
    long = ((words > 2) | (F.length(value) >= 18)) & (F.length(value) <= 90)
    own = (
        F.when(kind == "MEDICATION_DOSAGE", low.rlike(P.DOSE) | among(P.MEDICATION_HINTS))
        .when(kind == "VITAL_SIGNS", among(P.VITAL_HINTS) | value.rlike(P.READING))
        .when(kind == "DIAGNOSIS_CONDITION", low.rlike(P.DIAGNOSIS_WORDS))
        .when(kind == "AGE", F.coalesce(F.regexp_extract(value, r"\d+", 0).try_cast("int").between(10, 120), F.lit(False)))
        .when(kind.isin(*P.NUMBERED_IDS), ~low.isin("yes", "no", "na", "n/a") & value.rlike(r"\d"))
        .otherwise(F.lit(True))
    )
    return always & (~kind.isin(*P.BROAD) | broad) & (~kind.isin(*P.SHORT_REJECTED) | long) & own


def definitions(kinds: Sequence[str] | None) -> tuple[tuple[str, str, str, float], ...]:
    """All definitions, or those of some types."""
    return tuple(d for d in P.LABELLED if kinds is None or d[0] in kinds)


def regex_spans(text: Column, kinds: Sequence[str] | None = None, word_bounded: bool = False) -> Column:
    """All valid spans of the definitions (or of some types), in the definitions' order.

    Definitions with a label are found in batches, in Python (``detection``); a
    text is searched for the others only if it has a sign of them.
    """
    chosen = definitions(kinds)
    empty = F.array().cast(HOOK_SCHEMA)
    if not chosen:
        return F.when(text.isNotNull(), empty).otherwise(empty)
    if any(label for _, label, _, _ in chosen):
        return F.arrow_udf(lambda t: detection.spans_of(t, chosen, word_bounded), HOOK_SCHEMA)(F.coalesce(text, F.lit("")))

    def span(m: Column, kind: str, score: float) -> Column:
        left = F.regexp_replace(m["value"], r"(?U)^\s+", "")
        both = F.regexp_replace(left, r"(?U)\s+$", "")
        start = m["end"] - F.length(left)
        return F.struct(both.alias("text"), F.lit(kind).alias("entity_type"), start.alias("start"), (start + F.length(both)).alias("end"), F.lit(score).alias("score"), F.lit("regex").alias("source"))

    def found(kind: str, value: str, score: float) -> Column:
        sign = {"EMAIL": "@", "IP_ADDRESS": r"\d\.\d"}[kind]
        spans = F.filter(F.transform(finditer(text, P.pattern("", value)), lambda m: span(m, kind, score)), lambda x: valid(F.lit(kind), x["text"])).cast(HOOK_SCHEMA)
        return F.when(F.rlike(text, F.lit(f"(?iU){sign}")), spans).otherwise(empty)

    return F.concat(*[found(kind, value, score) for kind, _, value, score in chosen]).cast(HOOK_SCHEMA)


def recognised(spans: Column) -> Column:
    """A recogniser's spans with canonical types: too short, uncertain and spurious ones and plain dates are left out."""
    names = F.create_map(*[F.lit(x) for pair in P.RECOGNISER_LABELS.items() for x in pair])
    kept = F.filter(spans, lambda s: (s["score"] >= 0.75) & (F.length(F.btrim(s["text"])) >= 2) & ~F.lower(F.btrim(s["text"])).isin(*P.RECOGNISER_SPURIOUS))
    named = F.transform(kept, lambda s: s.withField("entity_type", F.coalesce(F.try_element_at(names, s["entity_type"]), s["entity_type"])))
    return F.filter(named, lambda s: s["entity_type"] != "DATE")


def fused(spans: Column) -> Column:
    """Disjoint spans: in order of start, then score from above, a span displaces those that it overlaps if it beats them all.

    A span with exactly the range of a kept one never displaces it, but marks it
    as hybrid and lifts its score.
    """
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["score"]).alias("b"), i.alias("c"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    overlap = lambda x, c: (x["start"] < c["end"]) & (c["start"] < x["end"])
    same = lambda x, c: (x["start"] == c["start"]) & (x["end"] == c["end"])

    def step(kept: Column, c: Column) -> Column:
        beaten = F.forall(kept, lambda x: ~overlap(x, c) | (~same(x, c) & (x["score"] < c["score"])))
        marked = F.transform(kept, lambda x: F.when(same(x, c), x.withField("source", F.lit("hybrid")).withField("score", F.greatest(x["score"], c["score"]))).otherwise(x))
        return F.when(beaten, F.concat(F.filter(kept, lambda x: ~overlap(x, c)), F.array(c))).otherwise(marked)

    return F.aggregate(ordered, F.array().cast(HOOK_SCHEMA), step)


def isolated(text: Column, spans: Column) -> Column:
    """Spans with no letter, digit or underscore right before or after them, in order of start."""
    word = r"(?U)[\w]"
    free = F.filter(spans, lambda s: ((s["start"] == 0) | ~F.substring(text, s["start"], F.lit(1)).rlike(word)) & ~F.substring(text, s["end"] + 1, F.lit(1)).rlike(word))
    return F.array_sort(free, lambda a, b: a["start"] - b["start"])


def spread(df: DataFrame) -> DataFrame:
    """df in tasks for all cores: all definitions take long for a text, and a file of few row groups would give few tasks."""
    return df.repartition(tasks(df.sparkSession))


def detect(df: DataFrame, text: str = "text", kinds: Sequence[str] | None = None, word_bounded: bool = False, recogniser: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with ``entities``: disjoint, isolated spans of its text.

    recogniser is a hook: a function of the text column that gives an array of
    spans of its own, such as a pandas UDF around a model.
    """
    if kinds is None:
        df = spread(df)
    body, chosen = F.coalesce(F.col(text), F.lit("")), definitions(kinds)
    if any(label for _, label, _, _ in chosen):
        ship(df.sparkSession)
        if recogniser is None:
            return df.withColumn("entities", F.arrow_udf(lambda t: detection.entities_of(t, chosen, word_bounded), HOOK_SCHEMA)(body))
    found = regex_spans(body, kinds, word_bounded)
    if recogniser is not None:
        found = F.concat(found, recognised(recogniser(body)))
    df = df.withColumn("_spans", found).withColumn("_spans", fused(F.col("_spans")))
    return df.withColumn("entities", isolated(body, F.col("_spans"))).drop("_spans")


def generalised(kind: Column, value: Column) -> Column:
    """A value's general form by its type."""
    first = F.regexp_extract(value, r"\d+", 0)
    decade = F.floor(first.try_cast("long") / 10) * 10
    age = F.when(first != "", F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string"))).otherwise(F.lit("[AGE_RANGE]"))
    parts = F.split(value, "@")
    mail = F.concat(F.lit("****@"), F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.lit("redacted.com")))
    condition = F.lit("medical condition")
    for pattern, name in reversed(P.CONDITIONS):
        condition = F.when(F.lower(value).rlike(pattern), F.lit(name)).otherwise(condition)
    constants = F.create_map(*[F.lit(x) for pair in P.CONSTANT_FORMS.items() for x in pair])
    return (
        F.when(kind.isin(*P.PHI_DATES), F.lit("[DATE_REDACTED]"))
        .when(kind == "AGE", age)
        .when(kind == "EMAIL", mail)
        .when(kind.isin(*P.DIAGNOSES), condition)
        .otherwise(F.coalesce(F.try_element_at(constants, kind), F.concat(F.lit("["), F.coalesce(F.nullif(canonical_type(kind), F.lit("")), F.lit("ENTITY")), F.lit("_REDACTED]"))))
    )


def hmac_sha256(key: str, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a text."""
    import hashlib

    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def token(kind: Column, value: Column, salt: str) -> Column:
    """The pseudonym of a value: a prefix of its type and eight digits that depend on salt and value."""
    prefixes = F.create_map(*[F.lit(x) for pair in P.PREFIXES.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(prefixes, kind), F.lit("ENT")), F.lit("_"), F.upper(F.left(hmac_sha256(salt, value), F.lit(8))))


def anonymise(df: DataFrame, salt: str, mode: str = "both", text: str = "text") -> DataFrame:
    """df (with entities) with ``pseudo_text`` and ``mapping``, ``full_text``, or both.

    A value has one token in a document, and its last occurrence decides on the
    token's type.  A salt is needed: random tokens would change whenever Spark
    computes a row again.
    """
    if not salt:
        raise ValueError("a salt is needed for tokens that stay the same")
    if mode not in ("pseudo", "full", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    body = F.coalesce(F.col(text), F.lit(""))
    if mode != "full":
        last = F.aggregate(F.reverse("entities"), F.array().cast(HOOK_SCHEMA), lambda kept, s: F.when(F.exists(kept, lambda x: x["text"] == s["text"]), kept).otherwise(F.concat(kept, F.array(s))))
        entry = lambda s: F.struct(token(s["entity_type"], s["text"], salt).alias("token"), s["text"].alias("original_value"), s["entity_type"].alias("entity_type"), s["source"].alias("source"), F.round(s["score"], 4).alias("score"))
        df = df.withColumn("mapping", F.transform(last, entry))
        table = F.map_from_arrays(F.transform("mapping", lambda m: m["original_value"]), F.transform("mapping", lambda m: m["token"]))
        df = df.withColumn("pseudo_text", let(table, lambda t: splice(body, F.col("entities"), lambda s: F.try_element_at(t, s["text"]))))
    if mode != "pseudo":
        df = df.withColumn("full_text", splice(body, F.col("entities"), lambda s: generalised(s["entity_type"], s["text"])))
    return df


def reidentified(text: Column, mapping: Column) -> Column:
    """A pseudonymised text with each token of the mapping replaced by its original."""
    return F.aggregate(mapping, text, lambda t, m: F.replace(t, m["token"], m["original_value"]))


def change_report(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each value of a document (anonymised in mode both), in order of first occurrence, with its count."""
    tokens = F.map_from_arrays(F.transform("mapping", lambda m: m["original_value"]), F.transform("mapping", lambda m: m["token"]))
    own = let(tokens, lambda t: F.transform("entities", lambda e: F.struct(e.alias("e"), F.try_element_at(t, e["text"]).alias("token"))))
    rows = df.select(doc_id, F.posexplode_outer(own).alias("ord", "x")).where("ord IS NOT NULL").select(doc_id, "ord", "x.e", "x.token")
    once = rows.groupBy(doc_id, F.col("e.text").alias("original_value")).agg(F.min(F.struct("ord", "e.entity_type", "e.source", "e.score")).alias("f"), F.count("*").alias("occurrences"), F.max("token").alias("pseudo_value"))
    serial = F.row_number().over(Window.partitionBy(doc_id).orderBy("f.ord"))
    pseudo = F.col("pseudo_value")
    return once.select(
        doc_id,
        serial.cast("int").alias("serial_no"),
        F.col("f.entity_type").alias("entity_type"),
        "original_value",
        pseudo.alias("pseudo_value"),
        generalised(F.col("f.entity_type"), F.col("original_value")).alias("full_anon_value"),
        F.col("f.source").alias("detection_source"),
        F.round("f.score", 4).alias("confidence"),
        F.col("occurrences").cast("long").alias("occurrences"),
    )


def full_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``full_text``, as ``anonymise`` in mode full makes it of what all definitions find, in one pass over batches."""
    chosen = definitions(None)
    ship(df.sparkSession)
    return spread(df).withColumn("full_text", F.arrow_udf(lambda t: detection.full_texts(t, chosen), "string")(F.coalesce(F.col(text), F.lit(""))))


def reported(df: DataFrame, salt: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``change_report`` of what all definitions find, in one pass over batches.

    Texts are shuffled once, by their ids, so that rows of one id are read one
    behind the other; neither spans nor values are.
    """
    if not salt:
        raise ValueError("a salt is needed for tokens that stay the same")
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    chosen = definitions(None)
    ship(df.sparkSession)
    rest = "serial_no int, entity_type string, original_value string, pseudo_value string, full_anon_value string, detection_source string, confidence double, occurrences long"
    schema = StructType([df.schema[doc_id], *StructType.fromDDL(rest)])
    columns: pa.Schema = to_arrow_schema(schema)
    rows = df.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text")).repartition(tasks(df.sparkSession), doc_id).sortWithinPartitions(doc_id)
    found = rows.mapInArrow(lambda batches: detection.reports(batches, chosen, salt, columns), schema)
    return found.withColumn("confidence", F.round("confidence", 4))


def exploded(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each span.

    The outer form, since the plain one lets Spark filter by the array's size
    first, for which it would detect everything twice.
    """
    return df.select(doc_id, F.inline_outer("entities")).where("entity_type IS NOT NULL")


def type_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_values"))


def source_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("source").agg(F.count("*").alias("n"))


def totals(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count_distinct("text").alias("unique_values"), F.count_distinct("entity_type").alias("unique_types"), F.count("*").alias("spans"))


def label_rollup(spans: DataFrame) -> DataFrame:
    """Spans by display label."""
    return spans.groupBy(display_label(F.col("entity_type")).alias("label")).agg(F.count("*").alias("n"))


def catalogue(spark: SparkSession) -> DataFrame:
    """Known fields: label, entity_type, category."""
    rows = [(label, category) for category, labels in P.CATALOGUE.items() for label in labels]
    return spark.createDataFrame(rows, "label string, category string").select("label", canonical_type(F.col("label")).alias("entity_type"), "category")


def legend(spans: DataFrame) -> DataFrame:
    """Types found, with their count and category; types outside the catalogue have an empty one."""
    found = type_summary(spans).select("entity_type", "n")
    known = catalogue(spans.sparkSession).select("entity_type", "category")
    return found.join(F.broadcast(known), "entity_type", "left").select("entity_type", "n", F.coalesce("category", F.lit("")).alias("category"))


def mapping_sheet(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of the mapping: row number in the document, token, original, type."""
    rows = df.select(doc_id, F.posexplode("mapping").alias("pos", "m"))
    return rows.select(doc_id, (F.col("pos") + 1).alias("row_no"), "m.token", "m.original_value", "m.entity_type")


def replace_words(text: Column, replacements: dict[str, str]) -> Column:
    """text with whole words replaced, longest original first."""
    import re

    for old in sorted(replacements, key=len, reverse=True):
        if old:
            text = F.regexp_replace(text, F.lit(rf"(?U)(?<!\w){re.escape(old)}(?!\w)"), F.lit(replacements[old].replace("\\", "\\\\").replace("$", "\\$")))
    return text


def spans_in_paragraphs(spans: DataFrame, paragraphs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Spans that lie within one paragraph (doc, para, p_start, p_end), with offsets in it; others are dropped."""
    inside = (spans["start"] >= paragraphs["p_start"]) & (spans["end"] <= paragraphs["p_end"])
    rows = spans.join(paragraphs, (spans[doc_id] == paragraphs[doc_id]) & inside).drop(paragraphs[doc_id])
    return rows.withColumn("local_start", F.col("start") - F.col("p_start")).withColumn("local_end", F.col("end") - F.col("p_start"))


def paragraph_offsets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs (lines) of each text with their offsets: a line feed counts one character."""
    rows = df.select(doc_id, F.posexplode(F.split(text, "\n")).alias("para", "paragraph"))
    before = F.coalesce(F.sum(F.length("paragraph") + 1).over(Window.partitionBy(doc_id).orderBy("para").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("p_start", before.cast("int")).withColumn("p_end", (F.col("p_start") + F.length("paragraph")).cast("int"))


def words_under_spans(words: DataFrame, spans: DataFrame, doc_id: str = "doc_id", width: int = 64) -> DataFrame:
    """Words (w_start, w_end and a box on a page) that overlap spans, as one box for each span and page.

    Both sides are dealt to stretches of ``width`` characters that they touch, so
    a span meets the words near it only; a pair that shares several counts in the
    first.  Rows without an id meet each other.
    """
    stretch = lambda a, b: F.sequence(F.floor(a / width), F.floor((F.greatest(b, a + 1) - 1) / width))
    w = words.select(F.col(doc_id).alias("_doc"), "page", "x0", "y0", "x1", "y1", "w_start", "w_end", F.explode(stretch(F.col("w_start"), F.col("w_end"))).alias("_at"))
    s = spans.select(doc_id, "start", "end", F.explode(stretch(F.col("start"), F.col("end"))).alias("bin"))
    first = F.greatest(F.floor(F.col("w_start") / width), F.floor(F.col("start") / width)) == F.col("bin")
    meet = (F.col("w_start") < F.col("end")) & (F.col("start") < F.col("w_end"))
    rows = s.join(w, F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.col("bin") == F.col("_at")) & first & meet)
    return rows.groupBy(doc_id, "start", "end", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def table_row_spans(rows: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Detection over table rows (row_id, cells): cells joined by tabs, hits mapped back to their cell."""
    joined = rows.withColumn("text", F.array_join("cells", "\t"))
    found = detect(joined, kinds=kinds).select("row_id", "cells", F.inline("entities"))
    ends = F.transform("cells", lambda c, i: F.aggregate(F.slice("cells", 1, i), i, lambda a, x: a + F.length(x)))
    cell = F.size(F.filter(ends, lambda s: s <= F.col("start"))) - 1
    start = F.col("start") - F.get(ends, cell)
    placed = found.select("row_id", "entity_type", F.col("text").alias("value"), "score", cell.alias("cell"), start.alias("cell_start"), F.col("cells"))
    return placed.where(F.col("cell_start") + F.length("value") <= F.length(F.get("cells", F.col("cell")))).drop("cells")
