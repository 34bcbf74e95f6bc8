"""Documents as paragraphs and table cells: one vault for all paragraphs, spans found in table rows, reading order.

A document is known by its id here, so ids must not repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions.text import SPAN, let, splice
from vellum.operators import entities as E


def spans_by_paragraph(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of df's entities that lie within one paragraph (line): doc_id, para, local_start and the span as ``e``.

    Paragraphs and spans are walked once in order of their offsets, so a
    document costs its paragraphs and spans, not their product.
    """
    lines = E.paragraph_offsets(df, doc_id, text).select(doc_id, F.col("p_start").alias("at"), F.lit(0).alias("kind"), F.struct("para", "p_start").alias("p"), F.lit(None).cast(SPAN).alias("e"))
    found = df.select(doc_id, F.explode("entities").alias("e")).where(~F.contains("e.text", F.lit("\n")))
    found = found.select(doc_id, F.col("e.start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<para:int,p_start:int>").alias("p"), "e")
    upto = Window.partitionBy(doc_id).orderBy("at", "kind")
    placed = lines.unionByName(found).withColumn("p", F.last("p", ignorenulls=True).over(upto)).where("kind = 1")
    return placed.select(doc_id, F.col("p.para").alias("para"), (F.col("at") - F.col("p.p_start")).alias("local_start"), "e")


def vault(spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Values of documents (from ``spans_by_paragraph``), once each, in the order in which they are first met.

    Paragraphs are gone through in order, each from its right end; the first
    meeting decides on a value's type, source and score.
    """
    place = F.struct(F.col("para"), (-F.col("local_start")).alias("back"))
    rows = spans.groupBy(doc_id, F.col("e.text").alias("original_value")).agg(F.min(F.struct(place.alias("place"), F.col("e.entity_type"), F.col("e.source"), F.col("e.score"))).alias("f"), F.count("*").alias("occurrences"))
    number = F.row_number().over(Window.partitionBy(doc_id).orderBy("f.place"))
    return rows.select(doc_id, number.alias("row_no"), "original_value", "f.entity_type", "f.source", "f.score", F.col("f.place.para").alias("first_para"), "occurrences")


def anonymise_paragraphs(df: DataFrame, salt: str, mode: str = "both", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``entities.anonymise``, with one vault over a document's paragraphs; spans that cross a paragraph's end stay as they are."""
    if not salt:
        raise ValueError("a salt is needed for tokens that stay the same")
    if mode not in ("pseudo", "full", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    body = F.coalesce(F.col(text), F.lit(""))
    inside = F.filter("entities", lambda s: ~F.contains(s["text"], F.lit("\n")))
    if mode != "full":
        entry = F.struct("row_no", E.token(F.col("entity_type"), F.col("original_value"), salt).alias("token"), "original_value", "entity_type", "source", F.round("score", 4).alias("score"))
        tables = vault(spans_by_paragraph(df, doc_id, text), doc_id).groupBy(F.col(doc_id).alias("_doc")).agg(F.array_sort(F.collect_list(entry)).alias("_table"))
        df = df.join(tables, F.col(doc_id).eqNullSafe(F.col("_doc")), "left").drop("_doc")
        known = F.coalesce("_table", F.array().cast("array<struct<row_no:int,token:string,original_value:string,entity_type:string,source:string,score:double>>"))
        df = df.withColumn("mapping", F.transform(known, lambda m: m.dropFields("row_no"))).drop("_table")
        tokens = F.map_from_arrays(F.transform("mapping", lambda m: m["original_value"]), F.transform("mapping", lambda m: m["token"]))
        df = df.withColumn("pseudo_text", let(tokens, lambda t: splice(body, inside, lambda s: F.try_element_at(t, s["text"]))))
    if mode != "pseudo":
        df = df.withColumn("full_text", splice(body, inside, lambda s: E.generalised(s["entity_type"], s["text"])))
    return df


def distinct_cells(cells: Column) -> Column:
    """Cells of a row (cell_id, ...), each merged one once; cells without an id all stay."""
    ids = F.transform(cells, lambda c: c["cell_id"])
    return F.filter(cells, lambda c, i: F.coalesce(F.array_position(ids, c["cell_id"]) == i + 1, F.lit(True)))


def cell_text(paragraphs: Column) -> Column:
    """A cell's paragraphs (start, text) as one text without white space at its ends."""
    return F.regexp_replace(F.array_join(F.transform(paragraphs, lambda p: F.coalesce(p["text"], F.lit(""))), "\n"), r"(?U)^\s+|\s+$", "")


def first_isolated(paragraphs: Column, value: Column) -> Column:
    """Offset in the document of the first isolated occurrence of value in a cell's paragraphs (start, text), or null."""
    size = lambda p: F.length(F.coalesce(p["text"], F.lit("")))
    before = lambda i: F.aggregate(F.slice(paragraphs, F.lit(1), i), F.lit(0), lambda a, p: a + size(p) + 1)
    based = F.transform(paragraphs, lambda p, i: F.struct(before(i).alias("base"), size(p).alias("n"), p["start"].alias("start")))

    def found(cell: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.length(cell)), lambda i: F.substring(cell, i + 1, F.length(value)) == value)
        free = E.isolated(cell, F.transform(at, lambda i: F.struct(i.alias("start"), (i + F.length(value)).alias("end"))))
        place = lambda bs, s: F.get(F.filter(bs, lambda b: (b["base"] <= s["start"]) & (s["start"] < b["base"] + b["n"])), F.lit(0))
        placed = let(based, lambda bs: F.transform(free, lambda s: place(bs, s)["start"] + s["start"] - place(bs, s)["base"]))
        return F.get(F.filter(placed, lambda g: g.isNotNull()), F.lit(0))

    return F.when(F.length(value) > 0, let(cell_text(paragraphs), found))


def row_spans(rows: DataFrame, known: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Spans that show only when a table row's cells are read together, and that overlap no known one.

    rows: doc_id, row_no (over all tables of a document), cells (cell_id, paragraphs
    with start and text); known: doc_id, start, end.  A hit in the row's text goes
    to its value's first isolated occurrence in its cell.  Hits are taken in order
    of rows and offsets; one that overlaps a known or taken span is dropped.
    That is a fold over the hits of a document, which costs their square.
    """
    read = rows.withColumn("cells", distinct_cells(F.col("cells")))
    read = read.withColumn("text", F.array_join(F.transform("cells", lambda c: cell_text(c["paragraphs"])), "\t")).where(F.length(F.btrim("text", F.lit(" \t\n\r\f\v"))) >= 2)
    hits = E.detect(read, kinds=kinds).select("doc_id", "row_no", "cells", F.col("text").alias("joined"), F.posexplode("entities").alias("ord", "e"))
    cell = F.size(F.split(F.substring("joined", F.lit(1), F.col("e.start")), "\t")) - 1
    hits = hits.withColumn("start", first_isolated(F.get("cells", cell)["paragraphs"], F.col("e.text"))).where("start IS NOT NULL")
    span = F.struct("row_no", "ord", "start", (F.col("start") + F.length("e.text")).alias("end"), F.col("e.text").alias("text"), "e.entity_type", "e.score", "e.source")
    taken = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("hits"))
    held = known.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start", "end")).alias("held"))
    both = taken.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<start:int,end:int>>")))
    meets = lambda spans, c: F.exists(spans, lambda x: (c["start"] < x["end"]) & (x["start"] < c["end"]))
    kind = dict(taken.dtypes)["hits"]
    kept = F.aggregate("hits", F.array().cast(kind), lambda a, c: F.when(meets(a, c) | meets(F.col("held"), c), a).otherwise(F.concat(a, F.array(c))))
    return both.select("doc_id", F.inline(kept)).select("doc_id", "text", "entity_type", "start", "end", "score", "source")


def reading_order(parts: DataFrame) -> DataFrame:
    """parts with ``ord`` (from 0 in their file): the body, then tables by row and cell, then each section's headers and footers.

    parts: file, part, section (a table's number, or a section's), row_no, cell_no, i.
    """
    order = F.array(*map(F.lit, P.PARTS))
    unset = lambda c: F.coalesce(F.col(c), F.lit(0))
    group = F.when(F.col("part") == "body", 0).when(F.col("part") == "table", 1).otherwise(2)
    keys = (group, unset("section"), F.array_position(order, F.col("part")), unset("row_no"), unset("cell_no"), unset("i"))
    return parts.withColumn("ord", (F.row_number().over(Window.partitionBy("file").orderBy(*keys)) - 1).cast("int"))
