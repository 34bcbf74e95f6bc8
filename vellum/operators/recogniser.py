"""A token tagger over long texts: windows of tokens, and its tags joined into spans.

A tagger reads at most so many tokens at once, so a text is cut into windows
that overlap by ``STRIDE`` tokens.  Windows are rows: a tagger sees them one by
one or in batches, wherever they come from, and no task holds more than a
window of a text.  Tokens of one label that touch become one span, within a
window; what two windows find in their common part comes twice, and is made one
where spans are fused.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.functions import patterns as P
from vellum.functions import tagging
from vellum.functions.text import SPAN, let
from vellum.operators import entities
from vellum.session import ship, tasks

#: Tokens of a window, with the ``SPECIAL`` ones that a tagger puts at its ends, and tokens that two windows share.
WINDOW, SPECIAL, STRIDE = 512, 2, 64
#: Texts of any length are cut into windows.
MOST_CHARS = math.inf
LEAST_SCORE = 0.75

TOKENS = "array<struct<start:int,end:int>>"
TAGS = "array<struct<label:string,score:double>>"


def _pieces(texts: pa.Array) -> pa.Array:
    """Places as flat integers, not as objects: a batch of long texts has millions."""
    piece = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")
    starts, ends, upto = array("i"), array("i"), array("i", [0])
    for t in texts:
        for m in piece.finditer(t.as_py() or ""):
            starts.append(m.start())
            ends.append(m.end())
        upto.append(len(starts))
    flat = [pa.array(np.frombuffer(x, np.int32)) if x else pa.array([], pa.int32()) for x in (starts, ends)]
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(upto, np.int32)), pa.StructArray.from_arrays(flat, ["start", "end"]))


def word_offsets(text: Column) -> Column:
    """Runs of letters and digits, and single other characters, with their places: stands in for a tagger's own tokenizer."""
    return F.when(text.isNotNull(), F.arrow_udf(_pieces, TOKENS)(text))


class InArrow:
    """A tagger from the words of windows (lists of strings) to their tags (as many structs of label and score), both in Arrow.

    It can be used like any tagger; ``window_spans`` and ``entity_rows`` go over
    the texts with it in one pass, in which windows are no rows of Spark.
    """

    def __init__(self, tag: tagging.Tag) -> None:
        self.tag = tag

    def __call__(self, windows: DataFrame) -> DataFrame:
        ship(windows.sparkSession)
        tag = self.tag
        kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))
        return windows.withColumn("tags", F.arrow_udf(lambda words: tag(words).cast(kind), TAGS)("words"))


def windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: Callable[[Column], Column] = word_offsets, window: int = WINDOW - SPECIAL, stride: int = STRIDE) -> DataFrame:
    """Windows of tokens: doc_id, window (from 0), tokens (places in the text), words (their characters).

    A window begins ``window - stride`` tokens after the one before, and the last
    one reaches the end, however long the text is.  Null texts have none; a text
    without tokens neither.  Equal rows have the same windows, and equal windows
    come once.
    """
    ship(df.sparkSession)
    if not 0 <= stride < window:
        raise ValueError("a window must be longer than its stride")
    step = window - stride
    body = F.col(f"`{text}`")
    found = df.where(body.isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text")).withColumn("all", tokens(F.col("text"))).where(F.size("all") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("all") - window) / step)).cast("int")

    def cut(w: Column) -> Column:
        """A window, with its own stretch of the text, from which its words come."""
        def with_part(own: Column) -> Column:
            first, end = own[0]["start"], F.array_max(F.transform(own, lambda t: t["end"]))
            word = lambda t, part: F.substring(part, t["start"] - own[0]["start"] + 1, t["end"] - t["start"])
            return let(F.substring("text", first + 1, end - first), lambda part: F.struct(w.alias("window"), own.alias("tokens"), F.transform(own, lambda t: word(t, part)).alias("words"), part.alias("part")))

        return let(F.slice("all", w * step + 1, F.lit(window)), with_part)

    # Windows are made before they become rows, so that nothing of them is computed again by what follows.
    return found.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), cut)).alias("w")).select("doc_id", "w.window", "w.tokens", "w.words", "w.part")


def canonical_label(label: Column) -> Column:
    """A tag's label without its place in a span (what stands before the first hyphen), under its canonical name; null for no entity and for plain dates."""
    names = F.create_map(*[F.lit(x) for pair in P.RECOGNISER_LABELS.items() for x in pair])
    bare = F.substring(label, F.instr(label, "-") + 1, F.length(label))
    named = F.coalesce(F.try_element_at(names, bare), bare)
    return F.when((label != "O") & (named != "DATE"), named)


def joined(tokens: Column, tags: Column, part: Column) -> Column:
    """Spans of a window: each run of touching tokens of one label, with the least of their scores.

    tokens and tags are arrays of the same length.  A token without a label or
    with a score under LEAST_SCORE ends a run; so does a gap, and another label.
    Spans of one character and words of forms are left out.
    """
    kind = lambda t: F.when(t["score"] >= LEAST_SCORE, canonical_label(t["label"]))
    rows = F.zip_with(tokens, tags, lambda t, g: F.struct(t["start"].alias("start"), t["end"].alias("end"), kind(g).alias("kind"), g["score"].alias("score")))
    open_ = "struct<kind:string,start:int,end:int,score:double>"
    begin = F.struct(F.array().cast(f"array<{open_}>").alias("done"), F.lit(None).cast(open_).alias("now"))

    def step(a: Column, t: Column) -> Column:
        now = a["now"]
        touches = now.isNotNull() & t["kind"].isNotNull() & (t["kind"] == now["kind"]) & (t["start"] <= now["end"])
        grown = F.struct(now["kind"].alias("kind"), now["start"].alias("start"), F.greatest(now["end"], t["end"]).alias("end"), F.least(now["score"], t["score"]).alias("score"))
        new = F.when(t["kind"].isNotNull(), F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["score"].alias("score")))
        done = F.when(touches | now.isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(touches, grown).otherwise(new).cast(open_).alias("now"))

    runs = F.aggregate(rows, begin, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    first = tokens[0]["start"]

    def span(r: Column) -> Column:
        word = F.btrim(F.substring(part, r["start"] - first + 1, r["end"] - r["start"]), F.lit(" \t\n\x0b\f\r"))
        return F.struct(word.alias("text"), r["kind"].alias("entity_type"), r["start"].alias("start"), r["end"].alias("end"), F.round(r["score"], 4).alias("score"), F.lit("ner").alias("source"))

    kept = F.filter(F.transform(F.filter(runs, lambda r: r["end"] > r["start"]), span), lambda s: (F.length(s["text"]) >= 2) & ~F.lower(s["text"]).isin(*P.RECOGNISER_SPURIOUS))
    return kept.cast(f"array<{SPAN}>")


def spans(tagged: DataFrame) -> DataFrame:
    """Windows with tags as spans of documents: doc_id, recognised (by window, then place; those of common parts twice).

    tagged: what ``windows`` gives, with ``tags`` (label and score of each token),
    as a tagger adds them: a pandas UDF of words, or mapInPandas over the windows.
    """
    found = tagged.select("doc_id", "window", joined(F.col("tokens"), F.col("tags"), F.col("part")).alias("s")).where(F.size("s") > 0)
    of_doc = F.array_sort(F.collect_set(F.struct("window", "s")), lambda a, b: a["window"] - b["window"])
    return found.groupBy("doc_id").agg(F.flatten(F.transform(of_doc, lambda w: w["s"])).alias("recognised"))


def detect(df: DataFrame, tagger: Callable[[DataFrame], DataFrame], doc_id: str = "doc_id", text: str = "text", kinds=None, **cut) -> DataFrame:
    """df with ``entities`` of the definitions and of a tagger together.

    tagger: a function from windows to windows with ``tags``.  Only spans are
    shuffled for it, and texts once to meet them.  Rows that share an id share
    what is recognised, so ids should name texts.
    """
    found = spans(tagger(windows(df, doc_id, text, **cut)))
    key = found["doc_id"]
    both = df.join(found, df[doc_id].eqNullSafe(key), "left").drop(key)
    none = F.array().cast(f"array<{SPAN}>")
    done = entities.detect(both, text, kinds=kinds, recogniser=lambda body: F.coalesce(F.col("recognised"), none))
    return done.drop("recognised")


def _schema(df: DataFrame, doc_id: str, rest: str) -> tuple[StructType, pa.Schema]:
    found = StructType([df.schema[doc_id], *StructType.fromDDL(rest)])
    return found, to_arrow_schema(found)


def window_spans(df: DataFrame, tagger: InArrow, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW - SPECIAL, stride: int = STRIDE) -> DataFrame:
    """What a tagger finds in each window, in one pass: doc_id, win, entity_type, value, start, end, score."""
    if not 0 <= stride < window:
        raise ValueError("a window must be longer than its stride")
    ship(df.sparkSession)
    schema, columns = _schema(df, doc_id, "win int, entity_type string, value string, start int, end int, score double")
    tag, least = tagger.tag, LEAST_SCORE
    return entities.spread(df.select(doc_id, text)).mapInArrow(lambda batches: tagging.window_rows(batches, tag, window, stride, least, columns), schema)


def entity_rows(df: DataFrame, tagger: InArrow, doc_id: str = "doc_id", text: str = "text", kinds=None, window: int = WINDOW - SPECIAL, stride: int = STRIDE) -> DataFrame:
    """What ``detect`` finds, as rows and in one pass: doc_id and a span's text, entity_type, start, end, score, source.

    Texts are shuffled once, by their ids, so that rows of one id are read one
    behind the other; spans are not shuffled.
    """
    if not 0 <= stride < window:
        raise ValueError("a window must be longer than its stride")
    ship(df.sparkSession)
    schema, columns = _schema(df, doc_id, SPAN.removeprefix("struct<").removesuffix(">"))
    tag, least, chosen = tagger.tag, LEAST_SCORE, entities.definitions(kinds)
    rows = df.select(doc_id, text).repartition(tasks(df.sparkSession), doc_id).sortWithinPartitions(doc_id)
    return rows.mapInArrow(lambda batches: tagging.entity_rows(batches, tag, chosen, window, stride, least, columns), schema)
