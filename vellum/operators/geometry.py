"""Boxes on pages: overlap, nesting, duplicates, lines in blocks, words in rows."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import let
from vellum.session import ship

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).cast("double").alias(c) for c in BOX])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h / (area(a) + area(b) - w * h + 1e-6)


def centre_inside(child: Column, parent: Column) -> Column:
    x, y = (child["x1"] + child["x2"]) / 2, (child["y1"] + child["y2"]) / 2
    return (x >= parent["x1"]) & (x <= parent["x2"]) & (y >= parent["y1"]) & (y <= parent["y2"])


def expanded(b: Column, pad: float, width: Column, height: Column) -> Column:
    """A box grown on all sides, within the page."""
    return F.struct(F.greatest(F.lit(0.0), b["x1"] - pad).alias("x1"), F.greatest(F.lit(0.0), b["y1"] - pad).alias("y1"), F.least(width, b["x2"] + pad).alias("x2"), F.least(height, b["y2"] + pad).alias("y2"))


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    """A box of a crop in the page's coordinates."""
    return F.struct((b["x1"] + dx).alias("x1"), (b["y1"] + dy).alias("y1"), (b["x2"] + dx).alias("x2"), (b["y2"] + dy).alias("y2"))


def scaled(b: Column, sx: Column, sy: Column, flip_height: Column | None = None) -> Column:
    """A box on a page of another size; with flip_height, with y from below."""
    y1, y2 = b["y1"] * sy, b["y2"] * sy
    if flip_height is not None:
        y1, y2 = flip_height - y2, flip_height - y1
    return F.struct((b["x1"] * sx).alias("x1"), y1.alias("y1"), (b["x2"] * sx).alias("x2"), y2.alias("y2"))


def resize_factor(width: Column, height: Column, most: int = 4000) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))


def without_noise(boxes: DataFrame) -> DataFrame:
    """Boxes of at least 5 by 5, not too long, of a confidence of 0.7 or more."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.where((w >= 5) & (h >= 5)).where(F.greatest(w / h, h / w) <= 20).where("confidence >= 0.7")


def without_nested(blocks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Blocks (page_id, block_id, type, box) but for those that a larger one of their type on the page covers."""
    a, b = blocks.select("page_id", "block_id", "type", box().alias("a")), blocks.select("page_id", "type", F.col("block_id").alias("other"), box().alias("b"))
    nested = a.join(b, ["page_id", "type"]).where((F.col("block_id") != F.col("other")) & (iou(F.col("a"), F.col("b")) > threshold) & (area(F.col("a")) < area(F.col("b"))))
    return blocks.join(nested.select("page_id", "block_id").distinct(), ["page_id", "block_id"], "left_anti")


def _kept(lines: DataFrame, same, order: str) -> DataFrame:
    """Lines of each page of which no earlier kept line is the same; a page is one row's array."""
    one = F.struct(F.col(order).alias("o"), F.struct(*[F.col(c) for c in lines.columns]).alias("r"), box().alias("b"))
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("ls"))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: same(k["b"], x["b"])), kept).otherwise(F.concat(kept, F.array(x)))
    empty = F.filter("ls", lambda x: F.lit(False))
    return pages.select(F.explode(F.aggregate("ls", empty, step)).alias("x")).select("x.r.*")


def deduplicated(lines: DataFrame, threshold: float = 0.8, order: str = "line_ord") -> DataFrame:
    """Lines of a page that overlap no kept earlier line by more than the threshold."""
    return _kept(lines, lambda a, b: iou(a, b) > threshold, order)


def deduplicated_strictly(lines: DataFrame, order: str = "line_ord") -> DataFrame:
    """The same for an overlap above 0.5, or centres within 5 on both axes."""
    near = lambda a, b, p, q: F.abs((a[p] + a[q]) / 2 - (b[p] + b[q]) / 2) < 5
    return _kept(lines, lambda a, b: (iou(a, b) > 0.5) | (near(a, b, "x1", "x2") & near(a, b, "y1", "y2")), order)


def assigned(lines: DataFrame, blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """Lines (page_id, line_ord, box) with the block (block_id, block_ord) that holds them best, or null.

    A block's score is the overlap and half a point if the line's centre lies in
    it; it must be above ``least``, and of equal ones the first counts.
    """
    a = lines.select("page_id", "line_ord", box().alias("a"))
    b = blocks.select("page_id", "block_id", "block_ord", box().alias("b"))
    score = iou(F.col("a"), F.col("b")) + F.when(centre_inside(F.col("a"), F.col("b")), 0.5).otherwise(0.0)
    best = a.join(b, "page_id").withColumn("score", score).where(F.col("score") > least).groupBy("page_id", "line_ord").agg(F.max_by("block_id", F.struct(F.col("score"), -F.col("block_ord"))).alias("block_id"))
    return lines.join(best, ["page_id", "line_ord"], "left")


def assigned_once(lines: DataFrame, blocks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Assigned lines without those that repeat an earlier assigned one; lines without a block all stay."""
    found = assigned(lines, blocks)
    return deduplicated(found.where("block_id IS NOT NULL"), threshold).unionByName(found.where("block_id IS NULL"))


def rows_of_words(words: DataFrame, reach: float = 3.2, gap: float = 16.0, doc_id: str | None = None) -> DataFrame:
    """Rows of text from words (page_id, x0, y0, x1, y1, text): page_id, row_no, row_text; with doc_id, words and rows have it and page in place of page_id.

    Words come by height of their centre; one joins the current row while it lies
    within ``reach`` of the row's running mean.  A wide gap in a row is a tab.
    """
    if doc_id is None:
        return rows_of_words(words.withColumn("page", F.lit(0)), reach, gap, "page_id").drop("page")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", F.translate("sep", "\n", "").alias("sep"), "text"))), lambda p: F.concat(p["sep"], p["text"]))
    rows = _in_rows(words, doc_id, reach, gap).groupBy(doc_id, "page", "row_no").agg(F.array_join(parts, "").alias("row_text"))
    return rows.withColumn("row_no", F.col("row_no").cast("long"))


def _row_numbers(pages: pa.Array, reach: float) -> pa.Array:
    """Numbers of rows from the sorted heights of each page's words; a word without a height is a row of its own."""
    numbers, upto = array("i"), array("i", [0])
    for page in pages:
        row_no, mean, n = -1, 0.0, 0
        for cy in page.values.to_numpy(zero_copy_only=False).tolist():
            if row_no >= 0 and abs(cy - mean) <= reach:
                n += 1
                mean = (mean * (n - 1) + cy) / n
            else:
                row_no, mean, n = row_no + 1, cy, 1
            numbers.append(row_no)
        upto.append(len(numbers))
    values = pa.array(np.frombuffer(numbers, np.int32)) if numbers else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(upto, np.int32)), values)


def _in_rows(words: DataFrame, doc_id: str, reach: float, gap: float) -> DataFrame:
    """Words that are not blank, with row_no, sep (what stands before them) and place (their order in the page)."""
    ship(words.sparkSession)

    def numbers(heights: pa.Array) -> pa.Array:
        return _row_numbers(heights, reach)

    number = F.arrow_udf(numbers, "array<int>")
    last = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731 (nulls stand behind all numbers)
    sizes = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = words.select(doc_id, F.col("page").cast("int").alias("page"), *sizes, F.btrim("text", F.lit(" \t\n\x0b\f\r")).alias("text")).where("text <> ''")
    word = F.struct(last((F.col("y0") + F.col("y1")) / 2).alias("cy"), last(F.col("x0")).alias("left"), last(F.col("x1")).alias("right"), "text", "x0", "y0", "x1", "y1")
    pages = rows.groupBy(doc_id, "page").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    pages = pages.withColumn("numbers", number(F.transform("ws", lambda w: w["cy"])))
    # In a row words stand from the left; those that begin alike stay in order of height.
    kept = ("x0", "y0", "x1", "y1", "text")
    own = lambda w: [w[c].alias(c) for c in kept]
    placed = F.sort_array(F.transform("ws", lambda w, i: F.struct(F.get("numbers", i).alias("row_no"), w["left"].alias("left"), i.alias("i"), *own(w))))
    before = lambda a, i: F.get(a, i - 1)
    sep = lambda a, w, i: F.when(i == 0, "").when(before(a, i)["row_no"] != w["row_no"], "\n").when(w["x0"] - before(a, i)["x1"] >= gap, "\t").otherwise(" ")
    told = let(placed, lambda a: F.transform(a, lambda w, i: F.struct(w["row_no"].alias("row_no"), i.alias("place"), *own(w), sep(a, w, i).alias("sep"))))
    return pages.select(doc_id, "page", F.explode(told).alias("w")).select(doc_id, "page", "w.*")


def placed_words(words: DataFrame, doc_id: str = "doc_id", reach: float = 3.2, gap: float = 16.0) -> DataFrame:
    """Words (doc_id, page from 0, x0, y0, x1, y1, text) with the place of each in its document's text.

    Rows of a page are found as in ``rows_of_words``; in a row words stand from
    the left, a blank between them, or a tab where the gap is wide.  Rows and pages end with a
    line feed, pages without words too (but for the last page with words).
    Adds row_no, sep (what stands before the word), w_start and w_end.  Blank
    words are left out.  A page is a row's array, of which only the heights go to
    Python; a document's words are summed up as a stream.
    """
    order = Window.partitionBy(doc_id).orderBy("page", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum(F.length(F.concat("sep", "text"))).over(order) + F.col("page")).cast("int")
    rows = _in_rows(words, doc_id, reach, gap).withColumn("w_end", end)
    return rows.select(doc_id, "page", "row_no", "x0", "y0", "x1", "y1", "text", "sep", (F.col("w_end") - F.length("text")).alias("w_start"), "w_end")


def stream_of(placed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The text of each document from its placed words: doc_id, text."""
    ordered = F.array_sort(F.collect_list(F.struct("w_start", F.concat("sep", "text").alias("t"))))
    pages = placed.groupBy(doc_id, "page").agg(F.array_join(F.transform(ordered, lambda w: w["t"]), "").alias("t"))
    back = F.coalesce(F.lag("page").over(Window.partitionBy(doc_id).orderBy("page")), F.lit(0))
    pages = pages.withColumn("t", F.concat(F.repeat(F.lit("\n"), F.col("page") - back), F.col("t")))
    whole = F.array_sort(F.collect_list(F.struct("page", "t")))
    return pages.groupBy(doc_id).agg(F.array_join(F.transform(whole, lambda p: p["t"]), "").alias("text"))


def text_stream(rows: DataFrame) -> DataFrame:
    """Rows of text with the offset of each in its page's text, a line feed between."""
    before = F.coalesce(F.sum(F.length("row_text") + 1).over(Window.partitionBy("page_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", before.cast("long"))


def draw_list(items: DataFrame) -> DataFrame:
    """Items (page_id, type, box) in drawing order: tables, pictures, text, the rest; each from top left."""
    layer = F.when(F.col("type") == "table", 0).when(F.col("type").isin("image", "seal"), 1).when(F.col("type") == "unassigned", 3).otherwise(2)
    return items.withColumn("layer", layer).withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("layer", "y1", "x1", "block_id")).cast("long"))


def built_blocks(layout: DataFrame) -> DataFrame:
    """Detected regions (page_id, det_ord, type) with ids: t1, t2, ... for tables, b1, b2, ... for the others, and what they hold."""
    table = F.col("type") == "table"
    order = Window.partitionBy("page_id", table).orderBy("det_ord")
    return layout.withColumn("block_id", F.concat(F.when(table, "t").otherwise("b"), F.row_number().over(order).cast("string"))).withColumn("holds", F.when(table, "cells").when(F.col("type").isin("image", "seal"), "asset").otherwise("lines"))


def outside(lines: DataFrame, regions: DataFrame, pad: float = 5.0) -> DataFrame:
    """Lines whose centre lies in none of the page's regions, grown by ``pad``."""
    a = lines.select("page_id", "line_ord", box().alias("a"))
    b = regions.select("page_id", F.struct((F.col("x1") - pad).alias("x1"), (F.col("y1") - pad).alias("y1"), (F.col("x2") + pad).alias("x2"), (F.col("y2") + pad).alias("y2")).alias("b"))
    inside = a.join(b, "page_id").where(centre_inside(F.col("a"), F.col("b"))).select("page_id", "line_ord").distinct()
    return lines.join(inside, ["page_id", "line_ord"], "left_anti")
