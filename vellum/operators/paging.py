"""Pages of documents: windows over them, pseudo-pages, page filters and texts of modules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.ordering import running
from vellum.session import ship

#: Pages in a window, and pages from one window's start to the next.
SIZE, STRIDE = 20, 19
#: Windows that a model gets at once, as Python texts; the rest of a batch stays as it came.
SLICE_ROWS = 100


def lines_as_pages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of texts as pages: file, page (from 1), raw_text."""
    return df.select(F.col(doc_id).alias("file"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "raw_text")).select("file", (F.col("i") + 1).alias("page"), "raw_text")


def with_order(pages: DataFrame, across_files: bool = False) -> DataFrame:
    """pages with ``ord`` (from 0) and ``n``: within their file, or over all files in order.

    Over all files, the first ordinal of a file comes from its predecessors'
    page counts, summed by ranges of files.
    """
    within = Window.partitionBy("file").orderBy("page")
    rows = pages.withColumn("ord", (F.row_number().over(within) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("file")))
    if not across_files:
        return rows
    counts = pages.groupBy("file").agg(F.count("*").alias("own"))
    counts = running(counts, [F.col("file")], F.col("own"), "before")
    total = counts.agg(F.sum("own").alias("all"))  # one row
    counts = counts.select(F.col("file").alias("f"), "before").join(F.broadcast(total))
    return rows.join(counts, F.col("file").eqNullSafe(F.col("f"))).withColumn("ord", F.col("ord") + F.col("before")).withColumn("n", F.col("all")).drop("f", "before", "all")


def window_members(pages: DataFrame, across_files: bool = False, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """pages with the windows (chunk, from 0) that hold them: one, or two where windows overlap."""
    rows = with_order(pages, across_files)
    chunks = F.greatest(F.lit(1), F.ceil((F.col("n") - (size - stride)) / stride)).cast("long")
    last, over = F.floor(F.col("ord") / stride), F.col("ord") % stride < (size - stride)
    found = F.filter(F.array(last, F.when(over, last - 1)), lambda c: c.isNotNull() & (c >= 0) & (c < chunks))
    return rows.withColumn("chunk", F.explode(found)).drop("n")


def window_texts(members: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """One row for each window: its pages' texts behind their headings, and the pages of each file."""
    head = F.concat(F.lit("\n--- [FILE: "), F.col("file").cast("string"), F.lit(" | PAGE: "), F.col("page").cast("string"), F.lit("] ---\n"), F.col("raw_text"))
    rows = members.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "file", "page", head.alias("t")))).alias("p"))
    pages_of = F.map_from_arrays(
        F.array_distinct(F.transform("p", lambda x: x["file"])),
        F.transform(F.array_distinct(F.transform("p", lambda x: x["file"])), lambda f: F.transform(F.filter("p", lambda x: x["file"] == f), lambda x: x["page"])),
    )
    return rows.select(*keys, "chunk", F.size("p").cast("long").alias("n_pages"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), pages_of.alias("mapping"))


def pages_of_chars(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3000) -> DataFrame:
    """Texts cut into pages of n characters; blank ones are left out, and the numbers stay."""
    count = F.ceil(F.length(text) / n).cast("int")
    rows = df.where(F.length(text) > 0).select(F.col(doc_id).alias("file"), F.col(text).alias("t"), F.explode(F.sequence(F.lit(1), count)).alias("page"))
    return rows.select("file", "page", F.substring("t", (F.col("page") - 1) * n + 1, F.lit(n)).alias("raw_text")).where(F.btrim("raw_text", F.lit(" \t\r\n\f\x0b")) != "")


def pages_of_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 400) -> DataFrame:
    """Texts cut into pages of n words, joined by single spaces."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = df.select(F.col(doc_id).alias("file"), words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("file", "w", F.explode(F.sequence(F.lit(1), F.ceil(F.size("w") / n).cast("int"))).alias("page"))
    return rows.select("file", "page", F.array_join(F.slice("w", (F.col("page") - 1) * n + 1, F.lit(n)), " ").alias("raw_text"))


def pages_at_breaks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "\f") -> DataFrame:
    """Texts cut at explicit page breaks."""
    return df.select(F.col(doc_id).alias("file"), F.posexplode(F.split(text, mark)).alias("i", "raw_text")).select("file", (F.col("i") + 1).alias("page"), "raw_text")


def page_limit(section: Column) -> Column:
    """How many pages describe a document: five for quality and study sections, else three."""
    return F.when(section.rlike(r"^(4\.|5\.3|3\.2\.[SP])"), F.lit(5)).otherwise(F.lit(3))


def substantive_pages(pages: DataFrame, limit: int = 3) -> DataFrame:
    """The first pages with more than 80 words and lines of more than 40 characters on average; without any, the first pages."""
    lines = F.filter(F.split("raw_text", "\n"), lambda x: F.btrim(x) != "")
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(F.btrim(x))) / F.greatest(F.size(lines), F.lit(1))
    words = F.size(F.filter(F.split("raw_text", r"\s+"), lambda w: w != ""))
    rows = pages.withColumn("good", (words > 80) & (mean > 40))
    rows = rows.withColumn("any_good", F.max("good").over(Window.partitionBy("file"))).where("good OR NOT any_good")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("page"))).where(F.col("rn") <= limit).drop("rn", "any_good", "good")


def limited_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Substantive pages with the limit of each file's section; sections: file, section (files without one have three)."""
    rows = pages.join(sections.select("file", page_limit(F.coalesce("section", F.lit(""))).alias("_limit")), "file", "left")
    most = substantive_pages(rows, 5).withColumn("_rn", F.row_number().over(Window.partitionBy("file").orderBy("page")))
    return most.where(F.col("_rn") <= F.coalesce("_limit", F.lit(3))).drop("_rn", "_limit")


def lead_paragraphs(paragraphs: DataFrame, most: int = 3000, words: int = 15) -> DataFrame:
    """Paragraphs (file, i, paragraph) from the first with so many words on, while fewer than ``most`` characters have been taken; empty ones don't count."""
    n = F.size(F.filter(F.split("paragraph", r"\s+"), lambda w: w != ""))
    upto = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = paragraphs.where("paragraph <> ''").withColumn("begun", F.max(n >= words).over(upto)).where("begun")
    taken = F.coalesce(F.sum(F.length("paragraph")).over(Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("taken", taken).where(F.col("taken") < most).drop("begun", "taken")


def lead_texts(paragraphs: DataFrame, most: int = 3000) -> DataFrame:
    """One text for each file: its lead paragraphs, joined by line feeds and cut at ``most`` characters."""
    rows = lead_paragraphs(paragraphs, most).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("i", "paragraph"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["paragraph"]), "\n")
    return rows.select("file", F.btrim(F.left(text, F.lit(most)), F.lit(" \t\r\n\f\x0b")).alias("text"))


def module_texts(files: DataFrame, per_file: int = 120_000, total: int = 400_000, least: int = 500) -> DataFrame:
    """One text for each module of files (module, path, text), in order of path, each behind its path.

    Files are cut at per_file characters.  The text ends at total characters: the
    first piece that doesn't fit is cut if more than ``least`` of them are left, and
    nothing comes after it.

    Which files are kept follows from their lengths; each has 15 characters at
    least, so no more than total / 15 of a module come into its window, and texts
    are fetched for the kept ones only.
    """
    head = F.concat(F.lit("\n\n===== "), F.col("path"), F.lit(" =====\n\n"))
    body = F.left(F.coalesce("text", F.lit("")), F.lit(per_file))
    order = Window.partitionBy("module").orderBy("path")
    rows = files.select("module", "path", (F.length(head) + F.length(body)).alias("n")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= total // 15 + 1)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("room", F.lit(total) - before).where((F.col("n") <= F.col("room")) | (F.col("room") > least))
    kept = rows.select(F.col("module").alias("_module"), F.col("path").alias("_path"), F.col("room").cast("int").alias("room"))
    found = files.join(kept, F.col("module").eqNullSafe(F.col("_module")) & (F.col("path") == F.col("_path"))).select("module", "path", F.left(F.concat(head, body), F.col("room")).alias("block"))
    return found.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "block"))), lambda x: x["block"]), "").alias("text"), F.count("*").alias("n_files"))


def joined_texts(files: DataFrame, head: int | None = None) -> DataFrame:
    """Texts of each module's files in order of path, a blank line between; or only the first ``head`` characters."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n\n")
    rows = files.groupBy("module").agg(text.alias("text"))
    return rows if head is None else rows.withColumn("text", F.left("text", F.lit(head)))


def map_windows(windows: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """windows with ``partial``: what a model (a function of a batch of texts) makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(k, SLICE_ROWS)
                found = pa.array(model(some.column("text").to_pandas()), pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*some.columns, found], names=[*some.schema.names, "partial"])

    ship(windows.sparkSession)
    fields = ", ".join(f"`{n}` {t}" for n, t in windows.drop("mapping").dtypes)
    return windows.drop("mapping").mapInArrow(run, f"{fields}, partial string")


def reduced(partials: DataFrame, keys: tuple[str, ...] = ("file",), separator: str = "\n") -> DataFrame:
    """Partial results of each file in the order of their windows; the stand-in reducer joins them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "partial"))), lambda x: x["partial"])
    return partials.groupBy(*keys).agg(F.array_join(ordered, separator).alias("summary"), F.count("*").alias("n_chunks"))


def first_line(texts: pd.Series) -> pd.Series:
    """A stand-in for a language model: the first line that is no heading."""
    return texts.map(lambda t: next((x.strip() for x in t.split("\n") if x.strip() and not x.startswith("--- [")), ""))


def run_until(files: DataFrame, hit: Column, doc: str = "dossier") -> DataFrame:
    """Files of each dossier (dossier, ord, ...) up to the first where ``hit`` holds; all of them where it never does."""
    first = F.min(F.when(hit, F.col("ord"))).over(Window.partitionBy(doc))
    return files.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("ord") <= F.col("_first"))).drop("_first")


def ordered_sections(sections: DataFrame, name: str, order: Sequence[str], within: str) -> DataFrame:
    """sections with ``place`` (from 1) among those of ``within``: names of a fixed order first, then the others by name."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(name)), F.lit(0))
    return sections.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(place.asc_nulls_last(), name)))
