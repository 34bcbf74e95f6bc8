"""Checklist items and documents: similarity, assignment, boosts, statuses, and what is missing or extra."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import tokens
from vellum.session import ship

#: Thresholds of the greedy and of the ranked matcher.
STRICT, PARTIAL = 0.78, 0.65
RANKED_STRICT, RANKED_GAP = 0.62, 0.10
HINT_BOOST, NOMINATION_BOOST, LEAST_NOMINATIONS = 0.20, 0.12, 2
#: Words of titles that are sent to all tasks at most.
BROADCAST_WORDS = 500_000
PENALTY, LEAST_CLARITY, FALLBACK = 0.88, 0.08, 0.48


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def similarity(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Dot products of unit vectors within a module: module, item, item_ord, doc, doc_ord, sim (rounded to 6 places).

    items: module, item, item_ord, item_vec; docs: module, doc, doc_ord, doc_vec.
    The module is the join's key; what lies in another module is never compared.
    """
    rows = docs.join(items, "module")
    return rows.select("module", "item", "item_ord", "doc", "doc_ord", F.round(dot(F.col("item_vec"), F.col("doc_vec")), 6).alias("sim"))


def status(sim: Column, strict: float, gap: float) -> Column:
    return F.when(sim >= strict, "matched").when(sim >= strict - gap, "needs_user_confirmation").otherwise("missing")


def greedy(sims: DataFrame, strict: float = STRICT, partial: float = PARTIAL) -> DataFrame:
    """Items in order take the best document not yet used: module, item, item_ord, doc, sim, status.

    Only a similarity above zero counts, and of equal ones the earlier document.
    A document is used up from ``partial`` on.  Order matters, so a module is one
    group.  Of its n items the others use up n - 1 documents at most, so an item
    needs its best n only: a group has n times n pairs, however many documents
    there are.
    """
    n_items = sims.groupBy("module").agg(F.count_distinct("item_ord", "item").alias("_n"))
    place = F.row_number().over(Window.partitionBy("module", "item_ord", "item").orderBy(F.desc_nulls_last("sim"), "doc_ord"))
    sims = sims.withColumn("_place", place).join(n_items, "module").where(F.col("_place") <= F.col("_n")).drop("_place", "_n")

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for (ord_, item), rows in group.sort_values(["item_ord", "doc_ord"], kind="stable").groupby(["item_ord", "item"], sort=True):
            free = rows[rows["doc"].notna() & ~rows["doc"].isin(used) & (rows["sim"] > 0)]
            best = free.loc[free["sim"].idxmax()] if len(free) else None
            sim = 0.0 if best is None else float(best["sim"])
            if sim >= partial:
                used.add(best["doc"])
            state = "matched" if sim >= strict else "needs_user_confirmation" if sim >= partial else "missing"
            out.append((group["module"].iloc[0], item, ord_, best["doc"] if sim >= partial else None, sim, state))
        return pd.DataFrame(out, columns=["module", "item", "item_ord", "doc", "sim", "status"]).astype({"doc": "Int64"})

    return sims.groupBy("module").applyInPandas(assign, "module string, item long, item_ord long, doc long, sim double, status string")


def ranked(sims: DataFrame) -> DataFrame:
    """sims with ``rank`` of the items for each document, by similarity (ties by the items' order)."""
    return sims.withColumn("rank", F.row_number().over(Window.partitionBy("module", "doc").orderBy(F.desc("sim"), "item_ord")))


def hints(filename: Column) -> Column:
    """Section numbers in a file name."""
    return F.regexp_extract_all(filename, F.lit(r"(?iU)\b(\d+\.\d+(?:\.[A-Z]+)?(?:\.\d+)*)\b"), F.lit(1))


def section_of_stem(filename: Column) -> Column:
    """The first section number of a file's stem, or null."""
    found = F.regexp_extract(F.regexp_replace(filename, r"\.[^.]*$", ""), r"\d+(\.\d+){1,3}(\.[SP])?", 0)
    return F.when(found != "", found)


def hinted(rows: DataFrame, boost: float = HINT_BOOST) -> DataFrame:
    """rows (filename, section_id, sim) with sim lifted, 1 at most, where a section number of the file name agrees with the item's, and ``boost_applied``."""
    fits = lambda h: (h == F.col("section_id")) | F.col("section_id").startswith(h) | h.startswith(F.col("section_id"))
    hit = F.get(F.filter(hints(F.col("filename")), fits), F.lit(0))
    return rows.withColumn("boost_applied", F.when(hit.isNotNull(), F.concat(F.lit("filename_hint:"), hit))).withColumn("sim", F.when(hit.isNotNull(), F.least(F.lit(1.0), F.col("sim") + boost)).otherwise(F.col("sim")))


def best_documents(rows: DataFrame) -> DataFrame:
    """For each item the document of highest similarity above zero, the earliest of equal ones."""
    best = rows.where("sim > 0").groupBy("module", "item").agg(F.max_by(F.struct("doc", "doc_ord", "sim"), F.struct(F.col("sim"), -F.col("doc_ord"))).alias("b"))
    return best.select("module", "item", "b.doc", "b.sim")


def clarity(ranks: DataFrame) -> DataFrame:
    """For each document the distance of its two best items; null with one item only."""
    two = ranks.where("rank <= 2").groupBy("module", "doc").agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("b"))
    return two.select("module", "doc", F.round(F.col("a") - F.col("b"), 6).alias("clarity"))


def nominations(ranks: DataFrame, k: int = 3) -> DataFrame:
    """Documents that have an item among their k best."""
    return ranks.where(F.col("rank") <= k).groupBy("module", "item").agg(F.count_distinct("doc").alias("nominations"))


def match(items: DataFrame, sims: DataFrame, strict: float = RANKED_STRICT, gap: float = RANKED_GAP, fallback: float = FALLBACK) -> DataFrame:
    """The ranked matcher: best document, penalty where that is ambiguous, boost by nominations, status, then the fallback.

    items: module, item; sims as from ``similarity`` (after ``hinted``, where file
    names are known; ranks are those of the plain similarities).
    """
    ranks = ranked(sims)
    rows = best_documents(sims).join(clarity(ranks), ["module", "doc"], "left").join(nominations(ranks), ["module", "item"], "left")
    unclear = F.col("clarity").isNotNull() & (F.col("clarity") < LEAST_CLARITY)
    score = F.when(unclear, F.col("sim") * PENALTY).otherwise(F.col("sim"))
    score = F.when(F.coalesce("nominations", F.lit(0)) >= LEAST_NOMINATIONS, F.least(F.lit(1.0), score + NOMINATION_BOOST)).otherwise(score)
    rows = rows.withColumn("score", F.round(score, 6)).withColumn("status", status(F.round(score, 6), strict, gap))
    second = ranks.where(F.col("rank").between(2, 3) & (F.col("sim") >= fallback)).groupBy("module", "item").agg(F.max_by(F.struct("doc", "sim"), F.struct(F.col("sim"), -F.col("doc_ord"))).alias("second"))
    out = items.select("module", "item").join(rows, ["module", "item"], "left").join(second, ["module", "item"], "left")
    missing = F.coalesce("status", F.lit("missing")) == "missing"
    use = missing & F.col("second").isNotNull()
    return out.select(
        "module",
        "item",
        F.when(use, F.col("second.doc")).when(~missing, F.col("doc")).alias("doc"),
        F.when(use, F.col("second.sim")).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(use, "needs_user_confirmation").otherwise(F.coalesce("status", F.lit("missing"))).alias("status"),
        F.when(use, "secondary_fallback").otherwise("primary").alias("match_method"),
        F.coalesce("nominations", F.lit(0)).cast("long").alias("nominations"),
    )


def extras(docs: DataFrame, matched: DataFrame) -> DataFrame:
    """Documents that no item has."""
    return docs.join(matched.where("doc IS NOT NULL").select("module", "doc"), ["module", "doc"], "left_anti")


def missing_mandatory(items: DataFrame, matched: DataFrame) -> DataFrame:
    return items.where("applicability = 'Mandatory'").join(matched.where("status = 'missing'").select("module", "item"), ["module", "item"], "left_semi")


def completeness(items: DataFrame, matched: DataFrame) -> DataFrame:
    """For each module, and over all (module null): items, those submitted, and whether no mandatory one is missing."""
    rows = items.join(matched.select("module", "item", "status"), ["module", "item"])
    lost = (F.col("applicability") == "Mandatory") & (F.col("status") == "missing")
    return rows.rollup("module").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "missing").alias("submitted"), (~F.bool_or(lost)).alias("mandatory_complete"))


def to_review(items: DataFrame, matched: DataFrame) -> DataFrame:
    """Conditional and optional items that aren't matched, in order, one list for each module."""
    rows = items.where("applicability <> 'Mandatory'").join(matched.where("status <> 'matched'").select("module", "item"), ["module", "item"], "left_semi")
    return rows.groupBy("module").agg(F.array_sort(F.collect_list("item")).alias("items"))


def relevance(titles: DataFrame, texts: DataFrame, least: float = 0.35, most_broadcast: int = BROADCAST_WORDS) -> DataFrame:
    """Pairs whose title shares enough of its words with the text: item_id, doc_id, overlap.

    titles: item_id, title; texts: doc_id, text.  Where the titles have at most
    most_broadcast words, they go to all tasks, and a text's task counts what it
    shares with each; only counts are shuffled.  Beyond that, a text with enough
    of a title's n words has one of any n - enough + 1 of them, so both meet over
    the title's rarest ones, and words are counted for the pairs that met.
    """
    named = titles.select("item_id", tokens(F.col("title")).alias("ws")).where(F.size("ws") > 0)
    words = named.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    found = texts.select("doc_id", F.explode(tokens(F.col("text"))).alias("w"))
    if words.limit(most_broadcast + 1).count() <= most_broadcast:
        met = found.join(F.broadcast(words), "w")
    else:
        often = found.join(words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("often"))
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("often", F.lit(0)), "w"))
        rare = words.join(often, "w", "left").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n")) + 1).select("item_id", "w")
        pairs = found.join(rare, "w").select("item_id", "doc_id").distinct()
        met = pairs.join(found, "doc_id").join(words, ["item_id", "w"])
    shared = met.groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return shared.where(F.col("shared") >= least * F.col("n")).select("item_id", "doc_id", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))


def query_text(title: Column, anchor: Column, purpose: Column, evidence: Column) -> Column:
    """A description as one line; empty parts are left out."""
    parts = F.array(title, anchor, purpose, F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), ". "))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.btrim(x) != "")), " | ")


def reviewed(matched: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Statuses after a reviewer's verdicts (module, item, verdict) on items to be confirmed; a rejected document stays used up."""
    rows = matched.join(verdicts, ["module", "item"], "left")
    new = F.when(F.col("verdict") == "matched", "matched").when(F.col("verdict") == "not_a_match", "missing").otherwise(F.col("status"))
    return rows.withColumn("status", F.when(F.col("status") == "needs_user_confirmation", new).otherwise(F.col("status"))).drop("verdict")


def embedded(df: DataFrame, text: str, model) -> DataFrame:
    """df with ``vector``: what a model (a function of a list of texts giving unit vectors) makes of a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=list(model(batch[text].tolist())))

    ship(df.sparkSession)
    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", vector array<float>")


def result_of(status: Column) -> Column:
    """A status as a reviewer's result, whatever its case."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s == "matched", "CONSISTENT").when(s == "needs_user_confirmation", "NEEDS_REVIEW").otherwise("INCONSISTENT")


def flattened(reports: DataFrame, modules: str = "modules") -> DataFrame:
    """Items of nested reports (a map from a module to its report with ``items``), one row each."""
    rows = reports.select(F.explode(modules).alias("_name", "_report"))
    return rows.select(F.inline("_report.items"))


def upsert(index: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """index with the last change (by order) of each key in place of its row, or added to it; both have the same other columns."""
    columns = [c for c in index.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("new"))
    rows = index.select(key, F.struct(*columns).alias("old")).join(last, key, "full")
    return rows.select(key, F.coalesce("new", "old").alias("row")).select(key, "row.*")
