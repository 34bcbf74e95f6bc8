"""The corpus pipeline: documents that are not toxic, without repeated passages and near copies, mixed by source and encoded.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as
Parquet in the shared folder and read again as the next one's docs.  All but
the last return the columns of documents, extra ones with their values, whatever
their names.

Null texts and empty ones pass all stages but the mix, which takes words only.
Rows that share a doc_id are one document to the line stage and stay together in
the near-duplicate stage; null ids are never toxic by label and link with
nothing.  Equal rows are taken by the mix as separate documents.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, common, line_dedup, mixing, near_dup, queries, toxicity


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the classifier rejects (score 0.5 or more); empty and null texts stay."""
    model, score = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), common.fresh(docs.columns, "toxic_score")
    return toxicity.score(docs, model, result=score).where(F.col(score) < 0.5).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that stand earlier in the corpus, and documents of which nothing is left; n_chars is set anew where lines went."""
    removed = common.fresh(docs.columns, "removed_lines")
    left = line_dedup.dedup(docs, removed=removed).where((F.col(removed) == 0) | (F.col("text") != ""))
    changed = {"n_chars": F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return left.withColumns(changed).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id; documents without words and null ids stay."""
    return near_dup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take whole documents, some twice, so that the sources have their target weights, in the order of the mix; a document without words has no place in it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs but for the text, with n_tokens, token_ids of the whole text and decoded, the text that they give (under other names where docs has these)."""
    count, ids, decoded = (common.fresh(docs.columns, c) for c in ("n_tokens", "token_ids", "decoded"))
    found = bpe.round_trip(docs, queries.tokenizer("word_bpe_49k.json"), ids=ids, decoded=decoded)
    return found.select(*[c for c in _columns(docs) if c.lower() != "`text`"], F.size(ids).cast("long").alias(count), ids, decoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A neural score is beyond SQL: the pipeline is tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, "stage-" + name.replace(" ", "-"))
    return docs
