"""The queries of this subpackage: one for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, common, conversations, fingerprints, hard_negatives, language, licenses, line_dedup, mixing, near_dup, neighbours, personal_data, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.round_trip(docs, tokenizer("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        _sha256(F.array_join(F.col("token_ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_odd_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner, outer = fingerprints.with_next(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    outer = outer.withColumn("print", fingerprints.fingerprint(F.col("text"))).withColumn("next_print", fingerprints.fingerprint(F.col("next_text")))

    def result(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
        rows = rows.withColumn("edited_print", fingerprints.fingerprint(F.col("edited")))
        return rows.select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            _sha256(F.col("edited")).alias("edited_sha256"),
            fingerprints.as_text(F.col("print")).alias("fingerprint"),
            fingerprints.as_text(F.col("edited_print")).alias("edited_fingerprint"),
            fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
            fingerprints.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )

    return result(inner).unionByName(result(outer))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(50)) == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule, under the name that it had beside a query of three-line windows only."""
    return op6_line_dedup(spark, sf_dir)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    net = toxicity.fit(docs, labels.where(common.crc_mod(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(common.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "notices")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    coder = language.fit(docs.where(common.crc_mod(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(common.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return language.identify(docs.select("doc_id", "text"), coder).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "wavelet-shards")
    token_files.write(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path, end_id=0)
    return token_files.read(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.fit(docs))
    base = F.col("base_spans")
    counts = [personal_data.count(base, kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, _sha256(personal_data.listed(base)).alias("base_sha256"), personal_data.listed(F.col("pii_spans")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bpe_round_trip,
        op2_odd_sketch_near_duplicates,
        op3_multiset_fingerprints,
        op4_source_mix,
        op5_nn_descent,
        op6_line_dedup,
        op6_line_dedup_passages,
        op7_toxicity,
        op8_license_scan,
        op9_language,
        op10_wavelet_shards,
        op11_hard_negatives,
        op12_personal_data,
        op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {
    "op4_source_mix": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op6_line_dedup_passages": line_dedup.ORACLE,
    "op8_license_scan": licenses.oracle(),
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
