"""Calls of models over rows: errors become rows, answers become values, and what an index holds is embedded anew only where it changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import outer_json
from vellum.session import ship

#: Calls of a task that are under way at a time.
AT_ONCE = 10
# What stands for an answer that failed.
NOT_JSON = "Failed to parse JSON"
NO_SUMMARY = "Error generating overall summary."


def _schema(df: DataFrame, *more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(m, T.StringType()) for m in more)])


def called(df: DataFrame, column: str, model: Callable[[str], str], answer: str = "answer", error: str = "error", at_once: int = AT_ONCE) -> DataFrame:
    """df with a model's answer to a column, and the error where it raised one.

    Calls of a task run side by side, at_once of them at the most; rows keep their
    order.  A null prompt is not sent.  A failure concerns its own row only.
    """
    ship(df.sparkSession)

    def one(prompt) -> tuple[str | None, str | None]:
        if prompt is None or prompt is pd.NA:
            return None, None
        try:
            return model(prompt), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for k in range(0, len(batch), 16 * at_once):  # so many prompts and answers wait at the most
                    part = batch.iloc[k : k + 16 * at_once]
                    pairs = list(pool.map(one, part[column].tolist()))
                    yield part.assign(**{answer: [a for a, _ in pairs], error: [e for _, e in pairs]})

    return df.mapInPandas(run, _schema(df, answer, error))


def json_answer(answer: Column) -> Column:
    """An answer as struct of value (JSON as a variant), error and raw_response; null for no answer.

    The outermost object counts, in prose or fences or not; an answer without a
    readable one gives an error and stands in raw_response whole.
    """
    value = F.try_parse_json(F.coalesce(outer_json(answer), F.lit("")))
    bad = value.isNull()
    return F.when(answer.isNotNull(), F.struct(value.alias("value"), F.when(bad, NOT_JSON).alias("error"), F.when(bad, answer).alias("raw_response")))


def field_verdicts(calls: DataFrame, field: str = "field", answer: str = "answer", error: str = "error") -> DataFrame:
    """calls with value and consistency: a call that failed counts as consistent, with its error as the value.

    An answer is JSON with the field's name as a key, and ``consistency``; where
    it says nothing of that, it is Consistent too.
    """
    parsed = json_answer(F.col(answer))
    text = lambda key: F.try_variant_get(F.col("_j.value"), key, "string")
    rows = calls.withColumn("_j", parsed)
    pairs = F.from_json(outer_json(F.col(answer)), "map<string,string>")
    value = F.coalesce(F.try_element_at(pairs, F.col(field)), F.lit(""))
    failed = F.coalesce(F.col(error), F.col("_j.error"))
    return rows.withColumn("value", F.when(failed.isNotNull(), F.concat(F.lit("Error: "), failed)).otherwise(value)).withColumn("consistency", F.when(failed.isNotNull(), "Consistent").otherwise(F.coalesce(text("$.consistency"), F.lit("Consistent")))).drop("_j")


def overall_summary(answer: Column, error: Column) -> Column:
    """Struct of value, confidence and source of an overall summary, with a fixed value where its call failed or gave no JSON."""
    kind = "struct<value:string,confidence:string,source:array<string>>"
    given = F.from_json(outer_json(answer), kind)
    said = F.try_variant_get(json_answer(answer)["value"], "$.error", "string").isNotNull()
    failed = error.isNotNull() | answer.isNull() | json_answer(answer)["error"].isNotNull() | F.coalesce(said, F.lit(False))
    return F.when(failed, F.struct(F.lit(NO_SUMMARY).alias("value"), F.lit("low").alias("confidence"), F.array().cast("array<string>").alias("source")).cast(kind)).otherwise(given)


def batch(files: DataFrame, path: str, run: Callable[[DataFrame], DataFrame], extension: str = ".pdf") -> tuple[DataFrame, Observation]:
    """Files of a batch with what ``run`` makes of those with the extension, and an observation of the batch.

    run: from files to rows with ``error`` (null where a file went well), as
    ``called`` gives them.  Others are skipped, and failures do not end the batch.
    The observation has n_ok and n_files, counted while the rows are computed,
    without a second pass; ``message`` puts them in words.
    """
    seen = Observation()
    chosen = F.lower(F.col(path)).endswith(extension)
    done = run(files.where(chosen)).withColumn("skipped", F.lit(False))
    rest = files.where(~F.coalesce(chosen, F.lit(False)))
    for f in done.schema.fields:
        if f.name not in rest.columns:
            rest = rest.withColumn(f.name, F.lit(True) if f.name == "skipped" else F.lit(None).cast(f.dataType))
    rows = done.unionByName(rest.select(*[f"`{c}`" for c in done.columns]))
    good = ~F.col("skipped") & F.col("error").isNull()
    return rows.observe(seen, F.count_if(good).alias("n_ok"), F.count(F.lit(1)).alias("n_files")), seen


def message(seen: Observation) -> str:
    """After an action on the batch's rows."""
    n = seen.get
    return f"Successfully processed {n['n_ok']} of {n['n_files']} files."


def json_safe(df: DataFrame) -> DataFrame:
    """df with values that JSON has, at any depth: NaN and infinities are null, decimals doubles, bytes Base64, times ISO text.

    Names of columns and fields stay; map keys become text.
    """

    def safe(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        if isinstance(kind, T.DecimalType):
            return x.cast("double")
        if isinstance(kind, T.BinaryType):
            return F.base64(x)
        if isinstance(kind, T.DateType):
            return F.date_format(x, "yyyy-MM-dd")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda v: safe(v, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].cast("string").alias("key"), safe(e["value"], kind.valueType).alias("value"))))
        if isinstance(kind, T.StructType):
            return F.when(x.isNotNull(), F.struct(*[safe(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
        return x

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def changes(items: DataFrame, index: DataFrame, model: str, key: str = "key", content: str = "content") -> DataFrame:
    """What an index lacks: key, digest, status (new, changed, same, gone).

    items: key and content (text or bytes); index: key, digest and model, a row
    for each key.  A key counts as changed if its content's SHA-256 or the model
    did.  Of items with the same key the greatest digest counts.  Null contents are empty.
    """
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    now = items.groupBy(F.col(key).alias("key")).agg(F.max(F.sha2(raw, 256)).alias("digest"))
    old = index.select(F.col(key).alias("old_key"), F.col("digest").alias("old_digest"), F.col("model").alias("old_model"), F.lit(True).alias("known"))
    both = now.withColumn("here", F.lit(True)).join(old, F.col("key").eqNullSafe(F.col("old_key")), "full")
    same = F.col("digest").eqNullSafe(F.col("old_digest")) & F.col("old_model").eqNullSafe(F.lit(model))
    status = F.when(F.col("here").isNull(), "gone").when(F.col("known").isNull(), "new").when(same, "same").otherwise("changed")
    return both.select(F.when(F.col("here").isNull(), F.col("old_key")).otherwise(F.col("key")).alias("key"), F.coalesce("digest", "old_digest").alias("digest"), status.alias("status"))


def refreshed(items: DataFrame, index: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, key: str = "key", content: str = "content") -> DataFrame:
    """The index after a change of items: key, digest, model, vector.

    Only new and changed items go through ``embed`` (from key, content to key,
    vector); vectors of the same ones stay, and what is gone goes.
    """
    found = changes(items, index, model, key, content)
    todo = found.where(F.col("status").isin("new", "changed"))
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    wanted = items.select(F.col(key).alias("_key"), F.col(content).alias("content"), F.sha2(raw, 256).alias("_digest"))
    wanted = wanted.join(todo, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_digest") == F.col("digest"))).select("key", "content").dropDuplicates(["key"])
    made = embed(wanted).select(F.col("key").alias("_key"), "vector")
    fresh = todo.join(made, F.col("key").eqNullSafe(F.col("_key"))).select("key", "digest", F.lit(model).alias("model"), "vector")
    kept = index.select(F.col(key).alias("key"), "digest", "model", "vector").join(found.where("status = 'same'").select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    return kept.unionByName(fresh)
