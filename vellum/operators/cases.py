"""Case reports: severity, duplicates, module gate, priority and narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity(text: Column) -> Column:
    """Struct of event and severity by words of a text, death before disability before hospitalisation; nulls where none is there."""
    low = F.lower(text)
    made = lambda a, b: F.struct(F.lit(a).alias("event"), F.lit(b).alias("severity"))
    return (
        F.when(low.contains("death") | low.contains("fatal"), made("Death", "High"))
        .when(low.contains("disability") | low.contains("disabled"), made("Disability", "High"))
        .when(low.contains("hospitalization") | low.contains("hospitalisation") | low.contains("admitted"), made("Hospitalisation", "Medium"))
        .otherwise(F.struct(F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("severity")))
    )


def duplicates(cases: DataFrame, name: str = "file_name", signature: str = "signature", order: str = "case_ord") -> DataFrame:
    """cases with ``duplicate_of`` and ``similarity``: the earliest prior case of the same name (1.0) or the same signature in lower case (0.95).

    Of the two, the earlier case counts, by name if they are one.  Only firsts
    are needed, so no window is made: a grouped minimum meets the cases in joins
    that Spark can split.  Null names and signatures match nothing.
    """
    low = F.lower(signature)
    rows = cases.withColumn("_sig", F.when(low != "", F.concat(F.md5(low.cast("binary")), F.length(low))))  # digests travel, not texts
    by_name = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_n")).agg(F.min(order).alias("_first_name"))
    by_sig = rows.where("_sig IS NOT NULL").groupBy(F.col("_sig").alias("_s")).agg(F.min(order).alias("_first_sig"))
    rows = rows.join(by_name, F.col(name) == F.col("_n"), "left").join(by_sig, F.col("_sig") == F.col("_s"), "left")
    a, b = F.when(F.col("_first_name") < F.col(order), F.col("_first_name")), F.when(F.col("_first_sig") < F.col(order), F.col("_first_sig"))
    named = a.isNotNull() & (b.isNull() | (a <= b))
    rows = rows.withColumn("duplicate_of", F.least(a, b)).withColumn("similarity", F.when(named, 1.0).when(b.isNotNull(), 0.95).otherwise(0.0))
    return rows.drop("_sig", "_n", "_s", "_first_name", "_first_sig")


def detection_sample(pages: DataFrame) -> DataFrame:
    """What a module is told from: the first 1,500 characters of a file's first two pages, end to end."""
    rows = pages.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("page"))).where("rn <= 2")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.left(F.coalesce("raw_text", F.lit("")), F.lit(1500)).alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy("file").agg(text.alias("sample"))


def gated(cases: DataFrame, module: str = "module", applicable: str = "sae_applicable") -> DataFrame:
    """cases with ``classified``: only those of module 5, or that are marked applicable, go on."""
    return cases.withColumn("classified", (F.col(module) == "Module 5") | F.coalesce(F.col(applicable), F.lit(False)))


def hash31(text: Column) -> Column:
    """The 32-bit hash h * 31 + code of a text's characters."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))


def priority(level: Column, seed: Column) -> Column:
    """A score within the band of a severity, spread by a hash of the seed.

    Tenths are rounded after the multiplication by ten, not by the decimal digits of the score: 1.5 + 3.5 * 0.7 gives 4.0.
    """
    t = (hash31(seed) % 1000) / F.lit(1000.0)
    low = F.lower(level)
    score = F.when(low == "high", 8.5 + 1.5 * t).when(low == "medium", 5.5 + 2.5 * t).when(low == "low", 1.5 + 3.5 * t).otherwise(F.lit(2.0))
    return F.floor(score * 10 + 0.5) / 10


def bucket(seriousness: Column) -> Column:
    """The bucket that a seriousness is shown in, by words in it; a missing one is among the others."""
    low = F.lower(F.coalesce(seriousness, F.lit("")))
    return F.when(low.contains("death"), "Death").when(low.contains("disability"), "Disability").when(low.contains("hospital"), "Hospitalisation").otherwise("Others")


def case_id(n: Column, year: int = 2026) -> Column:
    return F.concat(F.lit(f"SAE-{year}-"), F.lpad(n.cast("string"), 3, "0"))


def narrative(case_narrative: Column, event: Column, outcome: Column, causality: Column, onset: Column, drug: Column, age: Column, gender: Column, sources: list[Column]) -> Column:
    """The narrative; or its labelled parts; or the snippets of the first source that has any; or a constant.

    sources are arrays of snippets (of event, outcome and seriousness); empty ones
    and what the rule engine has put out don't count.
    """
    given = lambda c: F.when(c != "", c)
    labelled = lambda label, c: F.concat(F.lit(f"{label}: "), given(c))
    present = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    patient = labelled("Patient", F.array_join(present(given(age), given(gender)), ", "))
    parts = present(labelled("Event", event), labelled("Outcome", outcome), labelled("Causality", causality), labelled("Onset", onset), labelled("Suspected drug", drug), patient)
    usable = lambda a: F.filter(F.transform(a, lambda x: F.btrim(x)), lambda x: (x != "") & ~F.lower(x).contains("rule-based engine output"))
    snippets = [F.when(F.size(usable(a)) > 0, F.array_join(usable(a), " ")) for a in sources]
    return F.coalesce(given(case_narrative), given(F.array_join(parts, ". ")), *snippets, F.lit("No narrative available."))


def histogram(cases: DataFrame, seriousness: str = "seriousness") -> DataFrame:
    """Cases by bucket."""
    return cases.groupBy(bucket(F.col(seriousness)).alias("bucket")).agg(F.count("*").alias("n"))


# What is told about a submission.
GENERIC_MESSAGE = "This drug is already listed in CDSCO. You should submit this as a Generic Drug Application, not as an NDA."
NEW_MESSAGE = "This is a new drug you can submit this application as NDA (new drug application)"


def eligibility_message(submission_type: Column) -> Column:
    """What is told about a type of submission."""
    return F.when(submission_type == "Generic Drug Application", GENERIC_MESSAGE).otherwise(NEW_MESSAGE)
