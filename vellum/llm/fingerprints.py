"""Operator 3: document fingerprints by a homomorphic multiset hash, DataFrame functions only.

A paragraph (a line of the text) is hashed to a wide vector; the fingerprint of
a document is the sum of its paragraphs' vectors, lane by lane, modulo a power
of two.  So the order of paragraphs doesn't matter, and a paragraph is inserted
or deleted by adding or subtracting its vector, without reading the others.

The vector has two groups of lanes.

* ``equal``: 4 lanes of 60 bits cut from the paragraph's SHA-256, summed modulo
  2**60.  Equal multisets of paragraphs have equal lanes, and others practically
  never.
* ``sketch``: 64 lanes of 16 bits.  Each piece of the paragraph (up to three
  words between punctuation marks, and in a paragraph of at most ``SHORT``
  characters, which has few of these, each run of four characters as well) adds
  1 to a lane that its hash picks, or takes 1 away, modulo 2**16.  The cosine of
  two sketches estimates how many pieces two documents share; unrelated ones lie
  within about 1/8 of zero.

All of it is one narrow projection: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import n_partitions, saved

EQUAL_LANES, EQUAL_BITS = 4, 60
SKETCH_LANES, SKETCH_BITS = 64, 16
#: A piece: up to three words with no punctuation mark or line end between them.
SHORT, GRAM = 200, 4
PIECE = r"[^\s.!?,;:]++(?:[ \t]++[^\s.!?,;:]++){0,2}"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """Struct of ``equal`` (4 longs) and ``sketch`` (64 ints) of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    mask = F.lit((1 << EQUAL_BITS) - 1).cast("long")
    digests = F.transform(F.split(whole, "\n"), lambda p: F.sha2(p, 256))
    lane = lambda ds, j: F.aggregate(
        F.transform(ds, lambda d: F.conv(F.substring(d, 1 + j * EQUAL_BITS // 4, EQUAL_BITS // 4), 16, 10).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: (a + x).bitwiseAND(mask),
    )
    equal = _let(digests, lambda ds: F.array(*[lane(ds, j) for j in range(EQUAL_LANES)]))
    keys = 2 * SKETCH_LANES
    key = lambda p: F.pmod(F.xxhash64(p), F.lit(keys)).cast("int")
    grams = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - GRAM + 1, F.lit(1))), lambda i: key(F.substring(p, i, F.lit(GRAM))))
    short = F.flatten(F.transform(F.filter(F.split(whole, "\n"), lambda p: F.length(p).between(1, SHORT)), grams))
    hashed = F.concat(F.transform(F.regexp_extract_all(whole, F.lit(PIECE), F.lit(0)), key), short)
    # Each key is there once more than it was hit; in sorted order, its count is the distance to the next one's first place.
    ordered = F.sort_array(F.concat(hashed, F.sequence(F.lit(0), F.lit(keys))))
    firsts = _let(ordered, lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))))
    sums = _let(firsts, lambda p: F.transform(F.sequence(F.lit(0), F.lit(SKETCH_LANES - 1)), lambda j: F.get(p, 2 * j + 1) * 2 - F.get(p, 2 * j) - F.get(p, 2 * j + 2)))
    return F.struct(equal.alias("equal"), F.transform(sums, _wrap).alias("sketch"))


def _wrap(x: Column) -> Column:
    """x modulo 2**16, as a signed number."""
    half = 1 << (SKETCH_BITS - 1)
    return F.pmod(x + F.lit(half), F.lit(2 * half)) - F.lit(half)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of both (sign 1), or of a without those of b (sign -1)."""
    power = F.lit(1 << EQUAL_BITS).cast("long")
    equal = F.zip_with(a["equal"], b["equal"], lambda x, y: F.pmod(x + F.lit(sign).cast("long") * y, power))
    sketch = F.zip_with(a["sketch"], b["sketch"], lambda x, y: _wrap(x + F.lit(sign) * y))
    return F.struct(equal.alias("equal"), sketch.alias("sketch"))


def as_text(f: Column) -> Column:
    """A fingerprint as lower-case hexadecimal digits: 60 for the equality lanes, 256 for the sketch."""
    equal = F.transform(f["equal"], lambda x: F.lpad(F.hex(x), EQUAL_BITS // 4, "0"))
    sketch = F.transform(f["sketch"], lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << SKETCH_BITS)).cast("long")), SKETCH_BITS // 4, "0"))
    return F.lower(F.concat(F.array_join(equal, ""), F.array_join(sketch, "")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the sketches (0 where it is negative or one is empty)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a["sketch"], a["sketch"]) * dot(b["sketch"], b["sketch"]))
    cosine = _let(norms, lambda n: F.when(n > 0, dot(a["sketch"], b["sketch"]) / n).otherwise(F.lit(0.0)))
    return F.when(a["equal"] == b["equal"], F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/3) code points replaced by the first as many (or all) of following."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def _order() -> list[Column]:
    return [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text")]


def _buckets(docs: DataFrame, n: int) -> Column:
    """The bucket (from 0, in descending order of ids, null ids last) of a row (doc_id, h) of docs: about 2 * n of them, of about as many rows.

    Cuts are approximate quantiles of the ids.  An id that holds several of them,
    and null ids, have buckets by themselves, split by h.
    """
    found = docs.agg(F.percentile_approx("doc_id", [i / (2 * n) for i in range(1, 2 * n)], 10_000).alias("c"), F.count("doc_id").alias("k"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    quantiles = found["c"] or []
    cuts = sorted(set(quantiles), reverse=True)
    each = max(1, -(-found["k"] // (2 * n)))
    hot = [(c, quantiles.count(c)) for c in cuts if quantiles.count(c) > 1]
    nulls = min(2 * n, -(-found["none"] // each)) if found["none"] else 1
    part = lambda m: F.floor(F.pmod(F.shiftrightunsigned("h", 1), F.lit(1 << 62)) / F.lit((1 << 62) / m)).cast("long")
    wide = 2 * n + 1  # buckets that an interval of ids may be split into
    # How many cuts an id lies under: first among every so many of them, then among those in between.
    step = max(1, int(len(cuts) ** 0.5))
    many = lambda cs: F.size(F.filter(cs, lambda c: c > F.col("doc_id")))
    under = F.lit(0)
    if cuts:
        coarse, fine = F.lit(cuts[step - 1 :: step]).cast("array<bigint>"), F.lit(cuts).cast("array<bigint>")
        under = _let(many(coarse) * step, lambda k: k + many(F.slice(fine, k + 1, F.lit(step))))
    inside = F.lit(0).cast("long")
    for c, m in hot:
        inside = F.when(F.col("doc_id") == c, F.least(part(m), F.lit(m - 1)) + 1).otherwise(inside)
    return F.when(F.col("doc_id").isNull(), F.lit((len(cuts) + 1) * wide) + F.least(part(nulls), F.lit(nulls - 1))).otherwise(under * wide + inside)


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each document beside the next one in descending doc_id order; after the last comes the first.

    Two tables together hold all rows, with columns doc_id, text and next_text;
    the first also has print and next_print, their fingerprints.  Null texts are empty,
    null ids come last, rows with the same id are ordered by a hash of the text.

    Texts are shuffled once, by range: rows are cut into buckets in that order
    (their number follows the shuffle partitions), and a bucket is sorted by
    itself.  Only the last row of each bucket, the second table, has its
    successor in another bucket: which rows these are is found from ids and
    hashes alone, and their texts are looked up by a table of two rows a bucket.
    """
    spark = df.sparkSession
    n = n_partitions(spark)
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = docs.withColumn("bucket", _buckets(docs, n))
    order = Window.partitionBy("bucket").orderBy(*_order())
    inner = rows.repartitionByRange(n, "bucket").withColumn("print", fingerprint(F.col("text")))
    inner = inner.withColumn("next", F.lead(F.struct("text", "print")).over(order)).where(F.col("next").isNotNull())
    inner = inner.select("doc_id", "text", "print", F.col("next.text").alias("next_text"), F.col("next.print").alias("next_print"))
    # First and last (id, h) of each bucket; rows alike in both have the same text, but for a collision of 64 bits.
    place = F.struct((-F.col("doc_id")).alias("minus"), "h")
    ends = rows.groupBy("bucket").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    everything = Window.orderBy("bucket")  # some 4 * n rows
    start = F.min(F.struct("bucket", "first")).over(Window.partitionBy(F.lit(0)))["first"]
    ends = saved(ends.withColumn("follower", F.coalesce(F.lead("first").over(everything), start)), "bucket-ends")
    wanted = ends.select(F.explode(F.array("last", "follower")).alias("w")).distinct().select((-F.col("w.minus")).alias("id"), F.col("w.h").alias("wanted_h"))
    texts = docs.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("wanted_h"))).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    texts = saved(texts, "bucket-end-texts")

    def named(prefix: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(f"{prefix}_id"), F.col("h").alias(f"{prefix}_h"), F.col("text").alias(f"{prefix}_text"))

    at = lambda c, p: (-F.col(f"{c}.minus")).eqNullSafe(F.col(f"{p}_id")) & (F.col(f"{c}.h") == F.col(f"{p}_h"))
    outer = ends.join(named("own"), at("last", "own")).join(named("next"), at("follower", "next"))
    return inner, outer.select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), F.col("next_text"))
