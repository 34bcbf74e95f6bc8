"""Operator 4: mixing sources to target weights with a low-discrepancy schedule, DataFrame functions only.

Each source is a stream of words: its documents in a shuffled order (by the MD5
of id and text), end to end, cut into blocks of equal length.  The schedule deals
slots to sources: slot k has the point k * g modulo 1, with g the golden ratio's
fraction, and goes to the source whose part of the cumulated target weights
holds that point.  So every stretch of the mix has the wanted proportions to
within a few blocks, and how many blocks a source gives in all comes from the
points as well: its words differ from its target by a few of ``SLOTS`` blocks.
The r-th slot of a source takes the r-th block of its stream, starting over
after the last one, at most ``MOST`` times.  A document's place in the mix is
its first slot.

A source of fewer than ``SMALL`` blocks, where a few of them would count, is held
to its target: its last block is cut there, slots past it are void, and blocks
that no point gave follow at its end, spread over the slots.

Two things would gather a source in one task: adding up the sizes in its stream
and ranking its slots.  Both are done in two levels, by buckets of the shuffle
order and by runs of slots: sums of buckets first, then the rows of a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fresh, n_words, saved

#: Weights of the sources in their order, over and over.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all words, and the most that a source gives of its own.
SHARE, MOST = 1.5, 2
#: Slots in the schedule: the block length follows from it, so blocks grow with the corpus and their number doesn't.
SLOTS = 1 << 16
#: Sources of fewer blocks than this are held to their target exactly.
SMALL = 256
#: Points of the sequence are k * GOLDEN modulo POINTS: the golden ratio's fraction in 31 bits, made odd.
POINTS, GOLDEN = 1 << 31, 1327217885
RUN = 1 << 10


def targets(df: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: source, source_size, weight, target.

    Sources stand by code point, null last.  A source whose part would be more
    than most times its size is held there and the excess is shared out anew by
    weight: a source is held if even the level that holds all sources with a
    lower ratio of size to weight would give it too much.
    """
    sizes = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(f"`{size}`").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))))
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"), place.alias("place"))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    free = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", (F.col("total") * F.lit(float(share)) - held) / free)
    rows = rows.withColumn("over", F.col("level") * F.col("weight") > most * F.col("source_size"))
    level = F.min(F.when(~F.col("over"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(everything)["level"]
    target = F.when(F.col("over"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", "weight", target.alias("target"))


def schedule(spark, quotas: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Slots of the mix: slot, source_no, rank (from 0 in its source).

    quotas: source_no, low, high (its part of the points), n_slots (the most it
    may use), small (whether it gets all of them: ranks that no slot has got are
    spread over the slots).
    """
    cell = 1 << 21  # points meet the parts of the circle by cells, so that this is an equi-join
    point = F.pmod(F.pmod("id", F.lit(POINTS)) * F.lit(GOLDEN), F.lit(POINTS))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / cell))
    parts = quotas.where("low < high").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    dealt = points.join(parts.select("cell", "source_no", "n_slots", "low", "high"), "cell").where("point >= low and point < high")
    dealt = dealt.select("slot", "source_no", "n_slots", F.floor(F.col("slot") / RUN).alias("run"))
    runs = dealt.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    earlier = runs.select("source_no", "run", _before("n", ["source_no"], "run").alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    ranked = dealt.join(earlier, ["source_no", "run"]).select("slot", "source_no", "n_slots", rank.alias("rank")).where("rank < n_slots")
    got = runs.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = quotas.where("small").join(got, "source_no", "left").select("source_no", F.coalesce("got", F.lit(0)).cast("long").alias("got"), "n_slots").where("n_slots > got")
    tail = short.select("source_no", "n_slots", F.explode(F.sequence("got", F.col("n_slots") - 1)).alias("rank"))
    tail = tail.select(F.floor((F.col("rank") + F.lit(0.5)) / F.col("n_slots") * slots).cast("long").alias("slot"), "source_no", "rank")
    return ranked.select("slot", "source_no", "rank").unionByName(tail)


def _before(value: str, keys: list[str], *order: str) -> Column:
    """Sum of value over the rows before this one."""
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0)).cast("long")


def streams(rows: DataFrame) -> DataFrame:
    """rows (source_no, key, doc_id, copy, size) with start: where each stands in its source's stream.

    key is 32 hexadecimal digits; its first two and next two are two levels of
    buckets, so the windows over sums see 256 rows at most and the last one the
    rows of one bucket of 65,536.
    """
    rows = rows.withColumn("b1", F.substring("key", 1, 2)).withColumn("b2", F.substring("key", 3, 2))
    fine = rows.groupBy("source_no", "b1", "b2").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("source_no", "b1").agg(F.sum("n").alias("n"))
    coarse = coarse.select("source_no", "b1", _before("n", ["source_no"], "b1").alias("start1"))
    fine = fine.select("source_no", "b1", "b2", _before("n", ["source_no", "b1"], "b2").alias("start2"))
    ahead = fine.join(coarse, ["source_no", "b1"]).select("source_no", "b1", "b2", (F.col("start1") + F.col("start2")).alias("ahead"))
    start = F.col("ahead") + _before("size", ["source_no", "b1", "b2"], "key", "doc_id", "copy")
    return rows.join(ahead, ["source_no", "b1", "b2"]).withColumn("start", start).drop("b1", "b2", "ahead")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """The place of a row in its stream: MD5 of its id (a null one is "null"), a colon and the MD5 of its text (a null one is empty)."""
    digest = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))


def _numbered(rows: DataFrame, key: str, source: str, copy: str) -> DataFrame:
    """rows with the number of each among those with its key, by source: only rows alike in id and text meet here."""
    return rows.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(F.col(f"`{source}`").asc_nulls_last())))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row for each row of df: doc_id, key, copy, source, size, source_size, target, taken, slots.

    taken counts the words that the mix takes, repeats included; slots has the
    first slot of each pass over the stream that takes any of them.  Rows stand in
    their source's stream by key (see ``shuffle_key``), then by id.  Rows alike in
    id and text are told apart by copy, in order of source; those alike in source
    too are interchangeable.  Rows without words, and all rows if there are no
    words at all, have taken 0 and no slots.
    """
    texts = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    light = saved(texts.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-rows")
    light = _numbered(light, "key", "source", "copy")
    per_source = saved(targets(light), "mix-targets")
    words = per_source.agg(F.sum("source_size")).first()[0] or 0
    length = max(1, -(-int(SHARE * words) // slots))
    slots = -(-int(SHARE * words) // length)  # as many as the mix has blocks
    # Cumulated targets on the circle of points; sources are numbered by their order.
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    high = F.when(total > 0, F.floor(upto / total * POINTS)).otherwise(F.lit(0)).cast("long")
    quotas = per_source.select("source", "source_size", "target", F.floor("target").cast("long").alias("give"), F.row_number().over(ordered).alias("source_no"), high.alias("high"))
    quotas = quotas.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0).cast("long")))
    quotas = quotas.withColumn("n_blocks", F.ceil(F.col("source_size") / length)).withColumn("small", F.col("give") < SMALL * length)
    # A pass over the stream ends with its shorter last block.
    passes = F.floor(F.col("give") / F.greatest("source_size", F.lit(1)))
    cut = F.ceil((F.col("give") - passes * F.col("source_size")) / length)
    n_slots = F.when(F.col("small"), passes * F.col("n_blocks") + cut).otherwise(MOST * F.col("n_blocks"))
    quotas = saved(quotas.withColumn("n_slots", n_slots.cast("long")), "mix-quotas")
    dealt = schedule(df.sparkSession, quotas.select("source_no", "n_slots", "low", "high", "small"), slots)
    uses = dealt.join(quotas.select("source_no", "give", "source_size", "n_blocks", "small").where("n_blocks > 0"), "source_no")
    turn, block = F.floor(F.col("rank") / F.col("n_blocks")), F.pmod("rank", F.col("n_blocks"))
    left = F.when(F.col("small"), F.col("give") - turn * F.col("source_size") - block * F.lit(length)).otherwise(F.lit(length))
    uses = uses.select("source_no", block.cast("long").alias("block"), F.struct(turn.cast("int").alias("turn"), F.least(left, F.lit(length)).cast("long").alias("use"), "slot").alias("u"))
    blocks = uses.groupBy("source_no", "block").agg(F.collect_list("u").alias("uses"))  # one for each pass, MOST at most
    rows = light.join(quotas.select("source", "source_no", "source_size", "target").withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = saved(streams(rows), "mix-streams")
    span = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))
    pieces = rows.where("size > 0").select("key", "doc_id", "copy", "source_no", "start", "size", F.explode(span).alias("block"))
    at = F.greatest(F.col("start") - F.col("block") * length, F.lit(0)).cast("long")
    end = F.least(F.col("start") + F.col("size") - F.col("block") * length, F.lit(length)).cast("long")
    taken = pieces.join(blocks, ["source_no", "block"]).select("key", "doc_id", "copy", at.alias("at"), end.alias("end"), "uses")
    got = lambda u: F.greatest(F.least(F.col("end"), u["use"]) - F.col("at"), F.lit(0).cast("long"))
    sums = [F.sum(F.aggregate("uses", F.lit(0).cast("long"), lambda s, u: s + got(u))).alias("taken")]
    for k in range(MOST):
        own = F.array_min(F.transform(F.filter("uses", lambda u: (u["turn"] == k) & (got(u) > 0)), lambda u: u["slot"]))
        sums.append(F.min(own).alias(f"slot_{k}"))
    taken = taken.groupBy("key", "doc_id", "copy").agg(*sums)
    passes = F.filter(F.array(*[f"slot_{k}" for k in range(MOST)]), lambda x: x.isNotNull())
    taken = taken.select(F.col("key").alias("taken_key"), F.col("doc_id").alias("taken_id"), F.col("copy").alias("taken_copy"), "taken", passes.alias("slots"))
    out = rows.join(taken, (F.col("key") == F.col("taken_key")) & F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("copy") == F.col("taken_copy")), "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", "key", "copy", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", none).alias("slots"))


def mixed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Rows of df as the mix takes them, in the order of their slots: whole, once or twice, or left out where none of their words is taken.

    A row without words has nothing to mix and is left out.  All columns of df
    stay, whatever their names.  Rows of one slot stand by id.
    """
    key, copy, slot, uses = (fresh(df.columns, c) for c in ("mix_key", "mix_copy", "mix_slot", "mix_uses"))
    taken = mix(df, doc_id, source, text, slots).where("taken > 0")
    taken = taken.groupBy(F.col("key").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("copy", "slots"))).alias(uses))
    # One shuffle of the texts: rows are numbered where the join has brought them.
    rows = _numbered(df.withColumn(key, shuffle_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))).join(taken, key), key, source, copy)
    rows = rows.withColumn(slot, F.explode(F.try_element_at(F.col(uses), F.col(copy))))
    order = (F.col(slot), F.col(f"`{doc_id}`"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"`{c}`" for c in df.columns])


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, ([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM rows GROUP BY source
), levels AS (
  SELECT *, ((SELECT sum(s) FROM sizes) * CAST({SHARE} AS DOUBLE) - coalesce(sum(s) OVER lower_ones, 0) * {MOST}) / ((SELECT sum(w) FROM sizes) - coalesce(sum(w) OVER lower_ones, 0)) AS lev,
    row_number() OVER (ORDER BY s / CAST(w AS DOUBLE), source NULLS LAST) AS k
  FROM sizes WINDOW lower_ones AS (ORDER BY s / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), split AS (SELECT min(k) AS k FROM levels WHERE NOT lev * w > {MOST} * s),
goals AS (
  SELECT source, s, CASE WHEN levels.k < split.k THEN CAST({MOST} * s AS DOUBLE) ELSE w * (SELECT lev FROM levels l WHERE l.k = split.k) END AS target FROM levels, split
), block AS (SELECT greatest(1, CAST(ceil(floor({SHARE} * sum(s)) / {SLOTS}) AS BIGINT)) AS len FROM sizes),
parts AS (
  SELECT *, CAST(floor(sum(target) OVER o / sum(target) OVER () * {POINTS}) AS BIGINT) AS high, CAST(floor(target) AS BIGINT) AS give, CAST(ceil(s / len) AS BIGINT) AS nb, floor(target) < {SMALL} * len AS small
  FROM goals, block WINDOW o AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), ranges AS (SELECT *, lag(high, 1, 0) OVER (ORDER BY high, source NULLS LAST) AS low FROM parts),
quotas AS (
  SELECT *, CASE WHEN small THEN give // greatest(s, 1) * nb + CAST(ceil((give % greatest(s, 1)) / len) AS BIGINT) ELSE {MOST} * nb END AS n_slots FROM ranges
), points AS (SELECT range AS slot, range * {GOLDEN} % {POINTS} AS point FROM range((SELECT CAST(ceil(floor({SHARE} * (SELECT sum(s) FROM sizes)) / len) AS BIGINT) FROM block))),
ranked AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN quotas ON point >= low AND point < high
), got AS (SELECT source, count(*) AS n FROM ranked GROUP BY source),
given AS (
  SELECT r.source, rank FROM ranked r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source WHERE rank < n_slots
  UNION ALL SELECT q.source, unnest(range(coalesce(n, 0), n_slots)) FROM quotas q LEFT JOIN got g ON g.source IS NOT DISTINCT FROM q.source WHERE small
), uses AS (
  SELECT q.source, rank % nb AS block, least(len, CASE WHEN small THEN give - rank // nb * s - rank % nb * len ELSE len END) AS use FROM given g JOIN quotas q ON g.source IS NOT DISTINCT FROM q.source WHERE nb > 0
), placed AS (
  SELECT doc_id, source, size, row_number() OVER () AS row_no, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM rows
), pieces AS (SELECT p.*, len, unnest(range(a // len, (a + size - 1) // len + 1)) AS block FROM placed p, block WHERE size > 0),
taken AS (
  SELECT row_no, sum(greatest(0, least(a + size - p.block * len, use) - greatest(0, a - p.block * len))) AS taken
  FROM pieces p JOIN uses u ON p.source IS NOT DISTINCT FROM u.source AND p.block = u.block GROUP BY row_no
)
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN taken t USING (row_no)
"""
