"""Operator 11: hard negatives by bit-sliced integer products.

Each component x becomes the integer floor(256 x), and a block of rows is kept
as bit-planes: one bit of every component, the sign's plane first.  The inner
products of a chunk of anchors with a block are built up plane by plane from
the most significant one.  After each plane a product is known to lie in an
interval, as wide as what the planes to come can add or take away at most
(the sums of an anchor's positive and negative components, times what is left of
a component).  Pairs whose interval cannot qualify any more are dropped; once
few are left, only they get the remaining planes.  After the last plane an
interval is one number, the exact product.

Two passes over the blocks.  The first keeps the best rows of an anchor's own
label, its positives; an interval qualifies if its upper end reaches the k-th
best product that is certain.  The second looks for rows of other labels, whose
products lie between shares of a positive's (its window), and keeps the best for each.
Bounds found in one block hold in the next ones.

Every block meets every chunk: chunks are copied to all parts of the blocks, a
block goes to one part, and a task streams over the pairs of a part, holding one
chunk and one block.  At very many anchors (over ``GROUP_CHUNKS`` chunks) they
are split into groups, and blocks are copied to each group.  Parts and groups
are dealt by a hash of the block's number, so that no label, id or vector is a key.

Rows with a null id, a null label, a null vector or a null or non-finite component take no
part.  Vectors are compared with those of the same length.  Rows with an
anchor's id are no candidates of it; repeated rows are candidates each, and
repeated anchors each have their own answers.  Any finite component will do:
where products outgrow floats, Python's integers are used, and a score that no
long can hold is given as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import map_arrow, n_partitions, saved

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Rows of a block, anchors of a chunk, and chunks that a part gets at most.
ROWS, ANCHORS, GROUP_CHUNKS = 4096, 1024, 256
#: Pairs are treated one by one when at most this share is left, so many at a time.
SPARSE, PAIRS = 0.06, 1 << 16
LONG = (1 << 63) - 1

BLOCK = "dim int, ids binary, labels binary, width int, planes binary"


def usable(df: DataFrame, asked: Column, vec_id: str, vector: str, label: Column) -> DataFrame:
    """id, label, vector (doubles) and asked of the rows that take part."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE x) of rows of doubles as integers, and the bits that each row's components need, sign included."""
    most = np.abs(x).max(axis=1, initial=0).tolist()
    bits = np.array([(int(m) * SCALE + SCALE).bit_length() + 1 for m in most], np.int64)
    if bits.max(initial=1) < 53:
        q = np.floor(x * SCALE).astype(np.int64)
        return q, np.array([int(m).bit_length() + 1 for m in np.abs(q).max(axis=1, initial=0).tolist()], np.int64)
    return np.array([[math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in r] for r in x.tolist()], object).reshape(x.shape), bits


def sliced(q: np.ndarray, width: int) -> bytes:
    """Bit-planes of integers in two's complement, the sign's first."""
    return b"".join(np.packbits(((q >> k) & 1).astype(bool)).tobytes() for k in range(width - 1, -1, -1))


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of id, label, vector as blocks of at most so many rows: of one length and of alike magnitude, ordered by label."""
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        vectors = batch.column(2)
        sizes = np.diff(vectors.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            q, bits = quantised(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(np.float64))
            kind = np.searchsorted([12, 24, 60], bits)
            for c in np.unique(kind).tolist():
                own = np.flatnonzero(kind == c)
                own = own[np.lexsort((ids[at[own]], labels[at[own]]))]
                for k in range(0, len(own), most):
                    some = own[k : k + most]
                    width = int(bits[some].max())
                    part = q[some] if width > 60 else q[some].astype(np.int64)
                    yield pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids[at[some]].tobytes(), "labels": labels[at[some]].tobytes(), "width": width, "planes": sliced(part, width)}], _schema())


def _schema() -> pa.Schema:
    return pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("planes", pa.binary())])


class Rows:
    """A block as arrays: ids, labels, and bit-planes by component, the sign's first."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, width: int, planes: bytes):
        self.ids, self.labels, self.width = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), width
        n = len(self.ids)
        raw = np.frombuffer(planes, np.uint8).reshape(width, -(-n * dim // 8))
        self.planes = np.unpackbits(raw, axis=1, count=n * dim).reshape(width, n, dim)

    def integers(self) -> np.ndarray:
        kind = np.int64 if self.width <= 62 else object
        out = np.zeros(self.planes.shape[1:], kind)
        for p, k in zip(self.planes, range(self.width - 1, -1, -1)):
            out += p.astype(kind) * kind(-(1 << k) if k == self.width - 1 else 1 << k) if kind is np.int64 else p.astype(object) * (-(1 << k) if k == self.width - 1 else 1 << k)
        return out

    def runs(self) -> dict[int, tuple[int, int]]:
        """Where each label's rows stand."""
        labels, first = np.unique(self.labels, return_index=True)
        return dict(zip(labels.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(self.labels)])))


#: (lower ends, upper ends, anchor of each or None for a whole matrix) -> which may still qualify.
Useful = Callable[[np.ndarray, np.ndarray, "np.ndarray | None"], np.ndarray]


def number_kind(a: np.ndarray, width: int):
    """The smallest kind of number that holds every partial product of these anchors with components of so many bits, and its bound."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, a.shape[1]) << (width + 1)
    return (np.float32, 1 << 24) if most < 1 << 24 else (np.float64, 1 << 53) if most < 1 << 53 else (object, 0)


def sift(a: np.ndarray, planes: np.ndarray, allowed: np.ndarray, useful: Useful) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (anchor, row) that qualify to the last plane, with their products.

    a: integers of the anchors, already of the kind to compute in; planes: of
    the rows; allowed: the pairs that come into question at all.
    """
    low, high = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    product, rows, cols = np.zeros(allowed.shape, a.dtype), None, None
    for i, plane in enumerate(planes):
        k = len(planes) - 1 - i
        weight = -(1 << k) if i == 0 else 1 << k
        rest = (1 << k) - 1
        if rows is None:
            product += (a * weight) @ plane.T.astype(a.dtype)
            allowed = allowed & useful(product + (low * rest)[:, None], product + (high * rest)[:, None], None)
            if np.count_nonzero(allowed) <= SPARSE * allowed.size or k == 0:
                rows, cols = np.nonzero(allowed)
                product = product[rows, cols]
        else:
            for j in range(0, len(rows), PAIRS):
                r, c = rows[j : j + PAIRS], cols[j : j + PAIRS]
                bits = plane[c].astype(a.dtype)
                product[j : j + PAIRS] += weight * ((a[r] * bits).sum(axis=1) if a.dtype == object else np.einsum("ij,ij->i", a[r], bits))
            keep = useful(product + low[rows] * rest, product + high[rows] * rest, rows).astype(bool)
            rows, cols, product = rows[keep], cols[keep], product[keep]
    return rows, cols, product


class Best:
    """The k best (score, then smaller id) for each of n places, with what else is known of them."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.place, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)
        self.floor = np.full(n, -np.inf)
        self.exact: np.ndarray | None = None

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(place):
            return
        wide = score.dtype == object or self.score.dtype == object and len(self.score)
        kind = object if wide else np.int64
        place = np.concatenate([self.place, place])
        score, ids = np.concatenate([self.score.astype(kind), score.astype(kind)]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, place)) if not wide else np.array(sorted(range(len(place)), key=lambda i: (place[i], -score[i], ids[i])), np.int64)
        place, score, ids = place[order], score[order], ids[order]
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        rank = np.arange(len(place)) - np.repeat(start, np.diff(np.r_[start, len(place)]))
        keep = rank < self.k
        self.place, self.score, self.id = place[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        # A bound for the kernel: never above the k-th best score, however it is rounded.
        self.floor[self.place[last]] = [x if abs(x) < 1 << 53 else -np.inf for x in self.score[last].tolist()]


def _saturated(score: np.ndarray) -> pa.Array:
    return pa.array([max(-LONG - 1, min(LONG, int(x))) for x in score.tolist()], pa.int64())


def _same_label(anchors: Rows, a: np.ndarray, rows: Rows, best: Best) -> None:
    """Enter the best rows of each anchor's label."""
    theirs = rows.runs()
    for label, (m0, m1) in anchors.runs().items():
        if label not in theirs:
            continue
        n0, n1 = theirs[label]
        own = a[m0:m1]
        kind, bound = number_kind(own, rows.width)
        allowed = anchors.ids[m0:m1, None] != rows.ids[None, n0:n1]
        floor = best.floor[m0:m1]

        def useful(low: np.ndarray, high: np.ndarray, at: np.ndarray | None, floor=floor, allowed=allowed) -> np.ndarray:
            if at is not None:
                return high >= floor[at]
            least = floor
            if low.shape[1] > best.k and low.dtype != object:  # the k-th best that is certain in this block
                sure = np.partition(np.where(allowed, low, -np.inf), low.shape[1] - best.k, axis=1)[:, low.shape[1] - best.k]
                least = np.maximum(floor, sure)
            return (high >= least[:, None].astype(high.dtype if high.dtype != object else float)).astype(bool)

        r, c, product = sift(own.astype(kind), rows.planes[:, n0:n1], allowed, useful)
        best.add(r + m0, product if product.dtype == object else np.rint(product).astype(np.int64), rows.ids[n0:n1][c])


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer n with 50 p <= 100 n <= 95 p, for integers p that may be near a long's end."""
    return -((-positive) // 2), positive + ((-positive) // 20)


def _other_labels(anchors: Rows, a: np.ndarray, least: np.ndarray, most: np.ndarray, rows: Rows, best: Best) -> None:
    """Enter the best rows of other labels within each window; least and most: by anchor and window, empty ones reversed."""
    kind, bound = number_kind(a, rows.width)
    allowed = (anchors.labels[:, None] != rows.labels[None]) & (anchors.ids[:, None] != rows.ids[None])
    if kind is object:
        bottom, top = np.where(least <= most, least, 1).astype(object), np.where(least <= most, most, 0).astype(object)
        empty = least > most
    else:
        # Products and interval ends lie within the bound, so ends beyond it can be cut to it.
        bottom = np.clip(np.maximum(least, best.floor.reshape(least.shape)), -bound, bound).astype(kind)
        top, empty = np.clip(most, -bound, bound).astype(kind), least > most
    first = np.where(empty, np.inf, bottom).min(axis=1)
    last = np.where(empty, -np.inf, top).max(axis=1)

    def useful(low: np.ndarray, high: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        if at is None:
            kind_ = high.dtype if high.dtype != object else object
            return ((high >= first[:, None].astype(kind_)) & (low <= last[:, None].astype(kind_))).astype(bool)
        keep = np.zeros(len(at), bool)
        for t in range(bottom.shape[1]):
            keep |= (~empty[at, t]) & (high >= bottom[at, t]).astype(bool) & (low <= top[at, t]).astype(bool)
        return keep

    r, c, product = sift(a.astype(kind), rows.planes, allowed, useful)
    product = product if product.dtype == object else np.rint(product).astype(np.int64)
    for t in range(least.shape[1]):
        keep = ((product >= least[r, t]) & (product <= most[r, t])).astype(bool)
        best.add(r[keep] * least.shape[1] + t, product[keep], rows.ids[c[keep]])


class _Pair:
    """A row of a batch, whose values are made when they are asked for."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.batch, self.i = batch, i

    def __getitem__(self, name: str):
        return self.batch.column(name)[self.i].as_py()


def _streamed(batches: Iterator[pa.RecordBatch], open_: Callable, meet: Callable, close: Callable) -> Iterator[pa.RecordBatch]:
    """Runs over the pairs of chunk and block; the state of a chunk is kept while its pairs follow each other."""
    now, state = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            pair = _Pair(batch, i)
            if state is None or pair["chunk"] != now:
                if state is not None:
                    yield from close(now, state)
                now, state = pair["chunk"], open_(pair)
            meet(state, Rows(pair["dim"], pair["ids"], pair["labels"], pair["width"], pair["planes"]))
    if state is not None:
        yield from close(now, state)


def _pairs(chunks: DataFrame, rows: DataFrame, groups: int, parts: int) -> DataFrame:
    """Every block with every chunk of its length, a part at a time; the merge join gives a chunk's pairs one after the other."""
    at = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    left = chunks.withColumn("grp", at("chunk", groups)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("part", at("block", parts)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("block")
    return left.join(right.hint("merge"), ["dim", "grp", "part"]).drop("grp", "part")


def _anchor_arrays(pair: _Pair) -> tuple[Rows, np.ndarray]:
    chunk = Rows(pair["dim"], pair["a_ids"], pair["a_labels"], pair["a_width"], pair["a_planes"])
    return chunk, chunk.integers()


def positives(pairs: DataFrame, k: int) -> DataFrame:
    """chunk, anchor (place in it), id, score: the k best of a part for each anchor."""
    schema = pa.schema([("chunk", pa.int64()), ("anchor", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def open_(pair: _Pair) -> tuple:
        chunk, a = _anchor_arrays(pair)
        return chunk, a, Best(len(chunk.ids), k)

    def close(chunk: int, state: tuple) -> Iterator[pa.RecordBatch]:
        best = state[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.place), chunk)), pa.array(best.place.astype(np.int32)), pa.array(best.id), _saturated(best.score)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, open_, lambda s, rows: _same_label(s[0], s[1], rows, s[2]), close)

    return map_arrow(pairs, run, "chunk bigint, anchor int, id bigint, score bigint")


def negatives(pairs: DataFrame, k: int) -> DataFrame:
    """For each anchor and positive of ``found`` in a chunk, the k best of a part: chunk, anchor, positive (place), anchor_id, positive_id, positive_score, id, score."""
    names = ["chunk", "anchor", "positive", "anchor_id", "positive_id", "positive_score", "id", "score"]

    def open_(pair: _Pair) -> tuple:
        chunk, a = _anchor_arrays(pair)
        found = pair["found"]
        n, width = len(chunk.ids), max(f["place"] for f in found)
        score, ids = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        there = np.zeros((n, width), bool)
        for f in found:
            score[f["anchor"], f["place"] - 1], ids[f["anchor"], f["place"] - 1], there[f["anchor"], f["place"] - 1] = f["score"], f["id"], True
        least, most = windows(score)
        return chunk, a, np.where(there, least, 1), np.where(there, most, 0), score, ids, Best(n * width, k)

    def meet(s: tuple, rows: Rows) -> None:
        _other_labels(s[0], s[1], s[2], s[3], rows, s[6])

    def close(name: int, s: tuple) -> Iterator[pa.RecordBatch]:
        chunk, best, width = s[0], s[6], s[2].shape[1]
        a, t = np.divmod(best.place, width)
        arrays = [np.full(len(a), name), a.astype(np.int32), t.astype(np.int32) + 1, chunk.ids[a], s[5][a, t], s[4][a, t], best.id]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), _saturated(best.score)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, open_, meet, close)

    return map_arrow(pairs, run, "chunk bigint, anchor int, positive int, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint")


def mine(df: DataFrame, asked: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, block: int = ROWS, chunk: int = ANCHORS, group: int = GROUP_CHUNKS) -> DataFrame:
    """Hard negatives of the rows where ``asked`` holds, against all rows.

    An anchor's positives are the n_positives other rows of its label with the
    highest scores; for each, the n_negatives rows of other labels with the
    highest scores from half to 95 hundredths of the positive's.  Ties go to
    the smaller id; where fewer rows qualify, all of them are returned.
    block: rows of a block; chunk: anchors of a chunk; group: chunks that a part gets at most.
    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    An empty table, or one without anchors, gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df, asked, vec_id, vector, F.col("label") if label is None else label)
    packed = map_arrow(rows.select("id", "label", "vector"), lambda batches: blocks(batches, block), BLOCK)
    packed = saved(packed.withColumn("block", F.monotonically_increasing_id()), "hn-blocks")
    anchors = rows.where("asked").select("id", "label", "vector")
    n = anchors.count()
    dealt = anchors.repartition(max(1, -(-n // chunk)))
    chunks = map_arrow(dealt, lambda batches: blocks(batches, chunk), BLOCK).toDF("dim", "a_ids", "a_labels", "a_width", "a_planes")
    chunks = saved(chunks.withColumn("chunk", F.monotonically_increasing_id()), "hn-anchors")
    groups = max(1, -(-chunks.count() // group))
    parts = max(1, -(-2 * n_partitions(spark) // groups))
    near = positives(_pairs(chunks, packed, groups, parts), n_positives)
    place = F.row_number().over(Window.partitionBy("chunk", "anchor").orderBy(F.desc("score"), "id"))
    near = near.withColumn("place", place).where(F.col("place") <= n_positives)
    near = near.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "place", "id", "score")).alias("found"))  # at most ANCHORS times n_positives
    known = saved(chunks.join(near, "chunk"), "hn-positives")
    far = negatives(_pairs(known, packed, groups, parts), n_negatives)
    rank = F.row_number().over(Window.partitionBy("chunk", "anchor", "positive").orderBy(F.desc("score"), "id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The contract of the query in DuckDB's SQL.
ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
