"""Operator 2: near-duplicate documents by MinHash, odd sketches and an exact check.

A document's set holds its distinct five-word shingles.  One pass over the
texts makes a signature of each: 240 MinHash samples, cut into 48 bands of five,
and an odd sketch, that is, a bitmap of 1024 parities into which the samples are
folded.  The population count of the XOR of two odd sketches tells, most
precisely for high similarities, in how many samples two documents differ, so a
candidate pair costs 16 words of XOR instead of two sets.  Pairs that may reach
the threshold are then confirmed on the full sets.

Documents with equal sets form one class and only its representative is banded.
Candidates within a band's bucket are not paired with each other:

* first each member looks for the closest odd sketch in its part of the bucket
  (at most ``BLOCK`` members) and among a few leaders that all parts of a bucket
  share, and that one pair is confirmed.  This joins most of a group of any number
  of near copies, with work in proportion to its members;
* then only buckets that still hold more than one component are looked at, and
  in them only pairs across components: the members of the largest component
  meet the others, but not each other, in blocks of at most ``BLOCK``.  Members
  without a candidate across are left out by their sketches; the full sets of the
  others are sent, and pairs are tested where they are, the closest first.  A pair
  that has been joined meanwhile is passed over, so a block gives no more links
  than it has components.

So each pair that shares a bucket is either tested or already in one component.
Two chances are left out of account: a pair at the threshold shares no bucket
with probability (1 - 0.75**5)**48, about 2 in a million, and its sketches differ
in more than ``MOST_BITS`` bits, five standard deviations above the mean, hardly
ever.  With ``most_bits=SKETCH_BITS`` no sketch rules a pair out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import complete_groups, fresh, map_arrow, saved

SHINGLE_WORDS = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, BAND_ROWS = 48, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 1024
#: Odd sketches of a pair at the threshold differ in about 107 bits; this is about five standard deviations above.
MOST_BITS = 172
BLOCK = 256
#: Members of a large bucket that all its parts share (on average: they are chosen by a hash).
LEADERS = 16

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_A = _SEED.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _SEED.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_BAND = _SEED.integers(0, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _SEED.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_FOLD = _SEED.integers(0, 1 << 62, SAMPLES, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(SHINGLE_WORDS)], np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(n: int, up: bool) -> np.ndarray:
    """The first n powers of P (up) or of its inverse, modulo 2**64."""
    if len(_powers[up]) < n:
        factor = np.full(max(n, 1 << 16), _P if up else _P_INVERSE, np.uint64)
        factor[0] = 1
        _powers[up] = np.cumprod(factor, dtype=np.uint64)
    return _powers[up][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: none without words, one with fewer than five."""
    raw = np.frombuffer((text or b"").translate(_LOWER), np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_BLANK[raw]
    edges = np.diff(solid)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(len(raw), True), dtype=np.uint64, out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * _power(len(raw), False)[starts] + (ends - starts).astype(np.uint64))
    k = min(len(words), SHINGLE_WORDS)
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _Q[j]
    return np.unique(_mixed(total))


def minhash(values: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set of hashes."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(high), 512):
        table = _A[:, None] * high[None, i : i + 512]
        table += _B[:, None]
        np.minimum(least, table.min(axis=1), out=least)
    return least


def bands(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    return _mixed((samples.astype(np.uint64) * _BAND).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Samples folded into parities: 16 words of 64 bits."""
    at = _mixed(samples.astype(np.uint64) + _FOLD) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    return pa.array([None if x is None else x for x in rows], pa.list_(kind))


SIGNATURE = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>"


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, digest of the set, band keys, odd sketch (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500)
                sizes, digests, keys, sketches = [], [], [], []
                for t in rows.column(1).to_pylist():
                    found = shingles(t)
                    samples = minhash(found) if len(found) else None
                    sizes.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    keys.append(None if samples is None else bands(samples))
                    sketches.append(None if samples is None else odd_sketch(samples))
                columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(keys, pa.int64()), _lists(sketches, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return map_arrow(source, run, SIGNATURE)


def full_sets(df: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The shingle sets of nodes (node, digest): node, n, shingles."""
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("node"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                out: dict[int, np.ndarray] = {}
                for node, t, digest in zip(*(some.column(i).to_pylist() for i in range(3))):
                    found = shingles(t)
                    if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == digest:
                        out[node] = found.view(np.int64)
                names = list(out)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(out[i]) for i in names], pa.int64()), _lists([out[i] for i in names], pa.int64())], ["node", "n", "shingles"])

    return map_arrow(source.join(nodes, "node").select("node", "text", "digest"), run, "node bigint, n bigint, shingles array<bigint>")


def similarity(bits: float) -> float:
    """Jaccard similarity that odd sketches with so many differing bits point to."""
    odd = min(2 * bits / SKETCH_BITS, 1 - 1e-9)
    return max(0.0, 1 + SKETCH_BITS / 4 / SAMPLES * float(np.log(1 - odd)))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are linked by their full sets, each pair once."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return once.join(left, "a").join(right, "b").where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * PERCENT).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): the least node it is connected to.

    In each round a node takes the least label among its neighbours and then the
    label of that label, so a path's length halves.  A round's labels are written
    as a table; the least is taken before the shuffle, and no join gathers a node's
    edges in a place that Spark cannot split.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(edges.where("a <> b").select(F.inline(ways)), "cc-edges")
    now = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "cc-labels")
    while not now.where("moved").isEmpty():
        labels = now.select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        new = low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("upper", "label")).alias("label"), "old")
        now = saved(new.select("node", "label", (F.col("label") < F.col("old")).alias("moved")), "cc-labels")
    return now.select("node", "label")


def _parts(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows (key, i, j, own and others) by pair of blocks, sorted so within tasks."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], pa.Table, int, int, int]]:
    """Groups of dealt members: columns, table, and the bounds of the first and the second block (the same one, if a block meets itself)."""
    for table, cuts in complete_groups(batches, ["key", "i", "j"]):
        cols = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("sketch", "shingles")}
        cols["sketch"] = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).view(np.uint64)
        for s, e in cuts:
            yield cols, table, s, s + int(np.searchsorted(cols["own"][s:e], cols["j"][s])) if cols["i"][s] != cols["j"][s] else e, e


def _bits(cols: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Differing bits of odd sketches; where sizes rule a pair out, or it is one row, more than any can be."""
    bits = np.bitwise_count(cols["sketch"][first][:, None] ^ cols["sketch"][second][None]).sum(axis=2, dtype=np.int32)
    n, m = cols["n"][first][:, None], cols["n"][second]
    return np.where((np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT) & (cols["node"][first][:, None] != cols["node"][second]), bits, SKETCH_BITS + 1)


def _nearest(members: DataFrame, most_bits: int) -> DataFrame:
    """For each node (key, n_bucket, node, n, sketch) the one with the closest odd sketch in its parts of buckets, if that is close enough: a, b."""
    part = F.pmod(F.xxhash64("node"), _parts("n_bucket")).cast("int")
    leads = (F.col("n_bucket") > BLOCK) & (F.pmod(F.xxhash64("node", "key"), F.col("n_bucket")) < LEADERS)
    own = F.explode(F.when(leads, F.sequence(F.lit(0), _parts("n_bucket") - 1)).otherwise(F.array(part)))
    dealt = members.select("key", own.alias("own"), "node", "n", "sketch").select("key", F.col("own").alias("i"), F.col("own").alias("j"), "own", "node", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _, s, _, e in _groups(batches):
            second = np.arange(s, e)
            for r in range(s, e, 64):
                some = np.arange(r, min(r + 64, e))
                bits = _bits(cols, some, second)
                best, least = second[bits.argmin(axis=1)], bits.min(axis=1)
                good = least <= most_bits
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array(cols["node"][some[good]]), pa.array(cols["node"][best[good]]), pa.array(least[good], pa.int32())], ["a", "b", "bits"])

    found = map_arrow(_gathered(dealt), run, "a bigint, b bigint, bits int")
    return found.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("best")).select("a", "best.b")


def _apart(members: DataFrame) -> DataFrame:
    """Members (key, n_bucket, node, label) of buckets with several components, dealt to pairs of blocks: key, i, j, own, node, label.

    In a large bucket the blocks of the largest component, numbered after those of
    the others, meet the others' blocks only.
    """
    labels = members.groupBy("key", "label").agg(F.count("*").alias("n_label"))
    mixed = labels.groupBy("key").agg(F.max_by("label", F.struct("n_label", "label")).alias("main"), F.max("n_label").alias("n_main"), F.sum("n_label").alias("n_all")).where("n_main < n_all")
    rows = members.join(saved(mixed, "mixed-buckets"), "key").withColumn("is_main", F.col("label") == F.col("main")).withColumn("n_rest", F.col("n_all") - F.col("n_main"))
    rest, main, h = _parts("n_rest"), _parts("n_main"), F.xxhash64("node")
    large = F.col("n_all") > BLOCK
    own = F.when(~large, F.lit(0)).when(F.col("is_main"), rest + F.pmod(h, main)).otherwise(F.pmod(h, rest)).cast("int")
    others = F.when(~large, F.array(F.lit(0))).when(F.col("is_main"), F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(F.lit(0), rest + main - 1))
    rows = rows.select("key", own.alias("own"), F.explode(others).alias("other"), "node", "label")
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")


def _with_candidates(dealt: DataFrame, most_bits: int) -> DataFrame:
    """Those rows of dealt (as from ``_apart``, with n and sketch) that have a candidate of another label in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, table, s, split, e in _groups(batches):
            first, second, label = np.arange(s, split), np.arange(s if split == e else split, e), cols["label"]
            hit = np.zeros(e - s, bool)
            for r in range(0, len(first), 64):
                some = first[r : r + 64]
                near = (_bits(cols, some, second) <= most_bits) & (label[some][:, None] != label[second])
                hit[some[near.any(axis=1)] - s] = True
                hit[second[near.any(axis=0)] - s] = True
            if hit.any():
                yield from table.select(["key", "i", "j", "own", "node", "label"]).take(pa.array(np.flatnonzero(hit) + s)).combine_chunks().to_batches()

    return map_arrow(_gathered(dealt), run, "key bigint, i int, j int, own int, node bigint, label bigint")


def _across(candidates: DataFrame, most_bits: int) -> DataFrame:
    """Links between components: (a, b), labels that are linked by a pair of members.

    candidates: key, i, j, own, node, label, n, sketch, shingles.  Pairs of different
    labels come by their odd sketches, the closest first, and are tested on the
    full sets unless they have been joined before; so what leaves a group is no
    more than joins its components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, table, s, split, e in _groups(batches):
            first, second, label = np.arange(s, split), np.arange(s if split == e else split, e), cols["label"]
            found = []
            for r in range(0, len(first), 64):
                some = first[r : r + 64]
                bits = _bits(cols, some, second)
                x, y = np.nonzero((bits <= most_bits) & (label[some][:, None] != label[second]))
                found.append(np.stack([bits[x, y], some[x], second[y]]))
            pairs = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
            if not pairs.shape[1]:
                continue
            parent: dict[int, int] = {}

            def root(v: int) -> int:
                while v in parent:
                    v = parent[v]
                return v

            sets = table.column("shingles")
            out = []
            for _, a, b in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
                p, q = root(int(label[a])), root(int(label[b]))
                if p == q:
                    continue
                x, y = (sets[v].values.to_numpy() for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * 100 >= (len(x) + len(y) - both) * PERCENT:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(label[a]), int(label[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_arrow(_gathered(candidates), run, "a bigint, b bigint").distinct()


def link(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that the document's links reach, its own
    included; kept tells that it is its own.  Documents without words (null,
    empty or blank texts) and rows with a null doc_id are linked with nothing:
    such a row's component is its own id and it is kept.  Rows that share a
    doc_id are separate documents; equal rows stay in one component.
    """
    signed = saved(signatures(df, doc_id, text), "signatures")
    live = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = live.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    classes = saved(classes.withColumnRenamed("n_shingles", "n"), "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n_bucket")).where("n_bucket > 1")
    buckets = saved(buckets, "buckets")
    members = saved(banded.join(buckets, "key"), "members")
    sketches = classes.select("node", "n", "sketch")
    candidates = classes.select("node", "digest").join(members.select("node").distinct(), "node", "left_semi")
    sets = saved(full_sets(df, candidates, doc_id, text), "shingle-sets")
    nearest = saved(_nearest(members.join(sketches, "node"), most_bits), "nearest")
    labels = components(saved(confirmed(nearest, sets), "links"))
    # What is still apart in a bucket, compared across components.
    labelled = saved(members.join(labels, "node", "left").select("key", "n_bucket", "node", F.coalesce("label", "node").alias("label")), "labelled-members")
    candidates = saved(_with_candidates(_apart(labelled).join(sketches, "node"), most_bits), "candidates-across")
    merged = components(_across(candidates.join(sketches, "node").join(sets.select("node", "shingles"), "node"), most_bits))
    upper = merged.select(F.col("node").alias("label"), F.col("label").alias("upper"))
    named = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    named = named.join(upper, "label", "left").select("digest", F.coalesce("upper", "label").alias("component_id"))
    named = saved(named, "components")
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of df but for those that are not kept.  Rows that share a doc_id stay together, if any of them is kept."""
    name = fresh(df.columns, "dropped_id")
    dropped = link(df, doc_id, text).groupBy(F.col("doc_id").alias(name)).agg(F.bool_or("kept").alias("kept")).where("NOT kept").select(name)
    return df.join(saved(dropped, "dropped"), F.col(f"`{doc_id}`") == F.col(name), "left_anti")
