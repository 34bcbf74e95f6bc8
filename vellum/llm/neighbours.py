"""Operator 5: approximate nearest neighbours by NN-descent and greedy graph search.

Every distinct vector is a node.  NN-descent starts from rough lists (exact
neighbours within cells of random hyperplanes, a few times over) and improves
them by iterated Spark joins: a node's neighbours, in both directions, are
brought together, those that are new are compared with the others, and a pair
closer than what one of the two has so far enters its list.  It ends when few
entries change.  A query then searches the graph greedily: it keeps a beam of
the nearest nodes found and expands the nearest of those not yet expanded, until the beam
stays as it is.  The answers' cosines are computed on the original vectors in
double precision.

All lists are rows.  A task holds one node's neighbourhood at a time (at most
``DEGREE + REVERSE`` vectors in half precision) or one cell of at most about
``CELL`` vectors.  Equal vectors are one node, so a vector with any number of
copies is no hot spot; only the k + 1 smallest ids of a node can be answers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import complete_groups, map_arrow, saved

#: Neighbours that a node keeps, and nodes taken from those that have it in their lists.
DEGREE, REVERSE = 40, 24
TABLES, CELL = 6, 2048
#: NN-descent ends when under this share of all entries is new, or after so many rounds.
SETTLED, ROUNDS = 0.02, 8
#: Nodes in a query's beam, for up to ``BEAM_NODES`` nodes (it grows with the cube root of their number), and most hops.
BEAM, BEAM_NODES, HOPS = 64, 10_000, 24
#: Nodes that a query expands in a hop: the nearest ones, a third of its beam, but not fewer than these.
FRONT = 32
#: Nodes by hash that every query's beam starts with, beside the query's own neighbours.
ENTRIES = 32


def beam_for(count: int) -> int:
    """Nodes in a query's beam over a graph of count nodes: a fixed beam loses recall as the graph grows."""
    return max(BEAM, math.ceil(BEAM * math.cbrt(count / BEAM_NODES)))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, key (digest of the vector), vector as doubles, code (unit vector in half precision) of the rows that take part.

    Left out are null ids, null or zero vectors, vectors with null or
    non-finite components, and those of another length than most have.
    """
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad & F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = usual["n"] if usual else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim) + 0.0
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array([r.tobytes() for r in unit], pa.binary())], ["vec_id", "key", "vector", "code"])

    return map_arrow(rows.where(F.size("vector") == dim), run, "vec_id bigint, key binary, vector array<double>, code binary")


def distinct_nodes(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: node (its smallest id), key, vector, code, ids (its ``keep`` smallest ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch hands on few ids of a vector, however many copies it has
            found: dict[bytes, list[int]] = {}
            for i, key in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids = found.setdefault(key, [])
                if len(ids) < keep and i not in ids:
                    ids.append(i)
            first = {key: at for at, key in reversed(list(enumerate(batch.column(1).to_pylist())))}
            at = pa.array([first[key] for key in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), batch.column(2).take(at), batch.column(3).take(at), pa.array(list(found.values()), pa.list_(pa.int64()))], ["key", "vector", "code", "ids"])

    few = map_arrow(rows, run, "key binary, vector array<double>, code binary, ids array<bigint>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    few = few.groupBy("key").agg(ids.alias("ids"), F.first("vector").alias("vector"), F.first("code").alias("code"))
    return few.select(F.col("ids")[0].alias("node"), "key", "vector", "code", "ids")


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim.astype(np.float32))], ["u", "v", "sim"])


EDGES = "u bigint, v bigint, sim float"


def _top(edges: DataFrame, n: int = DEGREE) -> DataFrame:
    """The n nearest of each u; edges: u, v, sim, fresh (of equal ones, an old one counts)."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= n).drop("place")


def _start(nodes: DataFrame, count: int) -> DataFrame:
    """First lists: exact neighbours within cells of random hyperplanes, TABLES times; a crowded cell is split at random.

    A node with fewer than DEGREE neighbours in its cells gets others at random,
    so that it is reached by the rounds and every list is full (or holds all others).
    """
    bits = max(0, int(np.ceil(np.log2(max(1, 2 * count / CELL)))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _codes(batch.column(1))
            for t in range(TABLES):
                planes = np.random.default_rng(1000 + t).standard_normal((x.shape[1], bits)).astype(np.float32)
                cell = ((x @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) * TABLES + t
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", "node", "code"])

    rows = map_arrow(nodes.select("node", "code"), cells, "cell bigint, node bigint, code binary")
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    rows = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("parts")).cast("int")).drop("parts")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in complete_groups(batches, ["cell", "part"]):
            node, x = table.column("node").to_numpy(), _codes(table.column("code").combine_chunks())
            for s, e in cuts:
                if e - s > 1:
                    k = min(DEGREE, e - s - 1)
                    for r in range(s, e, 1024):
                        sims = x[r : min(r + 1024, e)] @ x[s:e].T
                        sims[np.arange(len(sims)), np.arange(r - s, r - s + len(sims))] = -2
                        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                        yield _edges(np.repeat(node[r : r + len(sims)], k), node[s:e][best].ravel(), np.take_along_axis(sims, best, 1).ravel())

    def met(rows: DataFrame) -> DataFrame:
        return map_arrow(rows.repartition("cell", "part").sortWithinPartitions("cell", "part"), nearest, EDGES).withColumn("fresh", F.lit(True))

    edges = saved(_top(met(rows)), "nn-start")
    full = edges.groupBy("u").count().where(F.col("count") >= min(DEGREE, count - 1)).select(F.col("u").alias("node"))
    lacking = saved(nodes.select("node").join(full, "node", "left_anti"), "nn-lacking")
    if count < 2 or lacking.isEmpty():
        return edges
    # Dealt by hash, about 4 * DEGREE nodes to a cell: one with too few for a list is out of the question.
    deal = F.pmod(F.xxhash64(F.lit("deal"), "node"), F.lit(max(1, count // (4 * DEGREE))))
    cells_of = lacking.select(deal.alias("cell")).distinct()
    dealt = nodes.select(deal.alias("cell"), "node", "code", F.lit(0).alias("part")).join(cells_of, "cell", "left_semi")
    more = met(dealt).join(lacking.select(F.col("node").alias("u")), "u", "left_semi")
    return saved(_top(edges.unionByName(more)), "nn-start")


def _both_ways(edges: DataFrame, limit: int = REVERSE) -> DataFrame:
    """(u, v, fresh) for the lists of each node and for at most limit nodes that list it, by a hash."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "v")))
    back = back.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    return edges.select("u", "v", "fresh").unionByName(back).groupBy("u", "v").agg(F.bool_or("fresh").alias("fresh"))


def _improve(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """One round: the neighbours of each node meet each other, and closer pairs enter the lists."""
    worst = edges.groupBy("u").agg(F.when(F.count("*") >= DEGREE, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    named = codes.join(worst, codes["node"] == worst["u"], "left").select(F.col("node").alias("v"), "code", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    met = _both_ways(edges).join(named, "v").select("u", "v", "fresh", "code", "worst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in complete_groups(batches, ["u"]):
            v, fresh, worst = (table.column(c).to_numpy() for c in ("v", "fresh", "worst"))
            x = _codes(table.column("code").combine_chunks())
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in cuts:
                if not fresh[s:e].any():
                    continue
                sims = x[s:e] @ x[s:e].T
                good = (sims > worst[s:e, None]) & (fresh[s:e, None] | fresh[s:e])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                out.append((v[s + i], v[s + j], sims[i, j]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))

    found = map_arrow(met.repartition("u").sortWithinPartitions("u"), run, EDGES)
    old = edges.withColumn("fresh", F.lit(False))
    return saved(_top(old.unionByName(found.distinct().withColumn("fresh", F.lit(True)))), "nn-round")


def graph(nodes: DataFrame) -> DataFrame:
    """The neighbour graph of nodes (node, code): u, v, sim, fresh."""
    count = nodes.count()
    codes = nodes.select("node", "code")
    edges = _start(nodes, count)
    for _ in range(ROUNDS):
        edges = _improve(edges, codes)
        new, every = edges.agg(F.count_if("fresh"), F.count("*")).first()
        if new <= SETTLED * every:
            break
    return edges


def _scored(pairs: DataFrame) -> DataFrame:
    """pairs (q, node, code_q, code) with sim instead of the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", _codes(batch.column(2)), _codes(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["q", "node", "sim"])

    return map_arrow(pairs.select("q", "node", "code_q", "code"), run, "q bigint, node bigint, sim float")


def search(edges: DataFrame, codes: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """For each node q of queries the beam of nearest nodes that greedy search finds: q, node, sim (q itself not among them)."""
    around = saved(_both_ways(edges, 2 * REVERSE).select(F.col("u").alias("node"), F.col("v").alias("next")), "nn-around")
    asked = queries.select(F.col("node").alias("q")).join(codes, F.col("q") == F.col("node")).select("q", F.col("code").alias("code_q"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))
    turn = F.row_number().over(Window.partitionBy("q").orderBy("expanded", F.desc("sim"), "node"))
    most = max(FRONT, math.ceil(beam / 3))

    def kept(pool: DataFrame) -> DataFrame:
        """The beam; those of it that are to be expanded next are marked: the nearest first, as far ones leave it before their turn."""
        pool = pool.withColumn("place", place).where(F.col("place") <= beam).drop("place")
        return saved(pool.withColumn("next", ~F.col("expanded") & (turn <= most)), "nn-beam")

    begin = edges.join(queries.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("u").alias("q"), F.col("v").alias("node"), "sim")
    entries = codes.orderBy(F.xxhash64(F.lit("entry"), "node"), "node").limit(ENTRIES)
    shared = _scored(asked.crossJoin(F.broadcast(entries)).where("q <> node").join(begin.select("q", "node"), ["q", "node"], "left_anti"))
    pool = kept(begin.unionByName(shared).withColumn("expanded", F.lit(False)))
    for _ in range(HOPS):
        front = pool.where("next").select("q", "node")
        if front.isEmpty():
            break
        reached = front.join(around, "node").select("q", F.col("next").alias("node"), F.lit(False).alias("known")).where("q <> node")
        reached = reached.unionByName(pool.select("q", "node", F.lit(True).alias("known")))
        reached = reached.groupBy("q", "node").agg(F.bool_or("known").alias("known")).where("NOT known").drop("known")
        scored = _scored(reached.join(codes, "node").join(asked, "q")).withColumn("expanded", F.lit(False))
        pool = kept(pool.select("q", "node", "sim", (F.col("expanded") | F.col("next")).alias("expanded")).unionByName(scored))
    return pool.select("q", "node", "sim")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, none of them zero.

    Where squares leave the range of doubles, both vectors are scaled by their largest component first.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scaled = lambda x: F.transform(x, lambda v: v / F.array_max(F.transform(x, lambda w: F.abs(w))))
    of = lambda x, y: dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    fits = lambda x: dot(x, x).between(1e-290, 1e290)
    return F.when(fits(a) & fits(b), of(a, b)).otherwise(of(scaled(a), scaled(b)))


def nearest(df: DataFrame, asked: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows found for each row where ``asked`` holds: query_id, rank (from 1), vec_id, score.

    Score is the cosine on the original vectors in double precision; ties go to
    the smaller id.  Rows that take no part (see ``usable``) neither ask nor
    answer.  Where fewer than k others take part, all of them are the answer.
    Rows with the same vec_id are one candidate for each of their vectors and
    never answer a query of that id.
    """
    rows = saved(usable(df, vec_id, vector), "nn-rows")
    nodes = saved(distinct_nodes(rows, k + 1), "nn-nodes")
    codes = nodes.select("node", "code")
    asking = rows.join(df.where(asked).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asking = saved(asking.select("vec_id", "key").distinct().join(nodes.select("key", "node"), "key").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "nn-queries")
    edges = graph(nodes)
    found = search(edges, codes, asking.select(F.col("q").alias("node")).distinct(), beam_for(nodes.count()))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))
    # A few more than k: half precision may order close ones otherwise.
    found = found.withColumn("place", place).where(F.col("place") <= 2 * k + 6).select("q", "node")
    found = found.unionByName(asking.select("q", F.col("q").alias("node")).distinct())
    vectors = nodes.select("node", "vector", "ids")
    scored = found.join(vectors, "node").join(vectors.select(F.col("node").alias("q"), F.col("vector").alias("vector_q")), "q")
    scored = saved(scored.select("q", "ids", cosine(F.col("vector_q"), F.col("vector")).alias("score")), "nn-answers")
    out = asking.join(scored, "q").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
