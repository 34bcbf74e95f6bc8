import numpy as np
from pyspark.sql import functions as F

from vellum.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, code string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA)


def brute(rows, asked, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v) for i, v in good if len(v) == 8]
    out = {}
    for q, x in good:
        if asked(q):
            s = sorted((-round(float(x @ v / (np.sqrt(x @ x) * np.sqrt(v @ v))), 9), i) for i, v in good if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400 + i, x[3].tolist()) for i in range(30)]  # copies
    rows += [(500, None), (550, [0.0] * 8), (600, [float("nan")] + [1.0] * 7), (650, [None] + [1.0] * 7), (None, [1.0] * 8), (700, [1.0, 2.0]), (750, [float("inf")] + [1.0] * 7)]
    out = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    assert got[400] == want[400]  # a copy's answers are the smallest ids of the others


def test_small_tables(spark):
    ask = F.col("vec_id") % 50 == 0
    assert neighbours.nearest(frame(spark, []), ask).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1.0] * 8)]), ask).count() == 0
    out = neighbours.nearest(frame(spark, [(0, [1.0] * 8), (1, [2.0] * 8), (2, [-1.0] * 8)]), ask).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]


def share(out, want):
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(got.get(q, set()) & set(want[q])) for q in want) / sum(map(len, want.values()))


def exact(x, asked, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit[asked] @ unit.T
    sims[np.arange(len(asked)), asked] = -2
    return {q: row.tolist() for q, row in zip(asked, np.argsort(-sims, axis=1)[:, :k])}


def test_beam_grows_with_the_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BEAM", 6)
    monkeypatch.setattr(neighbours, "BEAM_NODES", 20, raising=False)
    monkeypatch.setattr(neighbours, "CELL", 64)
    monkeypatch.setattr(neighbours.search, "__defaults__", (6,))
    x = np.random.default_rng(4).standard_normal((3000, 48)).astype(np.float32)
    want = exact(x, list(range(0, 3000, 50)))
    out = neighbours.nearest(frame(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 50 == 0).collect()
    assert share(out, want) > 0.9


def test_outliers_get_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 4)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16)) * 10
    x = np.concatenate([rng.standard_normal((30, 16)) * 10, np.repeat(centres, 40, axis=0) + rng.standard_normal((800, 16)) * 0.01]).astype(np.float32)
    out = neighbours.nearest(frame(spark, list(enumerate(x.tolist()))), F.col("vec_id") < 30).collect()
    assert len(out) == 30 * 5
    assert share(out, exact(x, list(range(30)))) > 0.9


def test_reached_nodes_meet_the_pool_without_an_anti_join(spark, monkeypatch):
    plans, scored = [], neighbours._scored

    def seen(pairs):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return scored(pairs)

    monkeypatch.setattr(neighbours, "_scored", seen)
    x = np.random.default_rng(6).standard_normal((300, 8)).astype(np.float32)
    out = neighbours.nearest(frame(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 50 == 0).collect()
    assert share(out, exact(x, list(range(0, 300, 50)))) > 0.9
    assert len(plans) > 1 and not any("LeftAnti" in p for p in plans[1:])  # the first is of the nodes that all begin with


def test_a_hop_expands_the_nearest_only(spark, monkeypatch):
    """Rows that meet their neighbours: before, every node of the beam at once, most of which leave it soon."""
    monkeypatch.setattr(neighbours, "CELL", 64)
    monkeypatch.setattr(neighbours, "FRONT", 8, raising=False)
    sizes, scored = [], neighbours._scored
    monkeypatch.setattr(neighbours, "_scored", lambda pairs: sizes.append(pairs.count()) or scored(pairs))
    x = np.random.default_rng(7).standard_normal((3000, 48)).astype(np.float32)
    out = neighbours.nearest(frame(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 50 == 0).collect()
    assert share(out, exact(x, list(range(0, 3000, 50)))) > 0.95
    assert sum(sizes[1:]) < 60 * 2100  # rows scored for 60 queries


def test_beam_grows_slower_than_the_root(spark):
    assert neighbours.beam_for(100) == neighbours.beam_for(neighbours.BEAM_NODES) == neighbours.BEAM
    assert neighbours.beam_for(8 * neighbours.BEAM_NODES) == 2 * neighbours.BEAM
