"""Operator 7: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is given to the network twice: as itself, by a hashed word embedding, and
by its characters, by the mean of hashed embeddings of its 3- to 5-grams, so
that an unseen form of a known stem is recognised.  A gated recurrent network
runs over each window of words in both directions, attention pools its states
and a linear layer gives the window's logit.  Windows overlap and together they
cover the whole text, however long; a document's score comes from its highest
window, calibrated on labelled documents that the network hasn't been fitted to.

Training sees a bounded sample of labelled rows (``TRAIN_ROWS`` of either
class, of ``TRAIN_CHARS`` characters in all, parameters of ``fit``), taken by a hash of the id.  Labels belong to documents,
not windows: after a first pass in which each window has its document's label,
toxic documents are trained on their highest windows and others on theirs.  The
sample meets in one task of an executor, which hands the driver the network alone.

Scoring is one pass of ``mapInArrow`` without a shuffle.  In a task, each
distinct word's input is projected once and remembered; windows go through the
recurrence thousands at a time.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import fresh, map_arrow

WINDOW, STRIDE = 32, 24
#: Labelled rows of either class (0, 1) that are used for fitting, and the share of them for calibration.
TRAIN_ROWS, CALIBRATION = (3000, 1500), 0.25
WORD_ROWS, WORD_DIM, GRAM_ROWS, GRAM_DIM = 1 << 14, 4, 1 << 15, 8
HIDDEN, ATTENTION = 8, 8
DIM = WORD_DIM + GRAM_DIM
#: Of these, texts longer than this many characters are no training rows, and all together have at most so many.
TRAIN_TEXT_CHARS, TRAIN_CHARS = 200_000, 24_000_000
#: Distinct words that a task remembers (about 350 bytes each, so some 40 MB) before it starts afresh.
CACHE_WORDS = 110_000
WINDOWS_AT_ONCE = 4096
#: Texts are scored in slices of about so many bytes.
SLICE_BYTES = 500_000
#: In training, texts are cut into windows so many at a time, and words are looked at so many at a time.
TEXTS_AT_ONCE, WORDS_AT_ONCE = 64, 20_000
STEPS, ROUNDS, BATCH = 180, 3, 192

_NOT_LETTERS = re.compile(r"[\W_]+")


def canonical(word: str) -> str:
    """A word without its marks, in lower case."""
    return _NOT_LETTERS.sub("", word).lower()


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of canonical words: embedding row of each, rows of all their character n-grams, and offsets of the latter."""
    rows = np.array([zlib.crc32(w.encode()) % WORD_ROWS for w in words], np.int64)
    raw = "".join(f"\x02{w}\x03" for w in words).encode("utf-32-le")
    chars = np.frombuffer(raw, np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    counts = np.maximum(sizes[:, None] - np.arange(2, 5), 0)  # 3-, 4- and 5-grams within a word
    offsets = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    out = np.empty(offsets[-1], np.int32)
    base = offsets[:-1].copy()
    h = chars * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, 6):
        if len(chars) < n:
            break
        h = (h[:-1] ^ chars[n - 1 :]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        if n > 2:
            inside = owner[: len(h)] == owner[n - 1 :]
            own, k = owner[: len(h)][inside], counts[:, n - 3]
            first = np.cumsum(k) - k
            out[base[own] + np.arange(len(own)) - first[own]] = (h[inside] >> np.uint64(20)) % np.uint64(GRAM_ROWS)
            base += k
    return rows, out, offsets


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 * _sigmoid(2 * x) - 1


class Network:
    """Bidirectional gated recurrent network with attention pooling; parameters are float32 arrays by name."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"words": normal(WORD_ROWS, WORD_DIM, scale=0.05), "grams": normal(GRAM_ROWS, GRAM_DIM, scale=0.3), "v": normal(ATTENTION, scale=0.3), "wa": normal(2 * HIDDEN, ATTENTION, scale=0.3), "ba": np.zeros(ATTENTION, np.float32), "w": normal(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": normal(DIM, 3 * HIDDEN, scale=0.4), f"h{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.a, self.c, self.name = 1.0, 0.0, uuid.uuid4().hex

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Input vectors of words."""
        rows, grams, offsets = features
        n = np.diff(offsets)
        order = np.argsort(-n, kind="stable")  # longest first: the words that have a j-th n-gram are a prefix
        starts, lengths = offsets[:-1][order], n[order]
        sums = np.zeros((len(rows), GRAM_DIM), np.float32)
        for j in range(int(lengths[0]) if len(lengths) else 0):
            some = int(np.searchsorted(-lengths, -j, side="left"))
            sums[:some] += self.p["grams"][grams[starts[:some] + j]]
        means = np.empty_like(sums)
        means[order] = sums / np.maximum(lengths, 1)[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][rows], means], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What words give to both directions' gates; row 0 is for the places after a text's end."""
        out = np.zeros((len(x) + 1, 6 * HIDDEN), np.float32)
        out[1:, : 3 * HIDDEN] = x @ self.p["xf"] + self.p["cf"]
        out[1:, 3 * HIDDEN :] = x @ self.p["xb"] + self.p["cb"]
        return out

    def _run(self, g: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN) of one direction; g: (steps, windows, 3 * HIDDEN)."""
        u, steps = self.p[f"h{d}"], len(g)
        h = np.zeros((g.shape[1], HIDDEN), np.float32)
        out = np.empty((steps, g.shape[1], HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(g[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = _tanh(g[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = h + (mask[t][:, None] * z) * (c - h)
            out[t] = h
        return out

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; g: (steps, windows, 6 * HIDDEN), mask: (steps, windows)."""
        traces = ([], []) if keep is not None else (None, None)
        half = 3 * HIDDEN
        h = np.concatenate([self._run(g[:, :, :half], mask, "f", traces[0]), self._run(g[:, :, half:], mask, "b", traces[1])], axis=2)
        a = _tanh(h @ self.p["wa"] + self.p["ba"])
        e = np.where(mask > 0, a @ self.p["v"], -30)
        alpha = np.exp(e - e.max(axis=0)) * mask
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", alpha, h)
        if keep is not None:
            keep |= {"traces": traces, "h": h, "a": a, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def logits(self, projected: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logits of windows given as rows of word numbers (0: past the end)."""
        out = np.empty(len(index), np.float32)
        for k in range(0, len(index), WINDOWS_AT_ONCE):
            at = index[k : k + WINDOWS_AT_ONCE].T
            out[k : k + WINDOWS_AT_ONCE] = self.forward(projected[at], (at > 0).astype(np.float32))
        return out

    def gradients(self, features: tuple, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss for windows of word numbers (from 1; 0 past the end) of features."""
        words, at = np.unique(index, return_inverse=True)
        at = at.reshape(index.shape).T
        own = _subset(features, words[words > 0] - 1)
        inputs = np.concatenate([np.zeros((len(words) - len(own[0]), DIM), np.float32), self.inputs(own)])
        mask = (index.T > 0).astype(np.float32)
        keep: dict = {}
        half = 3 * HIDDEN
        g = np.concatenate([inputs @ self.p["xf"] + self.p["cf"], inputs @ self.p["xb"] + self.p["cb"]], axis=1)[at]
        logit = self.forward(g, mask, keep)
        d = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        h, a, alpha = keep["h"], keep["a"], keep["alpha"]
        out = {"w": keep["pooled"].T @ d, "b": np.array([d.sum()])}
        dp = d[:, None] * self.p["w"]
        dh = alpha[:, :, None] * dp
        da = np.einsum("bh,tbh->tb", dp, h)
        de = alpha * (da - (alpha * da).sum(axis=0))
        out["v"] = np.einsum("tb,tba->a", de, a)
        dz = de[:, :, None] * self.p["v"] * (1 - a * a)
        out["wa"], out["ba"] = np.einsum("tbh,tba->ha", h, dz), dz.sum(axis=(0, 1))
        dh = dh + dz @ self.p["wa"].T
        dg = np.zeros_like(g)
        for k, direction in enumerate("fb"):
            u, du, carry = self.p[f"h{direction}"], np.zeros_like(self.p[f"h{direction}"]), np.zeros((len(y), HIDDEN), np.float32)
            for t, before, z, r, c, hc in reversed(keep["traces"][k]):
                now = dh[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
                m = mask[t][:, None]
                gc = now * m * z * (1 - c * c)
                gz = now * m * (c - before) * z * (1 - z)
                gr = gc * hc * r * (1 - r)
                step = np.concatenate([gz, gr, gc], axis=1)
                dg[t, :, k * half : (k + 1) * half] = step
                back = np.concatenate([gz, gr, gc * r], axis=1)
                du += before.T @ back
                carry = now * (1 - m * z) + back @ u.T
            out[f"h{direction}"], out[f"c{direction}"] = du, dg[:, :, k * half : (k + 1) * half].sum(axis=(0, 1))
        flat = np.zeros((len(words), 6 * HIDDEN), np.float32)
        np.add.at(flat, at.ravel(), dg.reshape(-1, 6 * HIDDEN))
        out["xf"], out["xb"] = inputs.T @ flat[:, :half], inputs.T @ flat[:, half:]
        dx = flat[:, :half] @ self.p["xf"].T + flat[:, half:] @ self.p["xb"].T
        rows, grams, offsets = own
        dx, n = dx[words > 0], np.diff(offsets)
        out["words"] = np.stack([np.bincount(rows, dx[:, j], WORD_ROWS) for j in range(WORD_DIM)], axis=1)
        each = np.repeat(dx[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0)
        out["grams"] = np.stack([np.bincount(grams, each[:, j], GRAM_ROWS) for j in range(GRAM_DIM)], axis=1)
        return out


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= (self.rate * self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts with so many words, end to end: (places of words from 1, 0 past a text's end), and windows before each text."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(first[-1]) - first[text]) * STRIDE
    inside = start[:, None] + np.arange(WINDOW)
    base = np.concatenate([[0], np.cumsum(counts)])
    return np.where(inside < counts[text][:, None], base[text][:, None] + inside + 1, 0), first


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct canonical words, the number (from 1) of each word of the texts, and words in each text."""
    known: dict[str, int] = {}
    raw: dict[str, int] = {}
    numbers, counts = array("i"), []
    for t in texts:
        found = t.split()
        for w in found:
            if w not in raw:
                raw[w] = known.setdefault(canonical(w), len(known) + 1)
        numbers.extend([raw[w] for w in found])
        counts.append(len(found))
    return list(known), np.array(numbers, np.int32), np.array(counts, np.int64)


def _indexed(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of word numbers (0 past a text's end), and windows before each text."""
    base = np.concatenate([[0], np.cumsum(counts)])
    index, first = [], [np.zeros(1, np.int64)]
    for k in range(0, len(counts), TEXTS_AT_ONCE):
        some = counts[k : k + TEXTS_AT_ONCE]
        places, before = windows(some)
        index.append(np.concatenate([np.zeros(1, np.int32), numbers[base[k] : base[k + len(some)]]])[places])
        first.append(before[1:] + first[-1][-1])
    return np.concatenate(index), np.concatenate(first)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_features`` of many words, some at a time."""
    parts = [word_features(words[k : k + WORDS_AT_ONCE]) for k in range(0, max(1, len(words)), WORDS_AT_ONCE)]
    ends = np.cumsum([0, *(p[2][-1] for p in parts)])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], *(p[2][1:] + e for p, e in zip(parts, ends))])


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Fit a network to labelled texts; with one class only, or none, its score is that class's share throughout."""
    net, y = Network(), np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.p["w"][:] = 0
        net.c = 4.0 if labels and labels[0] else -4.0
        return net
    rng = np.random.default_rng(seed)
    words, numbers, counts = _numbered(texts)
    index, first = _indexed(numbers, counts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    held = rng.random(len(texts)) < CALIBRATION
    for k in (0, 1):  # both classes on both sides, if there are two of them
        own = np.flatnonzero(y == k)
        if len(own) > 1:
            held[own[0]], held[own[1]] = False, True
    features = _features(words)
    adam = Adam(net.p, 0.01)

    def learn(chosen: np.ndarray, steps: int) -> None:
        target = y[text[chosen]]
        share = target.mean()
        weight = np.where(target == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        for _ in range(steps):
            b = rng.integers(0, len(chosen), BATCH)
            adam.step(net.gradients(features, index[chosen[b]], target[b], weight[b]))

    def tops() -> tuple[np.ndarray, np.ndarray]:
        logit = net.logits(net.project(net.inputs(features)), index)
        return logit, np.maximum.reduceat(logit, first[:-1])

    fitted = np.flatnonzero(~held[text] & (counts[text] > 0))
    if len(fitted):
        learn(fitted, STEPS)
        for _ in range(ROUNDS):
            logit, _ = tops()
            rank = np.lexsort((-logit, text))
            place = np.empty(len(text), np.int64)
            place[rank] = np.arange(len(text)) - np.repeat(first[:-1], np.diff(first))
            sure = (y[text] == 1) & ((place == 0) | (logit > 1.5))
            clean = (y[text] == 0) & ((place < 4) | (rng.random(len(text)) < 0.2))
            learn(fitted[(sure | clean)[fitted]], STEPS // ROUNDS)
    _, top = tops()
    side = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    net.a, net.c = _calibrate(top[side], y[side])
    return net


def _subset(features: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, grams, offsets = features
    n = offsets[of + 1] - offsets[of]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(offsets[of], n)
    return rows[of], grams[at], ends


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.2) and intercept of a logistic fit with smoothed targets; the rarer class weighs more, by the root of its rarity."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.where(y == 1, np.sqrt((1 - y).sum() / max(y.sum(), 1)), 1.0)
    w /= w.sum()
    a, c = 1.0, -float(np.median(logit))
    for _ in range(200):
        p = _sigmoid(a * logit + c)
        g, s = w * (p - t), w * p * (1 - p)
        hessian = np.array([[np.sum(s * logit**2) + 1e-3, np.sum(s * logit)], [np.sum(s * logit), np.sum(s) + 1e-3]])
        da, dc = np.linalg.solve(hessian, [np.sum(g * logit), np.sum(g)])
        a, c = max(0.2, a - np.clip(da, -0.5, 0.5)), c - np.clip(dc, -1, 1)
    return float(a), float(c)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS, most_chars: int = TRAIN_CHARS) -> Network:
    """Train on at most ``rows`` labelled documents of either class (0, 1), those whose id has the least hash.

    An id labelled more than once counts as toxic if it is so once; of several
    texts with one id the first in code point order counts.  Null texts and those
    of more than TRAIN_TEXT_CHARS characters are left out, and in the order of
    the hashes the sample ends where it would have more than most_chars.
    """
    key, mark = fresh(docs.columns, "label_id"), fresh(docs.columns, "label")
    named = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(f"`{doc_id}`").alias(key)).agg(F.max(label).alias(mark))
    # The sample is chosen among the labels; texts are then read for it alone.
    order = F.xxhash64(key).alias("h")
    chosen = [named.where(F.col(mark) == k).orderBy(order, key).limit(rows[k]) for k in (0, 1)]
    sample = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col(f"`{doc_id}`") == F.col(key))
    body = F.col(f"`{text}`")
    found = sample.where(F.length(body) <= TRAIN_TEXT_CHARS).groupBy(key).agg(F.min(body).alias("text"), F.max(mark).alias(mark))
    upto = F.sum(F.length("text")).over(Window.orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0))  # over the sample: sum(rows) rows at most
    found = found.select(key, "text", mark, upto.alias("upto")).where(F.col("upto") <= most_chars).select(key, "text", mark)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1] for r in rows], [int(r[2]) for r in rows]))], pa.binary())], ["model"])

    model = map_arrow(found.coalesce(1), learn, "model binary").collect()  # a bounded sample in one task; the driver gets 1.4 MB
    return pickle.loads(model[0][0]) if model else train([], [])


class Scorer:
    """Scores texts with a network, remembering the projected input of each distinct word."""

    def __init__(self, net: Network):
        self.net, self.known, self.size = net, {}, 1
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def learn(self, words: list[str]) -> None:
        end = self.size + len(words)
        if end > len(self.table):  # memory that isn't written to yet costs nothing
            table = np.zeros((max(end, CACHE_WORDS + 1), 6 * HIDDEN), np.float32)
            table[: self.size] = self.table[: self.size]
            self.table = table
        self.table[self.size : end] = self.net.project(self.net.inputs(word_features([canonical(w) for w in words])))[1:]
        self.known |= zip(words, range(self.size, end))
        self.size = end

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.known))
        if self.size + len(new) > CACHE_WORDS:  # start afresh, with all words of these texts, however many they are
            self.known, self.size, self.table = {}, 1, self.table[:1].copy()
            new = list(dict.fromkeys(w for words in split for w in words))
        if new:
            self.learn(new)
        known, numbers = self.known, [0]
        for words in split:
            numbers += [known[w] for w in words]
        counts = np.array([len(x) for x in split], np.int64)
        places, first = windows(counts)
        logit = self.net.logits(self.table, np.array(numbers, np.int64)[places])
        top = np.where(counts > 0, np.maximum.reduceat(logit, first[:-1]), logit[first[:-1]])
        found = _sigmoid(self.net.a * top.astype(np.float64) + self.net.c)
        return np.where(counts > 0, found, np.minimum(found, 0.05))


#: The scorer of the model that a Python worker is at work with.
_SCORERS: dict[str, Scorer] = {}


def _scorer(net: Network) -> Scorer:
    if net.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[net.name] = Scorer(net)
    return _SCORERS[net.name]


def score(df: DataFrame, net: Network, text: str = "text", result: str = "toxic_score") -> DataFrame:
    """df with the score of each whole text, 0 to 1.

    Null, empty and blank texts have no words and score 0.05 at most.  Equal
    texts have equal scores.  A column of df named as the result is replaced.
    """
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() != result.lower()])
    at = [c.lower() for c in kept.columns].index(text.lower())
    model = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.value)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            slices = np.flatnonzero(np.diff(np.cumsum(lengths) // SLICE_BYTES, prepend=0)).tolist()
            for a, b in zip([0, *slices], [*slices, batch.num_rows]):
                if a < b:
                    rows = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scorer.scores(rows.column(at).to_pylist()), pa.float64())], [*rows.schema.names, result])

    return map_arrow(kept, run, T.StructType([*kept.schema.fields, T.StructField(result, T.DoubleType(), False)]), _SCORERS.clear)
