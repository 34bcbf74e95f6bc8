"""Operator 9: language identification by error-correcting output codes.

Every language has a codeword of ``BITS`` bits; one binary classifier over
hashed character n-grams predicts each bit.  Decoding is loss-weighted: a
classifier's margin gives a loss for either value of its bit, the losses along
each codeword are added up, weighed by how good each classifier was on the
fitting rows, and the codeword with the least sum names the language.  As
codewords differ in many bits, a few wrong ones do no harm.  A text whose two
best codewords are close is flagged as ambiguous.

Fitting sees a bounded sample of labelled rows (``TRAIN_ROWS`` of each language,
``MOST_ROWS`` of all, parameters).  Their n-gram counts are made by the executors, from whole texts,
as everywhere; only those counts come to the driver.  Predicting is one pass of
``mapInArrow`` without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import fresh, map_arrow

#: Rows of each language, and of all of them, that are used for fitting.
TRAIN_ROWS, MOST_ROWS = 600, 24_000
#: Hashed counts of character n-grams, in bytes of the lower-cased text.
FEATURES, ORDERS = 1 << 12, (1, 2, 3)
BITS, STEPS = 31, 150
#: Difference of the two best languages' probabilities under which a text is flagged.
AMBIGUOUS = 0.2
UNKNOWN = "und"
CHUNK = 1 << 22

_letters = r"\p{L}"


def counts(texts: list[str]) -> np.ndarray:
    """Square roots of n-gram shares, a row for each text, of length 1."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer((" " + t.lower() + " ").encode(), np.uint8)
        for k in range(0, len(raw), CHUNK):  # long texts in pieces that overlap by an n-gram
            part = raw[k : k + CHUNK + max(ORDERS) - 1].astype(np.uint32)
            h = np.zeros(len(part), np.uint32)
            for n in range(1, max(ORDERS) + 1):
                if len(part) < n:
                    break
                h = (h[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] + np.uint32(n * 257))
                h *= np.uint32(0x9E3779B1)
                out[i] += np.bincount(h[:CHUNK] >> np.uint32(20), minlength=FEATURES)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Coder:
    """Codewords of languages and the classifiers of their bits."""

    def __init__(self, languages: list[str], words: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.words, self.weights, self.bias, self.trust = languages, words, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of features: number of the language, its probability, and that of the next one."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.words) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = np.argmax(p, axis=1)
        top = np.sort(p, axis=1)[:, ::-1]
        return best, top[:, 0], top[:, 1] if p.shape[1] > 1 else np.zeros(len(x))


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of BITS values -1 or 1: of many random draws, the one whose closest rows lie farthest apart."""
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        rows = rng.choice([-1.0, 1.0], (n, BITS))
        if n > 1:
            rows[:, np.abs(rows.sum(axis=0)) == n] *= np.where(np.arange(n) == 0, -1.0, 1.0)[:, None]  # a bit must tell some apart
        gaps = (BITS - rows @ rows.T) / 2 + BITS * np.eye(n)
        if gaps.min() > far:
            best, far = rows, gaps.min()
    return best


def train(x: np.ndarray, y: list[str]) -> Coder:
    """Logistic regression for each bit by full gradient steps, each language weighing as much."""
    languages = sorted(set(y))
    if not languages:
        return Coder([], np.zeros((0, BITS)), np.zeros((x.shape[1], BITS)), np.zeros(BITS), np.ones(BITS))
    words = codewords(len(languages))
    number = np.array([languages.index(v) for v in y])
    target = (words[number] + 1) / 2
    weight = 1 / np.bincount(number)[number] / len(languages)
    w, b = np.zeros((x.shape[1], BITS), np.float32), np.zeros(BITS, np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, STEPS + 1):
        error = ((1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target) * weight[:, None]).astype(np.float32)
        for p, g, mean, square in ((w, x.T @ error + 1e-6 * w, m, v), (b, error.sum(axis=0), mb, vb)):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p -= 0.1 * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    right = ((x @ w + b > 0) == (target > 0.5)).T @ weight
    trust = np.maximum(right - 0.5, 0.01)
    return Coder(languages, words, w, b, trust * BITS / trust.sum() / 3)


def fit(df: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS, most: int = MOST_ROWS) -> Coder:
    """Train on at most ``rows`` rows of each language, those with the least hash of id and text; null languages and letterless texts are left out.

    Rows that are alike in id and text count once.  Languages share ``most`` rows
    in all; with more languages than that the most frequent ones are learnt.
    """
    body, name = F.col(f"`{text}`"), F.col(f"`{lang}`").cast("string").alias("lang")
    usable = df.where(F.col(f"`{lang}`").isNotNull() & body.rlike(_letters)).select(name, F.xxhash64(f"`{doc_id}`", body).alias("h"), body.alias("text"))
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    n = sizes.count()
    if not n:
        return train(np.zeros((0, FEATURES), np.float32), [])
    each = max(1, min(rows, most // n))
    # The hashes are chosen first, by partial limits; texts are then read for them alone: ``most`` rows at the most.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = usable.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= each).select("lang", "h")
    sample = usable.join(F.broadcast(chosen.join(F.broadcast(sizes.select("lang")), "lang", "left_semi")), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = counts(part.column(2).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "h", "x"])

    kept = sorted(map_arrow(sample, run, "lang string, h bigint, x binary").collect(), key=lambda r: (r[0], r[1]))
    return train(np.stack([np.frombuffer(r[2], np.float16) for r in kept]).astype(np.float32), [r[0] for r in kept])


def identify(df: DataFrame, coder: Coder, text: str = "text") -> DataFrame:
    """df with lang_pred, score (probability of that language, 0 to 1) and ambiguous.

    A null text, or one without a letter, is "und" with score 0; so is every
    text if the coder has learnt no language.  Columns named as a result are
    replaced.  Whole texts are read, in pieces if they are long.
    """
    results = ("lang_pred", "score", "ambiguous")
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in results])
    flag = fresh(kept.columns, "has_letter")
    at = [c.lower() for c in kept.columns].index(text.lower())
    source = kept.withColumn(flag, F.coalesce(F.col(f"`{text}`").rlike(_letters), F.lit(False)))
    model = df.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                known = np.array(part.column(part.num_columns - 1).to_pylist(), bool) & bool(learnt.languages)
                names, score, second = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.zeros(len(known))
                if known.any():
                    best, score[known], second[known] = learnt.decode(counts([t or "" for t in part.column(at).filter(pa.array(known)).to_pylist()]))
                    names[known] = np.array(learnt.languages, object)[best]
                found = [pa.array(names, pa.string()), pa.array(score), pa.array(known & (score - second < AMBIGUOUS))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], [*part.schema.names[:-1], *results])

    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("ambiguous", T.BooleanType(), False)]
    return map_arrow(source, run, T.StructType([*kept.schema.fields, *fields]))
