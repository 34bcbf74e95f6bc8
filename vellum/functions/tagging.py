"""A tagger over batches of texts: tokens, windows and spans as flat arrays, in one pass.

What ``vellum.operators.recogniser`` does in columns, for its own tokenizer and
a tagger that takes and gives Arrow arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vellum.functions import detection
from vellum.functions import patterns as P
from vellum.functions.detection import Characters, Definition

Tag = Callable[[pa.ListArray], pa.ListArray]

_SPACE, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER[[c for c in range(128) if chr(c).isalnum()]] = True
_SPURIOUS = frozenset(P.RECOGNISER_SPURIOUS)


class Tokens(NamedTuple):
    """Tokens of a slice in order: their texts' rows, places by characters, and words."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: pa.Array


class Spans(NamedTuple):
    """Spans of a slice by row, window and place; kind is a place in ``kinds``."""

    row: np.ndarray
    window: np.ndarray
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    kind: np.ndarray
    kinds: list[str]


def tokens(chars: Characters) -> Tokens:
    """Runs of letters and digits of ASCII, and single other characters but white space."""
    b = chars.data
    letter = _LETTER[b]
    edge = np.zeros(len(b) + 1, bool)  # where a text begins
    edge[chars.offsets] = True
    before = np.zeros(len(b), bool)
    before[1:] = letter[:-1]
    before &= ~edge[:-1]
    space = _SPACE[b]
    inner = letter & before if chars.ascii else (letter & before) | ((b & 0xC0) == 0x80)
    at = np.flatnonzero(~space & ~inner)
    row = np.searchsorted(chars.offsets, at, side="right") - 1
    sizes = np.add.reduceat((~space).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)  # bytes of each token: those up to the next, without white space
    if chars.ascii:
        start, length = at - chars.offsets[row], sizes
    else:
        place = np.cumsum((b & 0xC0) != 0x80) - 1
        start, length = place[at] - chars.first[row], np.where(letter[at], sizes, 1)
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b[~space]))])
    return Tokens(row, start, start + length, words)


def rounded(x: np.ndarray) -> np.ndarray:
    """Four decimals, halves up by the shortest decimal form, as Spark rounds."""
    y = x * 1e4
    out = np.floor(y + 0.5) / 1e4
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


def tagged(chars: Characters, tag: Tag, window: int, stride: int, least: float) -> Spans:
    """What a tagger finds in the windows of texts: runs of touching tokens of one kind, with the least of their scores."""
    t = tokens(chars)
    step = window - stride
    counts = np.bincount(t.row, minlength=len(chars.offsets) - 1)
    n_windows = np.where(counts > 0, np.maximum(0, -(-(counts - window) // step)) + 1, 0)
    w_row = np.repeat(np.arange(len(counts)), n_windows)
    w = np.arange(len(w_row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    sizes = np.minimum(window, counts[w_row] - w * step)
    base = (np.cumsum(counts) - counts)[w_row] + w * step
    offsets = np.zeros(len(w_row) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(base - offsets[:-1], sizes)
    words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), t.words.take(pa.array(index)).cast(pa.string()))
    tags = tag(words)
    if not np.array_equal(pc.fill_null(pc.list_value_length(tags), -1).to_numpy(), sizes):
        raise ValueError("a tagger gives a tag for each word")
    flat = tags.flatten()
    label, score = flat.field("label"), pc.fill_null(flat.field("score"), -1.0).to_numpy()
    label = label if pa.types.is_dictionary(label.type) else label.dictionary_encode()
    kinds: list[str] = []
    kind_of = []
    for x in label.dictionary.to_pylist():
        bare = None if x is None or x == "O" else x[x.find("-") + 1 :]
        kind = P.RECOGNISER_LABELS.get(bare, bare)
        if kind is None or kind == "DATE":
            kind_of.append(-1)
            continue
        if kind not in kinds:
            kinds.append(kind)
        kind_of.append(kinds.index(kind))
    kind = np.array([*kind_of, -1], np.int64)[pc.fill_null(label.indices, len(kind_of)).to_numpy()]
    kind[score < least] = -1

    at = np.flatnonzero(kind >= 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Spans(none, none, none, none, np.zeros(0), none, kinds)
    of = np.repeat(np.arange(len(w_row)), sizes)[at]
    kind, score, start, end = kind[at], score[at], t.start[index[at]], t.end[index[at]]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (start[1:] > end[:-1])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(at)) - 1
    start, end, score, kind, of = start[heads], end[tails], np.minimum.reduceat(score, heads), kind[heads], of[heads]
    long = end - start >= 2
    start, end, score, kind, of = (x[long] for x in (start, end, score, kind, of))
    text = chars.cut(w_row[of], start, end)
    spurious = pc.is_in(pc.ascii_lower(text), pa.array(P.RECOGNISER_SPURIOUS)).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(pc.binary_length(text).to_numpy() != end - start):
        spurious[i] = text[i].as_py().lower() in _SPURIOUS
    good = ~spurious
    return Spans(w_row[of][good], w[of][good], start[good], end[good], rounded(score[good]), kind[good], kinds)


def window_rows(batches: Iterator[pa.RecordBatch], tag: Tag, window: int, stride: int, least: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ids and texts as what a tagger finds in each window: id, window, kind, value, start, end, score."""
    for b in batches:
        ids, texts = b.column(0), pc.fill_null(b.column(1), "")
        for first, last in detection.slices(texts):
            chars = Characters(texts.slice(first, last - first))
            s = tagged(chars, tag, window, stride, least)
            if len(s.row):
                columns = [ids.take(pa.array(s.row + first)), s.window, detection.named(s.kinds, s.kind), chars.cut(s.row, s.start, s.end), s.start, s.end, s.score]
                yield _batch(columns, schema)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _shared(s: Spans, chars: Characters, groups: list[tuple[int, int]]) -> tuple[Spans, np.ndarray]:
    """Spans with those of rows of a group given to all its rows, each window's once; and the rows whose text they are from."""
    in_group = np.zeros(len(chars.offsets) - 1, bool)
    for a, b in groups:
        in_group[a:b] = True
    free = ~in_group[s.row]
    picked, target = [np.flatnonzero(free)], [s.row[free]]
    value = chars.cut(s.row, s.start, s.end)
    for a, b in groups:
        first, last = np.searchsorted(s.row, [a, b])
        windows: dict[tuple, list[int]] = {}
        own: dict[tuple[int, int], list[int]] = {}
        for i in range(first, last):
            own.setdefault((int(s.window[i]), int(s.row[i])), []).append(i)
        for (w, _), places in sorted(own.items()):
            windows.setdefault((w, *((value[i].as_py(), int(s.kind[i]), int(s.start[i]), int(s.end[i]), float(s.score[i])) for i in places)), places)
        every = np.array([i for places in windows.values() for i in places], np.int64)
        for row in range(a, b):
            picked.append(every)
            target.append(np.full(len(every), row))
    at, row = np.concatenate(picked), np.concatenate(target)
    return Spans(row, *(x[at] for x in s[1:6]), s.kinds), s.row[at]


def entity_rows(batches: Iterator[pa.RecordBatch], tag: Tag, definitions: tuple[Definition, ...], window: int, stride: int, least: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ids and texts as rows of disjoint, isolated spans of the definitions and of a tagger together.

    Rows of one id follow each other and share what the tagger finds; of an id
    that goes on in the next slice, its rows are held.
    """
    d = detection.detector(definitions, False)

    def rows_of(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
        chars = Characters(texts)
        s = tagged(chars, tag, window, stride, least)
        source = s.row
        edges = np.flatnonzero(~detection.same_as_before(ids)) + 1
        bounds = [0, *edges.tolist(), len(ids)]
        groups = [(a, b) for a, b in zip(bounds, bounds[1:]) if b - a > 1] if len(edges) + 1 < len(ids) else []
        if groups:
            s, source = _shared(s, chars, groups)
        row, which, start, end, _ = d.spans(texts.to_pylist())
        n = len(row)
        row, start, end = np.append(row, s.row), np.append(start, s.start), np.append(end, s.end)
        source = np.append(row[:n], source)
        kind = np.append(which, s.kind + len(d.kinds)).astype(np.int64)
        kept, score, two = detection.fuse(row, start, end, np.append(np.array(d.scores)[which] if n else np.zeros(0), s.score))
        free = detection.isolated(chars, row[kept], start[kept], end[kept])
        kept, score, two = kept[free], score[free], two[free]
        if not len(kept):
            return None
        origin = np.where(two, 2, np.where(kept < n, 0, 1))
        value = chars.cut(source[kept], start[kept], end[kept])
        return _batch([ids.take(pa.array(row[kept])), value, detection.named([*d.kinds, *s.kinds], kind[kept]), start[kept], end[kept], score, detection.named(["regex", "ner", "hybrid"], origin)], schema)

    held: list[tuple[pa.Array, pa.Array]] = []
    for b in batches:
        ids, texts = b.column(0), pc.fill_null(b.column(1), "")
        for first, last in detection.slices(texts):
            part, body = ids.slice(first, last - first), texts.slice(first, last - first)
            new = np.flatnonzero(~detection.same_as_before(part)) + 1
            if held and not detection.same_as_before(pa.concat_arrays([held[-1][0].slice(len(held[-1][0]) - 1), part.slice(0, 1)]))[0]:
                new = np.append(0, new)
            if not len(new):  # all of it goes on with the id that is held
                held.append((part, body))
                continue
            cut = int(new[-1])
            whole = [*held, (part.slice(0, cut), body.slice(0, cut))]
            made = rows_of(pa.concat_arrays([x for x, _ in whole]), pa.concat_arrays([x for _, x in whole]))
            if made is not None:
                yield made
            held = [(part.slice(cut), body.slice(cut))]
    if held:
        made = rows_of(pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([x for _, x in held]))
        if made is not None:
            yield made
