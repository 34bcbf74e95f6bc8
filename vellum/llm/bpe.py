"""Operator 1: BPE encoding and decoding with a contiguous rank array.

A word is held as a list of part ids, that is, its part boundaries, and beside
it lies one contiguous list with the rank of every adjacent pair.  The least
rank is found by scanning, the boundary between the two parts is deleted and
the two neighbouring ranks are refreshed, until no pair has a rank.  Words are
short, so scanning a dozen numbers beats any heap; a word of more than
``LONG_WORD`` parts, where scanning would be quadratic, goes through a heap of
the same ranks, with the same result.

Words beyond ASCII are normalised and cut into pieces by the tokenizers
library's own normaliser and splitter, so letters, digits and cases are those of
its Unicode tables, whatever Python's are; every piece is merged here.

The vocabulary file is a parameter.  It is read once on the driver (a few MB,
whatever the size of the corpus) and broadcast.  Texts stay where they are: the
operator is one pass of ``mapInArrow`` without a shuffle.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.common import map_arrow

#: Unicode White_Space: what the vocabulary's normaliser collapses.
SPACE = "\t-\r \x85\xa0  -     　"
LONG_WORD = 64
#: Words, and pieces of words, in each of the two generations that a task remembers: some 220 bytes each, 160 MB at most.
CACHE_WORDS, CACHE_PIECES = 220_000, 140_000
#: Rows leave a task in slices of about so many characters.
SLICE_CHARS = 4_000_000
NO_RANK = 1 << 60


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class RankArrayBPE:
    """Encoder and decoder for a vocabulary file with word ends (``</w>``), lower-casing and NFC."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.n
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.first = [vocab.get(c) for c in byte_chars()]
        self.last = [vocab.get(c + self.suffix) for c in byte_chars()]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for a, b in model["merges"]:
            self.ranks.setdefault(vocab[a] * self.n + vocab[b], len(self.merged))
            self.merged.append(vocab[a + b])
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")  # of lower-case ASCII
        self.blank = re.compile(f"[{SPACE}]+")
        self.odd_blank = re.compile("[\x1c-\x1f]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        lib = Tokenizer.from_str(spec)
        self.normalise, self.cut = lib.normalizer.normalize_str, lib.pre_tokenizer[0].pre_tokenize_str
        self.forget()

    def forget(self) -> None:
        """Drop the words remembered: a generation in use and the one before it."""
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.old_parts: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: the contiguous rank array."""
        raw = piece.encode()
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if None in ids:  # a byte outside the vocabulary: there is no unknown token
            ids = [i for i in ids if i is not None]
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        ranks, merged, n = self.ranks, self.merged, self.n
        near = [ranks.get(a * n + b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while near:
            rank = min(near)
            if rank == NO_RANK:
                break
            i = near.index(rank)
            ids[i] = new = merged[rank]
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = ranks.get(ids[i - 1] * n + new, NO_RANK)
            if i < len(near):
                near[i] = ranks.get(new * n + ids[i + 1], NO_RANK)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same for a long piece: least rank first, then leftmost, from a heap."""
        ranks, merged, n, end = self.ranks, self.merged, self.n, len(ids)
        after, before, alive = list(range(1, end + 1)), list(range(-1, end - 1)), [True] * end
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := ranks.get(a * n + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = merged[rank], False, after[j]
            if after[i] < end:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < end and (r := ranks.get(ids[x] * n + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(i for i, live in zip(ids, alive) if live)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a run of characters without white space that isn't in the generation in use."""
        ids = self.old_words.get(word)
        if ids is None:
            ids = ()
            for piece in self.pieces.findall(word.lower()) if word.isascii() else [p for p, _ in self.cut(self.normalise(word))]:
                found = self.parts.get(piece) or self.old_parts.get(piece) or self.merge(piece)
                if len(piece) <= LONG_WORD:
                    self.parts[piece] = found
                ids += found
            if len(self.parts) >= CACHE_PIECES:
                self.parts, self.old_parts = {}, self.parts
        if len(word) <= LONG_WORD:
            if len(self.words) >= CACHE_WORDS:
                self.words, self.old_words = {}, self.words
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.specials.split(text) if self.specials and "<|" in text else (text,):
            if self.special and part in self.special:
                ids.append(self.special[part])
                continue
            for w in part.split() if part.isascii() and not self.odd_blank.search(part) else self.blank.split(part):
                if w:
                    found = self.words.get(w)
                    ids += self.word(w) if found is None else found
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: the vocabulary names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


#: One encoder for each vocabulary in a Python worker: its tables outlive a task, its words don't.
_ENCODERS: dict[int, RankArrayBPE] = {}


def _encoder(spec: str) -> RankArrayBPE:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = RankArrayBPE(spec)
    return _ENCODERS[key]


def _forget() -> None:
    for coder in _ENCODERS.values():
        coder.forget()


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about SLICE_CHARS bytes of the column, a row at least."""
    start, chars = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if i > start and chars + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += n
    if start < batch.num_rows:
        yield batch.slice(start)


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with two more columns: the ids of the whole text, and the text decoded from them.

    Null and empty texts give no ids and an empty text.  A column of df that is
    named as a result is replaced.  Rows, repeated ones included, keep their
    other columns.  Merges and vocabulary are those of the file at
    tokenizer_path; its special tokens count wherever they stand in a text.
    """
    kept = [c for c in df.columns if c.lower() not in {ids.lower(), decoded.lower()}]
    if text.lower() not in {c.lower() for c in kept}:
        raise ValueError("the text column cannot be replaced by a result")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    at = [c.lower() for c in kept].index(text.lower())
    source = df.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        for batch in batches:
            for rows in _slices(batch, at):
                flat, offsets, texts = array("i"), array("i", [0]), []
                for t in rows.column(at).to_pylist():
                    found = bpe.encode(t) if t else []
                    flat.extend(found)
                    offsets.append(len(flat))
                    texts.append(bpe.decode(found))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(texts, pa.string())], [*rows.schema.names, ids, decoded])

    return map_arrow(source, run, schema, _forget)
