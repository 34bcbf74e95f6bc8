"""Operator 10: token ids in wavelet-matrix files.

A shard is one self-contained binary: a header with the ids that occur in it
and, for each bit of an id's place among those, from the highest down, a bit-plane over all its tokens in the order that the
planes above have sorted them into (zeros before ones).  Every plane carries
the count of ones before each block of 512 bits, so that rank needs one
look-up and a few popcounts; select is a binary search over those counts.
On these rest ``access`` (the token at a position), ``rank`` (how often a token
occurs before a position) and ``select`` (where its k-th occurrence is), all
from the compressed planes.  ``tokens`` reads a whole shard back, plane by
plane from the lowest up.

Shards hold the documents in ascending doc_id order: rows are dealt by range of
id and of a hash of the text, and each task cuts its sorted run of documents into shards of about
``SHARD_TOKENS`` tokens, so a task's memory is bounded by a shard.  A shard's
documents, their ids and lengths, stand in its binary too (the end id may also
occur within a text, so it doesn't mark them).  Shards are rows of a Parquet
table (place and payload), so that Spark's own committer writes them: a lost
executor or a second attempt leaves no half-written file, and any file system
that Spark knows will do.

``read`` gives the documents back, ``count`` how often tokens occur, and
``locate`` where: the latter two by rank and select, without unpacking a shard.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import map_arrow, n_partitions

SHARD_TOKENS = 1 << 20
MAGIC, SHARD_MAGIC = b"VWM1", b"VWS1"
BLOCK = 512
#: Pieces remembered by a Python worker before it starts afresh.
CACHE_PIECES = 1_300_000
#: Pieces that it keeps between tasks: the first ones met, among which the frequent ones are.
KEEP_PIECES = 600_000
#: Texts whose unknown pieces are learnt together, and pieces in one call of the library.
LEARN_TEXTS, LEARN_PIECES = 64, 100
#: Rows are encoded in slices of so many.
SLICE_ROWS = 256

SHARD_SCHEMA = "part int, block int, before bigint, n_tokens bigint, payload binary"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of unsigned integers as succinct bit-planes with rank and select."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.ones = n, alphabet, zeros, planes, ones

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        n = len(values)
        present = np.bincount(values, minlength=1) > 0
        alphabet = np.flatnonzero(present).astype("<u4")
        width = max(1, (len(alphabet) - 1).bit_length())
        kind = np.uint16 if width <= 16 else np.uint32
        now = (np.cumsum(present) - 1).astype(kind)[values]
        zeros, planes, ones = [], [], []
        for k in range(width - 1, -1, -1):
            bit = (now & kind(1 << k)) != 0
            plane = np.packbits(bit)
            plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8) + BLOCK // 8, np.uint8)])
            counts = _POPCOUNT[plane].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            ones.append(np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)[:-1]]).astype(np.uint32))
            planes.append(plane)
            low = now.compress(~bit)  # several times as fast as now[~bit]
            zeros.append(len(low))
            now = np.concatenate([low, now.compress(bit)])
        return cls(n, alphabet, zeros, planes, ones)

    def dump(self) -> bytes:
        out = [MAGIC, struct.pack("<IIB", self.n, len(self.alphabet), len(self.planes)), self.alphabet.tobytes(), np.array(self.zeros, "<u4").tobytes()]
        for plane, ones in zip(self.planes, self.ones):
            out += [plane.tobytes(), ones.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        n, size, width = struct.unpack_from("<IIB", raw, 4)
        alphabet, at = np.frombuffer(raw, "<u4", size, 13), 13 + 4 * size
        zeros = np.frombuffer(raw, "<u4", width, at).tolist()
        size = (-(-n // 8) + BLOCK // 8 - 1) // (BLOCK // 8) * (BLOCK // 8) + BLOCK // 8
        at, planes, ones = at + 4 * width, [], []
        for _ in range(width):
            planes.append(np.frombuffer(raw, np.uint8, size, at))
            ones.append(np.frombuffer(raw, "<u4", size * 8 // BLOCK, at + size))
            at += size + size * 32 // BLOCK
        return cls(n, alphabet, zeros, planes, ones)

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block, rest = divmod(i, BLOCK)
        start = block * (BLOCK // 8)
        whole, bits = divmod(rest, 8)
        count = int(self.ones[k][block]) + int(_POPCOUNT[self.planes[k][start : start + whole]].sum())
        return count + int(_POPCOUNT[self.planes[k][start + whole] >> (8 - bits)]) if bits else count

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            before = self._ones(k, i)
            bit = self._ones(k, i + 1) - before
            value = value << 1 | bit
            i = self.zeros[k] + before if bit else i - before
        return int(self.alphabet[value])

    def _code(self, value: int) -> int:
        """The place of value in the alphabet, -1 if it does not occur."""
        i = int(np.searchsorted(self.alphabet, value)) if value >= 0 else len(self.alphabet)
        return i if i < len(self.alphabet) and self.alphabet[i] == value else -1

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value among the first i stand below the last plane."""
        low, high, width, value = 0, min(max(i, 0), self.n), len(self.planes), self._code(value)
        if value < 0:
            return 0, 0
        for k in range(width):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if value >> (width - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value among the first i tokens."""
        low, high = self._range(value, i)
        return high - low

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of value."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i, width, value = low + k, len(self.planes), self._code(value)
        for p in range(width - 1, -1, -1):
            one = value >> (width - 1 - p) & 1
            want = i - self.zeros[p] if one else i
            a, b = 0, self.n
            while a < b:  # the least end whose prefix holds want + 1 such bits
                mid = (a + b) // 2
                ones = self._ones(p, mid + 1)
                a, b = (a, mid) if (ones if one else mid + 1 - ones) > want else (mid + 1, b)
            i = a
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.rank(value, self.n))]

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        width = len(self.planes)
        now = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for k in range(width - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            up[np.flatnonzero(bit)] = now[self.zeros[k] :] | now.dtype.type(1 << (width - 1 - k))
            now = up
        return self.alphabet[now]


class Shard:
    """Documents end to end in a wavelet matrix: their ids (null ones masked), their lengths and the tokens."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    def dump(self) -> bytes:
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self.doc_ids], "<i8")
        return b"".join([SHARD_MAGIC, struct.pack("<I", len(ids)), known.tobytes(), ids.tobytes(), np.asarray(self.lengths, "<u4").tobytes(), self.matrix.dump()])

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        if raw[:4] != SHARD_MAGIC:
            raise ValueError("not a shard")
        (n,) = struct.unpack_from("<I", raw, 4)
        known, ids, lengths = np.frombuffer(raw, np.uint8, n, 8), np.frombuffer(raw, "<i8", n, 8 + n), np.frombuffer(raw, "<u4", n, 8 + 9 * n)
        return cls([int(i) if k else None for i, k in zip(ids, known)], lengths.astype(np.int64), WaveletMatrix.load(raw[8 + 13 * n :]))


class PieceEncoder:
    """Whole texts to ids with the tokenizers library, remembering what it made of each piece.

    No token of a byte-level vocabulary spans a single space between two
    characters that are no white space, other than at its start.  So a text
    is cut before each space, and the library sees a piece once.  A text with
    other white space beside a space goes to the library whole.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        starts = [(self.lib.id_to_token(i) or "").startswith("Ġ") for i in range(size)]
        self.starts = np.array(starts)
        self.wide = size > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def cut(self, raw: bytes, feed: bytes) -> list[bytes]:
        """Ids between line feeds."""
        if len(feed) != self.dtype.itemsize:
            return []
        at = np.flatnonzero(np.frombuffer(raw, self.dtype) == np.frombuffer(feed, self.dtype)) * self.dtype.itemsize
        return [raw[a:b] for a, b in zip([0, *(at + len(feed)).tolist()], [*at.tolist(), len(raw)])]

    def joined(self, pieces: list[str]) -> bytes | None:
        """Ids of a text cut before each space, if all its pieces are known."""
        try:
            return self.heads[pieces[0]] + b"".join(map(self.known.__getitem__, pieces[1:]))
        except KeyError:
            return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of self.dtype."""
        out: list[bytes] = []
        for k in range(0, len(texts), LEARN_TEXTS):
            some = texts[k : k + LEARN_TEXTS]
            cut = [t.split(" ") for t in some]
            found = list(map(self.joined, cut))
            missed = [i for i, x in enumerate(found) if x is None]
            self.learn([cut[i] for i in missed])
            for i in missed:
                ids = self.joined(cut[i])
                found[i] = self.library(some[i]) if ids is None else ids
            out += found
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the unknown pieces of texts, many in a call: each starts at a token with a leading space."""
        heads, new, broken = {}, {}, {}
        for head, *pieces in texts:
            heads[head] = None
            for p in set(filterfalse(self.known.__contains__, pieces)):
                if p.isalnum():  # no white space in it
                    new[p] = None
                elif p and not p[0].isspace() and not p[-1].isspace():
                    first, *rest = lines = p.split("\n")
                    if rest and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                        broken[p] = lines  # a line feed between two such characters is a token of its own
                        heads |= dict.fromkeys(rest)
                        p = first
                    if p not in self.known:
                        new[p] = None
        if len(self.known) + len(new) + len(self.heads) > CACHE_PIECES:
            self.known.clear()
            self.heads.clear()
        feed = self.library("\n")
        whole: list[str] = []  # words without any white space: a line feed between two of them is a token of its own
        for h in filterfalse(self.heads.__contains__, heads):
            if len(h.split()) == 1 and h == h.strip():
                whole.append(h)
            elif not h or not h[-1].isspace():  # white space at its end may join the space that follows
                self.heads[h] = self.library(h)
        for k in range(0, len(whole), LEARN_PIECES):
            some = whole[k : k + LEARN_PIECES]
            found = self.cut(self.library("\n".join(some)), feed)
            self.heads |= dict(zip(some, found if len(found) == len(some) else map(self.library, some)))
        new = list(new)
        for k in range(0, len(new), LEARN_PIECES):
            some = new[k : k + LEARN_PIECES]
            ids = np.frombuffer(self.library(" " + " ".join(some)), self.dtype)
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(some):
                raw, ends = ids.tobytes(), [*(at[1:] * self.dtype.itemsize).tolist(), ids.nbytes]
                self.known |= {p: raw[a:b] for p, a, b in zip(some, [0, *ends], ends)}
            else:  # a vocabulary in which a leading space is no part of a token
                self.known |= {p: self.library(" " + p) for p in some}
        self.known |= {p: feed.join([self.known[first], *(self.heads[x] for x in rest)]) for p, (first, *rest) in broken.items() if first in self.known}


    def forget(self) -> None:
        """Keep a bounded part of the pieces; heads are of one text mostly."""
        self.heads.clear()
        if len(self.known) > KEEP_PIECES:
            self.known = dict(islice(self.known.items(), KEEP_PIECES))


_ENCODERS: dict[int, PieceEncoder] = {}


def _encoder(spec: str) -> PieceEncoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(spec)
    return _ENCODERS[key]


def _forget() -> None:
    for coder in _ENCODERS.values():
        coder.forget()


def write(df: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all whole texts, each followed by end_id, as shards under path.

    Documents stand in ascending doc_id order, null ids first; rows with the
    same id stand beside each other, ordered by a hash of the text.  A null text counts as
    empty: its document is end_id alone.  An empty table gives no shards.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("h"))  # no texts among the bounds of ranges, which the driver samples
    dealt = docs.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, block = _encoder(spec.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype).tobytes()
        ids: list[int | None] = []
        raw: list[bytes] = []
        before, held = 0, 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) // coder.dtype.itemsize for x in raw], np.int64)
            payload = Shard(ids, lengths, WaveletMatrix.build(np.frombuffer(b"".join(raw), coder.dtype))).dump()
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "n_tokens": int(lengths.sum()), "payload": payload}], schema)

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(k, SLICE_ROWS)
                for name, found in zip(some.column(0).to_pylist(), coder.encode(some.column(1).fill_null("").to_pylist())):
                    ids.append(name)
                    raw.append(found + end)
                    held += len(raw[-1]) // coder.dtype.itemsize
                    if held >= SHARD_TOKENS:
                        yield shard()
                        block, before, held, ids, raw = block + 1, before + held, 0, [], []
        if raw:
            yield shard()

    map_arrow(dealt, run, SHARD_SCHEMA, _forget).write.mode("overwrite").parquet(path)


def shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _placed(spark, path: str) -> DataFrame:
    """payload and start (tokens of all shards before) of each shard under path.

    A shard knows the tokens before it in its part.  Parts are few, one for each
    task that wrote, so the sums of those before a part go to all readers.
    """
    table = shards(spark, path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(parts.select("part", earlier.alias("earlier")))  # as many rows as shuffle partitions, at most
    return table.join(starts, "part").select("payload", (F.col("earlier") + F.col("before")).alias("start"))


def read(spark, path: str) -> DataFrame:
    """Documents of the shards under path: doc_id, start (tokens of all documents before), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start = Shard.load(batch.column(0)[row].as_py()), batch.column(1)[row].as_py()
                tokens = shard.matrix.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start), pa.array(shard.lengths), pa.array(crcs, pa.int64())], schema=schema)

    return map_arrow(_placed(spark, path), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def count(spark, path: str, tokens: list[int]) -> DataFrame:
    """How often each of tokens occurs in the shards under path: token, n.  Two ranks a shard and token; end ids count as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                matrix = Shard.load(raw).matrix
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.rank(t, matrix.n) for t in tokens], pa.int64())], ["token", "n"])

    return map_arrow(shards(spark, path).select("payload"), run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def locate(spark, path: str, token: int) -> DataFrame:
    """Where token occurs in the shards under path: doc_id, place (from 0 in the document), position (from 0 in all tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start = Shard.load(batch.column(0)[row].as_py()), batch.column(1)[row].as_py()
                at = np.array(shard.matrix.occurrences(token), np.int64)
                ends = np.cumsum(shard.lengths)
                own = np.searchsorted(ends, at, side="right")
                doc_ids = [shard.doc_ids[k] for k in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at - (ends - shard.lengths)[own] if len(at) else at), pa.array(at + start)], ["doc_id", "place", "position"])

    return map_arrow(_placed(spark, path), run, "doc_id bigint, place bigint, position bigint")
