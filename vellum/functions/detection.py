"""Detection over batches of texts: the definitions' patterns, fusion and isolation, as an Arrow UDF runs them.

Results are those of the patterns in Java's ``(?iU)`` mode.  A text is not
searched pattern by pattern: each alternative of a label begins with a literal,
which is looked for in the folded text, and the pattern is tried only there.
Texts of ASCII alone are matched folded, against patterns in lower case; others
as they are, against patterns whose classes are written out.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vellum.functions import patterns as P

Definition = tuple[str, str, str, float]
#: White space of Unicode, as Java's \s in mode U.
SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Letters outside ASCII that a search without case takes for s, i, i and k.
FOLDED = {0x17F: "s", 0x131: "i", 0x130: "i", 0x212A: "k"}
SPAN_TYPE = pa.list_(pa.struct([("text", pa.string()), ("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("source", pa.string())]))
#: Bytes of texts that are gone through at once.
SLICE_BYTES = 1 << 20


def _ranges(keep) -> str:
    """The content of a character class with all characters that keep is true of."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and keep(c):
            first = c if first is None else first
        elif first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


def _is_word(c: int) -> bool:
    kind = unicodedata.category(chr(c))
    circled = 0x24B6 <= c <= 0x24E9 or 0x1F130 <= c <= 0x1F149 or 0x1F150 <= c <= 0x1F169 or 0x1F170 <= c <= 0x1F189
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in (0x200C, 0x200D) or circled


@lru_cache(1)
def _word_class() -> str:
    """Content of the class of word characters in Java's mode U: letters, marks, digits, connectors and joiners."""
    return _ranges(_is_word)


@lru_cache(1)
def _letter_class() -> str:
    """Content of the class that Java's \\b goes by outside mode U: letters, decimal digits, underscore, and marks on them."""
    return _ranges(lambda c: c == 95 or unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn"))


def _boundary(word: str) -> str:
    return f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"


def _items(pattern: str, i: int) -> tuple[list[str], int]:
    """Items of the class that begins behind the bracket at i - 1, and the place behind it: characters, escapes, ranges."""
    out = []
    if pattern[i] == "^":
        out.append("^")
        i += 1
    while pattern[i] != "]":
        n = 2 if pattern[i] == "\\" else 1
        if pattern[i + n] == "-" and pattern[i + n + 1] != "]" and not (n == 2 and pattern[i + 1] in "swd"):
            m = 2 if pattern[i + n + 1] == "\\" else 1
            n += 1 + m
        out.append(pattern[i : i + n])
        i += n
    return out, i + 1


def _parts(pattern: str) -> Iterator[tuple[str, list[str] | str]]:
    """A pattern as classes ('[', items), groups' heads ('(', head), escapes and other characters ('', text)."""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            items, i = _items(pattern, i + 1)
            yield "[", items
        elif c == "(":
            head = re.compile(r"\(\?(?:[:=!]|<[=!])|\(").match(pattern, i)[0]
            i += len(head)
            yield "(", head
        else:
            n = 2 if c == "\\" else 1
            yield "", pattern[i : i + n]
            i += n


def lowered(pattern: str) -> str:
    """A pattern for folded ASCII texts: its letters in lower case, escapes as they are."""
    out = []
    for kind, part in _parts(pattern):
        if kind == "[":
            out.append("[" + "".join(x if x.startswith("\\") else x.lower() for x in part) + "]")
        else:
            out.append(part if kind == "(" or part.startswith("\\") else part.lower())
    return "".join(out)


def written_out(pattern: str) -> str:
    """A pattern for texts of any characters, with what Java's mode (?iU) has for classes and boundaries."""
    spaces, word = re.escape(SPACES), _word_class() if re.search(r"\\[wb]", pattern) else ""
    inner = {"\\s": spaces, "\\w": word, "\\d": "\\d", "A-Z": "A-Za-zſı", "a-z": "A-Za-zſıKİ"}
    out = []
    for kind, part in _parts(pattern):
        if kind == "[":
            items = part[1:] if part[0] == "^" else part
            made = [inner.get(x) or (x if len(x) > 1 else x.lower() + x.upper() if x.isascii() and x.isalpha() else re.escape(x)) for x in items]
            out.append("(?-i:[" + ("^" if part[0] == "^" else "") + "".join(made) + "])")
        else:
            out.append({"\\s": f"(?-i:[{spaces}])", "\\w": f"(?-i:[{word}])", "\\b": f"(?-i:{_boundary(word)})"}.get(part, part))
    return "".join(out)


def folded(text: str) -> str:
    """text in lower case, each character still one; only the capital i with a dot would become two."""
    if not text.isascii():
        for c, plain in FOLDED.items():
            text = text.replace(chr(c), plain)
    return text.lower()


def alternatives(label: str) -> list[str]:
    """A label's alternatives at its outermost level."""
    out, depth, now = [], 0, ""
    for kind, part in _parts(label):
        if kind == "[":
            now += "[" + "".join(part) + "]"
            continue
        depth += (kind == "(") - (part == ")")
        if part == "|" and depth == 0:
            out.append(now)
            now = ""
        else:
            now += part
    return [*out, now]


def head(alternative: str) -> tuple[str, str]:
    """The literal in lower case that an alternative begins with, and the rest; what only looks around is left out."""
    rest = re.sub(r"^(?:\\b|\(\?<[!=][^()]*\))+", "", alternative)
    found = re.match(r"[A-Za-z0-9]*(?![?*{])", rest)[0]
    return found.lower(), rest[len(found) :]


class _Detector:
    """The chosen definitions, compiled."""

    def __init__(self, definitions: Sequence[Definition], word_bounded: bool) -> None:
        self.kinds = [d[0] for d in definitions]
        self.scores = [d[3] for d in definitions]
        self.whole, self.any_ = [], []
        literals: dict[str, list[int]] = {}
        searches: dict[str, tuple[re.Pattern, list[int]]] = {}
        self.scans = []
        self._source = []
        for n, (_, label, value, _) in enumerate(definitions):
            bounded = rf"\b(?:{label})" if label and word_bounded else label
            source = rf"(?:{bounded})\s*[:#]?\s*({value})" if label else value
            self._source.append(source)
            self.whole.append(re.compile(lowered(source), re.ASCII))
            self.any_.append(None)
            heads = [head(a) for a in alternatives(label)] if label else []
            if not label or not all(h for h, _ in heads):
                self.scans.append(n)
                continue
            for h, rest in heads:
                if len(h) > 1:
                    literals.setdefault(h, []).append(n)
                else:  # a single letter stands everywhere, so what follows is looked at too; white space and digits of any script may
                    tail = written_out(lowered(rest))
                    searches.setdefault(h + tail, (re.compile(f"{h}(?={tail})"), []))[1].append(n)
        self.literals = [(h, sorted(set(ns))) for h, ns in literals.items()]
        self.searches = list(searches.values())
        self.longest = max((len(h) for h in literals), default=0) + 2
        self.pairs = np.zeros(1 << 16, np.int16)
        self.by_pair: list[list[tuple[int, bytes]]] = []
        for i, (h, _) in enumerate(self.literals):
            raw = h.encode()
            pair = raw[0] << 8 | raw[1]
            if not self.pairs[pair]:
                self.by_pair.append([])
                self.pairs[pair] = len(self.by_pair)
            self.by_pair[self.pairs[pair] - 1].append((i, raw[2:]))

    def pattern(self, n: int) -> re.Pattern:
        """A definition's pattern for texts of any characters; writing classes out takes long, so it waits for such a text."""
        if self.any_[n] is None:
            self.any_[n] = re.compile(written_out(self._source[n]), re.IGNORECASE)
        return self.any_[n]

    def _scanned(self, n: int, body: str, p: re.Pattern) -> Iterator[int]:
        """Places where a definition without a label's literal may begin."""
        if self._source[n] == rf"\b({P.EMAIL})\b":
            return _before_signs(body)
        if self._source[n] == rf"\b({P.IPV4})\b":
            return (i for m in _DOTTED.finditer(body) for i in range(max(0, m.start() - 2), m.end()))
        return (m.start() for m in re.compile(f"(?={p.pattern})", p.flags & ~re.UNICODE).finditer(body))

    def _literals_in(self, low: str, ascii_: bool) -> Iterator[tuple[int, list[int]]]:
        """Literals that stand in a folded text, with their places."""
        if not ascii_:
            for h, (literal, _) in enumerate(self.literals):
                places, at = [], low.find(literal)
                while at >= 0:
                    places.append(at)
                    at = low.find(literal, at + 1)
                if places:
                    yield h, places
            return
        b = np.frombuffer(low.encode() + bytes(self.longest), np.uint8)
        pairs = b[:-1].astype(np.uint16) << 8 | b[1:]
        at = np.flatnonzero(self.pairs[pairs])  # places of a literal's first two characters, by these
        kind = self.pairs[pairs[at]]
        order = np.argsort(kind, kind="stable")
        at = at[order]
        bounds = np.searchsorted(kind[order], np.arange(1, len(self.by_pair) + 2))
        for own, first, last in zip(self.by_pair, bounds.tolist(), bounds[1:].tolist()):
            for h, tail in own if last > first else ():
                places = at[first:last]
                for i, c in enumerate(tail, 2):
                    places = places[b[places + i] == c]
                if len(places):
                    yield h, places.tolist()

    def _places(self, low: str, body: str, ascii_: bool) -> dict[int, list[int]]:
        """By definition, places where it may begin."""
        out: dict[int, list[int]] = {}
        for h, places in self._literals_in(low, ascii_):
            for n in self.literals[h][1]:
                out.setdefault(n, []).extend(places)
        for p, ns in self.searches:
            places = [m.start() for m in p.finditer(low)]
            for n in ns if places else ():
                out.setdefault(n, []).extend(places)
        for n in self.scans:
            out[n] = list(self._scanned(n, body, self.whole[n] if ascii_ else self.pattern(n)))
        return out

    def spans(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Valid spans of texts in the order of texts, definitions, places: text, definition, start, end, value.

        Texts are searched as one, with line feeds between them, which are neither
        letters nor digits to a pattern that looks back; no match goes beyond its text.
        """
        row, which, start, value = [], [], [], []
        plain = [t.isascii() for t in texts]
        for ascii_ in (True, False):
            rows = [i for i, a in enumerate(plain) if a == ascii_]
            if not rows:
                continue
            whole = "\n".join([texts[i] for i in rows])
            ends = np.cumsum([len(texts[i]) + 1 for i in rows])
            firsts, numbers = np.append(0, ends[:-1]), np.array(rows)
            low = folded(whole)
            body = low if ascii_ else whole
            for n, places in self._places(low, body, ascii_).items():
                if not places:
                    continue
                kind, match = self.kinds[n], (self.whole[n] if ascii_ else self.pattern(n)).match
                at = np.unique(np.array(places, np.int64))
                of = np.searchsorted(ends, at, side="right")
                before, upto = len(row), 0
                for i, r, first, last in zip(at.tolist(), numbers[of].tolist(), firsts[of].tolist(), (ends[of] - 1).tolist()):
                    if i < upto or not (m := match(body, i, last)):
                        continue
                    a, upto = m.span(1)
                    v = whole[a:upto]
                    if not "!" <= v[0] <= "~":
                        a += len(v) - len(v := v.lstrip(SPACES))
                    if v and not "!" <= v[-1] <= "~":
                        v = v.rstrip(SPACES)
                    if valid(kind, v):
                        row.append(r)
                        start.append(a - first)
                        value.append(v)
                which += [n] * (len(row) - before)
        row, which, start = (np.array(x, np.int64) for x in (row, which, start))
        order = np.lexsort((start, which, row))
        value = [value[i] for i in order.tolist()]
        row, which, start = row[order], which[order], start[order]
        return row, which, start, start + np.array([len(v) for v in value], np.int64), value


_DOTTED = re.compile(r"\d(?=\.\d+\.\d+\.\d)")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+-")


def _local(c: str) -> bool:
    return c in _LOCAL or (c > "\x7f" and _is_word(ord(c)))


def _before_signs(text: str) -> Iterator[int]:
    """Where addresses may begin: at the first boundary of a run before an at sign, which holds no other sign.

    If the sign before belongs to an address, a next one may begin at any boundary behind it.
    """
    at, before = text.find("@"), 0
    while at >= 0:
        first = at
        while first > before and _local(text[first - 1]):
            first -= 1
        yield from range(first, at)
        before, at = at + 1, text.find("@", at + 1)


@lru_cache(8)
def detector(definitions: tuple[Definition, ...], word_bounded: bool) -> _Detector:
    return _Detector(definitions, word_bounded)


# --- validity ---------------------------------------------------------------------------------------------------------------------

_S = r" \t\n\x0b\f\r"


def _as_java(pattern: str) -> str:
    """A pattern of validity for values of any characters: \\s, \\d as in ASCII, \\b by letters, digits and marks on them."""
    return pattern.replace(r"\b", _boundary(_letter_class())).replace(r"\s", f"[{_S}]").replace(r"\d", "[0-9]")


@lru_cache(16)
def _java(pattern: str) -> re.Pattern:
    return re.compile(_as_java(pattern))


@lru_cache(16)
def _ascii(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


_MARK = frozenset("-–—.:;, \t\n\x0b\f\r[]()/_")
_MARKS, _BRACKETED, _SHORT, _WORDS, _OTHER = (re.compile(x, re.ASCII) for x in (P.MARKS_ONLY, P.BRACKETED, P.SHORT_NUMBER, f"[^{_S}]+", "[^A-Za-z0-9]+"))
_DIAGNOSIS, _DIGITS = re.compile(P.DIAGNOSIS_WORDS), re.compile("[0-9]+")
_BROAD, _LONG, _NUMBERED = frozenset(P.BROAD), frozenset(P.SHORT_REJECTED), frozenset(P.NUMBERED_IDS)


def _holds(pattern: str, text: str) -> bool:
    """Whether a pattern with boundaries is in a text, as Java sees it outside mode U: marks count as letters only behind one."""
    if text.isascii():
        return bool(_ascii(pattern).search(text))
    out, base = [], False
    for c in text:
        kind = unicodedata.category(c)
        if kind != "Mn":
            base = kind[0] == "L" or kind == "Nd"
        out.append("!" if kind == "Mn" and not base else c)
    return bool(_java(pattern).search("".join(out)))


def valid(kind: str, value: str) -> bool:
    """Whether a labelled value counts as an entity of its type."""
    low = value.lower()
    if not value or "...." in value or (value[0] in _MARK and _MARKS.search(value)) or ("[" in value and _BRACKETED.search(low)):
        return False
    if kind in _BROAD and (len(_OTHER.sub("", value)) < 4 or _SHORT.search(value) or any(p in low for p in P.NOISE)):
        return False
    if kind in _LONG and (len(value) > 90 or (len(value) < 18 and len(_WORDS.findall(value)) <= 2)):
        return False
    if kind == "MEDICATION_DOSAGE":
        return any(p in low for p in P.MEDICATION_HINTS) or _holds(P.DOSE, low)
    if kind == "VITAL_SIGNS":
        return any(p in low for p in P.VITAL_HINTS) or _holds(P.READING, value)
    if kind == "DIAGNOSIS_CONDITION":
        return bool(_DIAGNOSIS.search(low))
    if kind == "AGE":
        m = _DIGITS.search(value)
        return bool(m) and len(m[0].lstrip("0")) < 4 and 10 <= int(m[0]) <= 120
    if kind in _NUMBERED:
        return low not in ("yes", "no", "na", "n/a") and bool(_DIGITS.search(value))
    return True


# --- fusion and isolation over flat arrays ----------------------------------------------------------------------------------------


def _loop(start: list, end: list, score: list) -> list[list]:
    """Fusion of spans in order that may overlap: kept ones as [place, score, hybrid]."""
    kept: list[list] = []
    plain = all(a < b for a, b in zip(start, end))
    for c in range(len(start)):
        # Kept spans that are not empty are disjoint and in order, so only the last can overlap.
        near = kept[-1:] if plain else kept
        over = [k for k in near if start[k[0]] < end[c] and start[c] < end[k[0]]]
        same = lambda k: start[k[0]] == start[c] and end[k[0]] == end[c]
        if all(not same(k) and k[1] < score[c] for k in over):
            if over:
                kept = kept[:-1] if plain else [k for k in kept if not any(k is o for o in over)]
            kept.append([c, score[c], False])
        else:
            for k in near:
                if same(k):
                    k[1], k[2] = max(k[1], score[c]), True
    return kept


def fuse(row: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint spans of each row: their places in order of row and start, their scores, and whether two made them.

    In order of start, then score from above, a span displaces those that it
    overlaps if it beats them all; one with exactly the range of a kept one marks
    it and lifts its score.  Spans that begin behind all before them go on
    without a look.
    """
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    order = np.lexsort((np.arange(len(row)), -score, start, row))
    r, a, b, s = row[order], start[order].astype(np.int64), end[order].astype(np.int64), score[order]
    low = int(min(a.min(), b.min()))
    wide = int(max(a.max(), b.max())) - low + 1
    reach = np.maximum.accumulate((b - low) + r.astype(np.int64) * wide) - r.astype(np.int64) * wide + low  # the furthest end of the row so far
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (a[1:] >= reach[:-1])
    firsts = np.flatnonzero(new)
    ends = np.append(firsts[1:], len(r))
    keep, hybrid = new.copy(), np.zeros(len(r), bool)
    s = s.copy()
    for i in np.flatnonzero(ends - firsts > 1):
        x, y = int(firsts[i]), int(ends[i])
        keep[x:y] = False
        for k, points, two in _loop(a[x:y].tolist(), b[x:y].tolist(), s[x:y].tolist()):
            keep[x + k], hybrid[x + k], s[x + k] = True, two, points
    at = np.flatnonzero(keep)
    return order[at], s[at], hybrid[at]


_ASCII_WORD = np.array([chr(c).isalnum() or chr(c) == "_" for c in range(128)])


class Characters:
    """Texts of a slice as bytes, with the place of each character."""

    def __init__(self, texts: pa.Array) -> None:
        """texts: strings without nulls."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.ascii = not bool((self.data > 127).any())
        if self.ascii:
            self.leads, self.first = None, self.offsets
        else:
            self.leads = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
            self.first = np.searchsorted(self.leads, self.offsets)  # a row's first character among all

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def byte_of(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of the byte with which a row's character begins; those outside the row are at its ends."""
        at = np.clip(at, 0, self.lengths()[row]) + self.first[row]
        return at if self.ascii else self.leads[at]

    def words_at(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a row's character is a letter, digit or other word character; false outside of the row."""
        there = (at >= 0) & (at < self.lengths()[row])
        if not len(self.data):
            return there
        place = np.minimum(self.byte_of(row, at), len(self.data) - 1)
        byte = self.data[place]
        out = _ASCII_WORD[np.minimum(byte, 127)] & (byte < 128)
        for i in np.flatnonzero(there & (byte > 127)):
            n = 2 if byte[i] < 0xE0 else 3 if byte[i] < 0xF0 else 4
            out[i] = _is_word(ord(self.data[place[i] : place[i] + n].tobytes().decode()))
        return out & there

    def cut(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """Stretches of rows, by characters."""
        a, b = self.byte_of(row, start), self.byte_of(row, end)
        return sliced(self.data, a, np.maximum(a, b))


def sliced(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Stretches of bytes as strings."""
    offsets = np.zeros(len(a) + 1, np.int64)
    np.cumsum(b - a, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], b - a)
    made = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])
    return made.cast(pa.string())


def isolated(chars: Characters, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether spans have no letter, digit or underscore right before or after them."""
    return ~chars.words_at(row, start - 1) & ~chars.words_at(row, end)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of rows that hold about so many bytes, or one row."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def lists(rows: int, row: np.ndarray, text: pa.Array, kind: pa.Array, start: np.ndarray, end: np.ndarray, score: np.ndarray, source: pa.Array) -> pa.ListArray:
    """Spans in order of rows as an array for each row."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    fields = [text, kind, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(score.astype(np.float64)), source]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(SPAN_TYPE.value_type)))


def named(values: Sequence[str], which: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(which.astype(np.int32)), pa.array(values, pa.string())).cast(pa.string())


def spans_of(texts: pa.Array, definitions: tuple[Definition, ...], word_bounded: bool) -> pa.Array:
    """All valid spans of texts without nulls, in the definitions' order."""
    d = detector(definitions, word_bounded)
    row, which, start, end, value = d.spans(texts.to_pylist())
    return lists(len(texts), row, pa.array(value, pa.string()), named(d.kinds, which), start, end, np.array(d.scores)[which], named(["regex"], np.zeros(len(row))))


def entities_of(texts: pa.Array, definitions: tuple[Definition, ...], word_bounded: bool) -> pa.Array:
    """Disjoint, isolated spans of texts without nulls."""
    d, out = detector(definitions, word_bounded), []
    for first, last in slices(texts):
        part = texts.slice(first, last - first)
        row, which, start, end, value = d.spans(part.to_pylist())
        kept, score, two = fuse(row, start, end, np.array(d.scores)[which])
        free = isolated(Characters(part), row[kept], start[kept], end[kept])
        kept, score, two = kept[free], score[free], two[free]
        out.append(lists(len(part), row[kept], pa.array([value[i] for i in kept.tolist()], pa.string()), named(d.kinds, which[kept]), start[kept], end[kept], score, named(["regex", "hybrid"], two)))
    return pa.concat_arrays(out) if out else pa.array([], SPAN_TYPE)


# --- anonymised texts and reports -------------------------------------------------------------------------------------------------

_CONDITIONS = [(re.compile(p, re.ASCII), name) for p, name in P.CONDITIONS]


@lru_cache(1024)
def _redacted(kind: str) -> str:
    name = re.sub("[^A-Z0-9]+", "_", kind.strip(" ").upper()).strip("_")
    return P.CONSTANT_FORMS.get(kind) or f"[{name or 'ENTITY'}_REDACTED]"


def generalised(kind: str, value: str) -> str:
    """A value's general form by its type."""
    if kind in P.PHI_DATES:
        return "[DATE_REDACTED]"
    if kind == "AGE":
        m = _DIGITS.search(value)
        return f"{int(m[0]) // 10 * 10}-{int(m[0]) // 10 * 10 + 9}" if m else "[AGE_RANGE]"
    if kind == "EMAIL":
        parts = value.split("@")
        return "****@" + (parts[1] if len(parts) == 2 else "redacted.com")
    if kind in P.DIAGNOSES:
        low = value.lower()
        return next((name for p, name in _CONDITIONS if p.search(low)), "medical condition")
    return _redacted(kind)


class Tokens:
    """Pseudonyms of values: a prefix of the type and eight digits that depend on salt and value."""

    def __init__(self, salt: str) -> None:
        raw = salt.encode()
        block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
        self.inner, self.outer = (hashlib.sha256(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))

    def token(self, kind: str, value: str) -> str:
        inner, outer = self.inner.copy(), self.outer.copy()
        inner.update(value.encode())
        outer.update(inner.digest())
        return f"{P.PREFIXES.get(kind, 'ENT')}_{outer.digest()[:4].hex().upper()}"


def _entities(texts: pa.Array, definitions: tuple[Definition, ...]) -> Iterator[tuple[list[str], list[list[tuple[str, str, int, int, float, str]]]]]:
    """Texts by slices, with the spans of each as tuples."""
    d = detector(definitions, False)
    for first, last in slices(texts):
        part = texts.slice(first, last - first)
        body = part.to_pylist()
        row, which, start, end, value = d.spans(body)
        kept, score, two = fuse(row, start, end, np.array(d.scores)[which])
        free = isolated(Characters(part), row[kept], start[kept], end[kept])
        out: list[list] = [[] for _ in body]
        at = kept[free]
        for i, r, n, a, b, s, t in zip(at.tolist(), row[at].tolist(), which[at].tolist(), start[at].tolist(), end[at].tolist(), score[free].tolist(), two[free].tolist()):
            out[r].append((value[i], d.kinds[n], a, b, s, "hybrid" if t else "regex"))
        yield body, out


def full_texts(texts: pa.Array, definitions: tuple[Definition, ...]) -> pa.Array:
    """Texts without nulls, with the general forms of their entities."""
    out = []
    for body, found in _entities(texts, definitions):
        for text, spans in zip(body, found):
            pieces, upto = [], 0
            for value, kind, a, b, _, _ in spans:
                pieces += (text[upto:a], generalised(kind, value))
                upto = b
            out.append("".join([*pieces, text[upto:]]))
    return pa.array(out, pa.string())


def _report(rows: list[list], tokens: Tokens) -> list[tuple]:
    """The report of a document's rows: type, value, token, general form, source, score, count, in order of first occurrence."""
    values: dict[str, list] = {}
    for spans in rows:
        last = {s[0]: s[1] for s in spans}  # a value's last occurrence decides on its token's type
        for i, (value, kind, _, _, score, source) in enumerate(spans):
            here = (i, kind, source, score)
            known = values.get(value)
            if known is None:
                values[value] = [here, 1, tokens.token(last[value], value)]
            else:
                known[0], known[1] = min(known[0], here), known[1] + 1
        if len(rows) > 1:
            for value, kind in last.items():
                values[value][2] = max(values[value][2], tokens.token(kind, value))
    ordered = sorted(values.items(), key=lambda v: v[1][0]) if len(rows) > 1 else values.items()
    return [(f[1], v, token, generalised(f[1], v), f[2], f[3], n) for v, (f, n, token) in ordered]


def same_as_before(ids: pa.Array) -> np.ndarray:
    """Whether each id but the first equals the one before; nulls are equal."""
    a, b = ids[1:], ids[:-1]
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def reports(batches: Iterator[pa.RecordBatch], definitions: tuple[Definition, ...], salt: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reports of changes from batches of ids and texts without nulls, in which rows of one id follow each other."""
    tokens = Tokens(salt)
    held: list[list] = []  # rows of the id that may go on
    held_id = None

    def batch(ids: list[pa.Array], docs: list[list[tuple]]) -> pa.RecordBatch:
        counts = [len(d) for d in docs]
        flat = [x for d in docs for x in d]
        kind, value, token, general, source, score, n = zip(*flat) if flat else ((),) * 7
        serial = [i + 1 for c in counts for i in range(c)]
        id_ = pa.concat_arrays(ids).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        columns = [id_, serial, kind, value, token, general, source, score, n]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for b in batches:
        ids, texts, at = b.column(0), b.column(1), 0
        for _, found in _entities(texts, definitions):
            part = ids.slice(at, len(found))
            at += len(found)
            joined = pa.concat_arrays([held_id, part]) if held else part
            rows = [None, *found] if held else found
            ends = np.append(np.flatnonzero(~same_as_before(joined)) + 1, len(rows)).tolist()
            done_ids, done, first = [], [], 0
            for end in ends:
                group = rows[first:end]
                if first == 0 and held:
                    group = held + group[1:]
                if end < len(rows):
                    done_ids.append(first)
                    done.append(_report(group, tokens))
                else:
                    held, held_id = group, joined.slice(first, 1)
                first = end
            if any(done):
                yield batch([joined.take(pa.array(done_ids, pa.int64()))], done)
    if held:
        yield batch([held_id], [_report(held, tokens)])
