"""Operator 12: personal data by candidate spans and boosted trees.

Four patterns give the base spans of a text: e-mail, IP address, card number
(12 to 19 digits that pass the check digit) and phone number (+ and 9 to 15
digits).  They always stay.  Generators of high recall propose more spans, which
may overlap each other and base ones: addresses with other letters or spelt out
(``name (at) host dot org``), IPv6 and defanged IPv4, card numbers with other
separators or a mistyped digit, phone numbers without a plus.  Each candidate becomes
a row of features of its format and its context, gradient-boosted trees score
it, and a candidate is taken if its calibrated probability reaches
the threshold of its kind.  Taken spans overlap neither base spans nor each other, the
likelier goes first; only a longer e-mail address may be taken around a base one.

The trees learn on the driver from a bounded sample of texts (``TRAIN_TEXTS``, of at
most ``TRAIN_CHARS`` characters each).  Positives are the sample's base spans, the
same spans rewritten in other formats where they stand, and made-up ones by rule in the
sample's contexts.  Negatives are numbers of other kinds by rule (dates, times, versions,
amounts, long ids, prose with "at" and "dot") in those contexts, and the sample's candidates
that touch a letter or digit on either side.  A third is held out: on it margins are turned into
probabilities by isotonic regression, and each kind's threshold is the least one from which on
the share of true spans is ``PRECISION``.

All patterns are linear in a text's length; a text is read whole.  Offsets count code points; ends are exclusive.  A null
text counts as empty.  Repeated rows are treated alike, an empty table gives
none, and all columns of the input are kept but those named as a result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The sample that trains: texts, and the most characters of one.
TRAIN_TEXTS, TRAIN_CHARS = 1500, 20_000
#: Made-up positives of each kind and negatives of each rule, and negatives taken from the sample.
MADE_UP, SAMPLED = 120, 2000
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
PRECISION = 0.98
#: Characters of context that features look at.
AROUND = 40

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # never fails within a run of digits, so a run is read once
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all base spans, by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:  # an address starts where the run of its characters before the sign does, or the last address ended
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end(), EMAIL))
        end = domain.end() if domain else at + 1
        at = text.find("@", end)
    for m in _DOTTED.finditer(text):  # parts are taken four at a time
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, at + size, IP))
            at += size + 1
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), CARD))
    if "+" in text:
        out += [(m.start(), m.end(), PHONE) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Generators of candidates.  Separators and part lengths are bounded, so each is linear.
_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|(?<=\s)at(?=\s)", re.IGNORECASE)
_SPELT_LEFT = re.compile(r"[\w.%+-]{1,64}\s{0,2}\Z")
_SPELT_RIGHT = re.compile(r"\s{0,2}[\w-]{1,63}(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[\w-]{1,63}){1,4}", re.IGNORECASE)
_NUMBERS = re.compile(r"[(]?[0-9]+(?:[ .\-–/()\[\]]{1,3}[0-9]+){0,7}")
_V6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4})?(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?::{1,2})?")
_SPELT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\bat\s+[\w-]{1,63}\s?(?:[\[({<]\s?)?dot\b", re.IGNORECASE)


_SPELT_HINTS = ("dot", "Dot", "DOT", "(at", "[at", "{at", "<at", "(AT", "[AT", "( at", "[ at")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data."""
    out: list[Span] = []
    if "@" in text or any(h in text for h in _SPELT_HINTS) and _SPELT.search(text):
        for m in _AT.finditer(text):
            left = _SPELT_LEFT.search(text[max(0, m.start() - 66) : m.start()])
            right = _SPELT_RIGHT.match(text, m.end(), m.end() + 330) if left else None
            if right and (m.group()[0] not in "aA" or "dot" in right.group().lower()):  # a bare "at" is mostly a word
                out.append((m.start() - len(left.group()), right.end(), EMAIL))
    for m in _NUMBERS.finditer(text):
        s = m.group()
        n = len(only_digits(s))
        if n < 4:
            continue
        start = m.start() - (m.start() > 0 and text[m.start() - 1] == "+")
        if 12 <= n <= 19:
            out.append((m.start(), m.end(), CARD))
        if 7 <= n <= 15:
            out.append((start, m.end(), PHONE))
        if n <= 12 and s.count(".") >= 3:
            out.append((m.start(), m.end(), IP))
    if text.count(":") > 1:
        out += [(m.start(), m.end(), IP) for m in _V6.finditer(text)]
    return out


#: Words that stand before a span of each kind, and before numbers of other kinds.
HINTS = (
    ("mail", "e-mail", "email", "contact", "courriel", "correo", "kontakt", "write"),
    ("ip", "host", "server", "address", "addr", "client", "serveur", "servidor", "ipv6"),
    ("card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"),
    ("tel", "phone", "mobile", "call", "fax", "cell", "telefon", "téléphone", "teléfono"),
    ("version", "v", "order", "no", "nr", "id", "ref", "isbn", "date", "page", "section", "token", "sha", "hash", "invoice", "total", "price", "art"),
)
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_GROUPS = re.compile(r"[0-9]+")
_DATE = re.compile(r"(?:(?:19|20)\d\d[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:19|20)\d\d)")
_BRACKETED_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]", re.IGNORECASE)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    a, b, kind = span
    s, before, after = text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]
    groups = [len(g) for g in _GROUPS.findall(s)]
    digits = only_digits(s)
    letters = sum(c.isalpha() for c in s)
    left, right = before[-1:], after[:1]
    words = {w.lower() for w in _WORDS.findall(before)[-3:]}
    tail = s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1]
    values = [int(g) for g in _GROUPS.findall(s)[:8] if len(g) < 6]
    return [
        *(float(kind == k) for k in range(4)),
        len(s), len(digits), letters, len(s) - letters - len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        float(s[:1] == "+" or left == "+"), float("(" in s), float("[" in s or "{" in s), float("@" in s), s.count("."), s.count(":"), s.count("-"), s.count(" "),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(digits[:1] in tuple("3456")), max(values, default=0), float(_DATE.search(s) is not None),
        float(left.isalnum() or left == "_"), float(right.isalnum() or right == "_"), float(left in "\"'=#$€/\\." and left != ""), float(right in "\"'/\\%€$" and right != ""),
        float(tail.isalpha() and 2 <= len(tail) <= 6), float("dot" in s.lower()), len(set(digits)),
        *(float(not words.isdisjoint(HINTS[k])) for k in (kind, 4)),
        float(s.isascii()), float(_BRACKETED_AT.search(s) is not None),
    ]


class Trees:
    """Gradient-boosted trees of one depth on binned features, for two classes."""

    def __init__(self, cuts: list[np.ndarray], first: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.cuts, self.first, self.trees = cuts, first, trees

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1)

    @staticmethod
    def leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return node - (2**DEPTH - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = self.binned(x)
        out = np.full(len(x), self.first)
        for feature, cut, value in self.trees:
            out += value[self.leaf(x, feature, cut)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        """Newton steps on the logistic loss; of equal gains the first feature and cut count."""
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
        model = cls(cuts, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
        bins = model.binned(x)
        n, wide = x.shape[1], BINS + 2
        flat = bins + np.arange(n) * wide
        score = np.full(len(x), model.first)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, wide)
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = node == k
                    if own.sum() < 8:
                        continue
                    sums = [np.bincount(flat[own].ravel(), np.repeat(v[own], n), n * wide).reshape(n, wide).cumsum(axis=1) for v in (g, h)]
                    gl, hl, gt, ht = sums[0], sums[1], g[own].sum(), h[own].sum()
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[k], cut[k] = divmod(best, wide)
                node = 2 * node + 1 + (bins[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - (2**DEPTH - 1)
            gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
            value = -RATE * gs / (hs + 1)
            score += value[leaf]
            model.trees.append((feature, cut, value))
        return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the rising probabilities from them on (pooled neighbours that violate the order)."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # least margin, sum, size
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        pools.append([m, v, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Trees, the calibration of their margins, and a threshold for each kind."""

    def __init__(self, trees: Trees, margins: np.ndarray, chances: np.ndarray, thresholds: list[float]):
        self.trees, self.margins, self.chances, self.thresholds = trees, margins, chances, thresholds

    def chance(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.margins, self.trees.margin(x), side="right") - 1
        return np.where(at >= 0, self.chances[np.maximum(at, 0)], 0.0)

    def found(self, text: str, base: list[Span]) -> list[tuple[int, int, int, float]]:
        """All spans with their probability (base: 1), by start, then kind."""
        taken = [(a, b, k, 1.0) for a, b, k in base]
        some = [c for c in candidates(text)]
        if some:
            chance = self.chance(np.array([features(text, c) for c in some]))
            likely = [(-p, *c) for c, p in zip(some, chance.tolist()) if p >= self.thresholds[c[2]]]
            held: list[tuple[int, int]] = []  # disjoint, by start
            for a, b in sorted((a, b) for a, b, _ in base):
                if held and a < held[-1][1]:
                    held[-1] = (held[-1][0], max(b, held[-1][1]))
                else:
                    held.append((a, b))
            emails = {(a, b) for a, b, k in base if k == EMAIL}
            for p, a, b, k in sorted(likely):
                i = j = bisect_left(held, (a, b)) - 1
                i += i < 0 or held[i][1] <= a
                while j + 1 < len(held) and held[j + 1][0] < b:
                    j += 1
                crossed = held[i : j + 1]  # what it overlaps
                if not crossed or k == EMAIL and (a, b) not in emails and all(x in emails and a <= x[0] and x[1] <= b for x in crossed):
                    held[i : j + 1] = [(a, b)]
                    taken.append((a, b, k, -p))
        return sorted(taken, key=lambda s: (s[0], s[2]))


def redacted(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """text with each span replaced by its kind in brackets; where base spans overlap, the part that goes on has the kind of the first."""
    parts, at = [], 0
    for a, b, kind, _ in spans:
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _rewritten(rng: random.Random, s: str, kind: int) -> str:
    """The same datum in a format that no base pattern knows."""
    digits = only_digits(s)
    if kind == EMAIL:
        local, _, host = s.partition("@")
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("@", "."), (" [at] ", "."), ("(at)", ".")])
        host = host.replace(".", dot)
        return local[:-1] + rng.choice("éüñø") + local[-1:] + at + host if at == "@" else local + at + host
    if kind == IP:
        return s.replace(".", rng.choice(["[.]", " . ", "(.)"])) if rng.random() < 0.6 else ":".join(f"{rng.getrandbits(16):x}" for _ in range(8)) if rng.random() < 0.5 else f"fe80::{rng.getrandbits(16):x}:{rng.getrandbits(16):x}:{rng.getrandbits(16):x}"
    if kind == CARD:
        i = rng.randrange(1, len(digits))
        digits = digits[:i] + str((int(digits[i]) + rng.randrange(1, 10)) % 10) + digits[i + 1 :] if rng.random() < 0.6 else digits
        return rng.choice(["", ".", "-", " "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    digits = digits[-10:] if len(digits) > 10 else digits
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "0{} {} {}", "{} {} {}"]).format(digits[:3], digits[3:6], digits[6:])


def _made_up(rng: random.Random, kind: int) -> str:
    """A datum of a kind that the base patterns know."""
    if kind == EMAIL:
        word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        return f"{word(rng.randrange(2, 9))}{rng.choice(['', '.', '_'])}{word(rng.randrange(1, 6))}{rng.choice(['', '7', '42'])}@{word(rng.randrange(3, 9))}.{rng.choice(['org', 'com', 'net', 'de', 'fr', 'es', 'co.uk'])}"
    if kind == IP:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == CARD:
        digits = rng.choice("3456") + "".join(str(rng.randrange(10)) for _ in range(rng.choice([14, 14, 14, 13])))
        return digits + next(str(d) for d in range(10) if luhn(digits + str(d)))
    return f"+{rng.choice(['1', '33', '44', '49', '34'])} {rng.choice(['({})', '{}']).format(rng.randrange(100, 1000))} {rng.randrange(100, 1000)}{rng.choice([' ', '-'])}{rng.randrange(1000, 10000)}"


def _other(rng: random.Random, rule: int) -> str:
    """A number or phrase that is no personal data."""
    r, n = rng.randrange, lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    day = (r(1950, 2030), r(1, 13), r(1, 29))
    return [
        lambda: rng.choice(["{:04d}-{:02d}-{:02d}", "{:04d}/{:02d}/{:02d}", "{:04d}.{:02d}.{:02d}"]).format(*day),
        lambda: rng.choice(["{2:02d}.{1:02d}.{0}", "{2:02d}-{1:02d}-{0}", "{2}/{1}/{0}"]).format(*day),
        lambda: f"{r(24):02d}:{r(60):02d}:{r(60):02d}",
        lambda: f"version {r(12)}.{r(20)}.{r(30)}.{r(300, 9000)}",
        lambda: f"{r(1000, 9999)}-{r(1000, 9999)}",
        lambda: " ".join([str(r(1, 999)), *(str(r(100, 999)) for _ in range(r(2, 4)))]),
        lambda: f"{r(1, 99)}.{n(rng.choice([9, 12, 15]))}",
        lambda: f"order no {n(rng.choice([7, 8, 9, 12]))}",
        lambda: n(rng.choice([20, 24, 30])),
        lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
        lambda: f"{n(4)} {n(4)} {n(2)} {n(1)} {n(3)}",
        lambda: "look at the " + rng.choice(["dot matrix", "red dot there", "dot com"]),
        lambda: rng.choice(["@home", "@work now.", "5 @ 3.50", "x@y", "def f @ g"]),
        lambda: f"{r(1, 40)}.{r(1, 40)}.{r(1, 40)}.{r(1, 40)}.{r(1, 40)}",
        lambda: f"ISBN 978-{r(10)}-{n(3)}-{n(5)}-{r(10)}",
        lambda: f"a::b::c{r(9)} x::{r(9)}::y",
        lambda: rng.choice(["stand", "look", "arrive"]) + " at " + rng.choice(["the", "home.Then", "v1.2", "node.js", "noon.", "www.site"]) + " and on",
    ][rule]()


N_RULES = 17


def train(texts: list[str]) -> Model:
    """A model from a sample of texts; it may be empty."""
    rng = random.Random(11)
    rows: list[list[float]] = []
    marks: list[int] = []
    kinds: list[int] = []

    def enter(text: str, span: Span, mark: int) -> None:
        rows.append(features(text, span))
        marks.append(mark)
        kinds.append(span[2])

    def positive(before: str, s: str, after: str, kind: int) -> None:
        """Enter the candidate that covers s best, if it covers nearly all of it and little more."""
        text, a, b = before + s + after, len(before), len(before) + len(s)
        near = [c for c in candidates(text) if c[2] == kind and min(b, c[1]) - max(a, c[0]) >= 0.9 * (b - a) and c[1] - c[0] <= 1.2 * (b - a)]
        if near:
            enter(text, max(near, key=lambda c: (min(b, c[1]) - max(a, c[0]), -c[0])), 1)

    contexts = [("", "")]
    sampled: list[tuple[str, Span]] = []
    for text in texts:
        base = base_spans(text)
        for a, b, kind in base[:20]:
            before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
            contexts.append((before, after))
            positive(before, text[a:b], after, kind)
            positive(before, _rewritten(rng, text[a:b], kind), after, kind)
        for c in candidates(text):
            if all(c[1] <= a or b <= c[0] for a, b, _ in base) and (text[c[0] - 1 : c[0]].isalnum() or text[c[1] : c[1] + 1].isalnum()):
                sampled.append((text, c))
        if text:
            at = rng.randrange(len(text))
            gap = text.find(" ", at)
            contexts.append((text[max(0, gap - AROUND) : gap + 1], text[gap : gap + AROUND]) if gap >= 0 else ("", ""))
    hint = lambda k: rng.choice(HINTS[k]) + rng.choice([": ", " ", " = "]) if rng.random() < 0.25 else ""
    for kind in range(4):
        for _ in range(MADE_UP):
            before, after = rng.choice(contexts)
            datum = _made_up(rng, kind)
            before = before + (" " if before and not before[-1:].isspace() else "") + hint(kind)
            positive(before, datum, rng.choice([after, ".", ", ", ""]), kind)
            positive(before, _rewritten(rng, datum, kind), after if after[:1] == " " else " " + after, kind)
    for rule in range(N_RULES):
        for _ in range(MADE_UP):
            before, after = rng.choice(contexts)
            before = before + (" " if before and not before[-1:].isspace() else "") + (hint(4) if rule < 9 else "")
            text = before + _other(rng, rule) + (after if after[:1] == " " else " " + after)
            for c in candidates(text):
                if c[0] < len(text) - len(after) and c[1] > len(before):
                    enter(text, c, 0)
    rng.shuffle(sampled)
    for text, c in sampled[:SAMPLED]:
        enter(text, c, 0)
    x, y, kind = np.array(rows, np.float64), np.array(marks, np.float64), np.array(kinds)
    held = np.arange(len(x)) % 3 == 0
    order = np.array(rng.sample(range(len(x)), len(x)))
    x, y, kind = x[order], y[order], kind[order]
    trees = Trees.fit(x[~held], y[~held])
    margin = trees.margin(x[held])
    margins, chances = isotonic(margin, y[held])
    model = Model(trees, margins, chances, [2.0] * 4)
    chance = model.chance(x[held])
    for k in range(4):
        p, t = chance[kind[held] == k], y[held][kind[held] == k]
        for c in sorted(set(p[p >= 0.5].tolist())):
            if t[p >= c].mean() >= PRECISION:
                model.thresholds[k] = c
                break
    return model


def fit(df: DataFrame, text: str = "text", rows: int = TRAIN_TEXTS, most_chars: int = TRAIN_CHARS) -> Model:
    """Train on at most ``rows`` distinct texts with a digit or an at sign, of at most most_chars characters: those with the least hash."""
    body = F.col(f"`{text}`")
    some = df.where((F.length(body) <= most_chars) & body.rlike("[0-9@]")).select(F.xxhash64(body).alias("h"), body.alias("text"))
    few = some.select("h").distinct().orderBy("h").limit(rows)  # chosen by the hashes alone; the texts are read for these
    found = some.join(F.broadcast(few), "h").dropDuplicates(["h"]).collect()
    return train([r["text"] for r in sorted(found, key=lambda r: r["h"])])


RESULTS = ("base_spans", "pii_spans", "redacted")
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("chance", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))


def find(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with base_spans and pii_spans (arrays of kind, start, end and chance, by start, then kind as in KINDS) and redacted, the text with [KIND] in place of its spans."""
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in RESULTS])
    at = [c.lower() for c in kept.columns].index(text.lower())
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        for batch in batches:
            base, spans, texts = [], [], []
            for body in batch.column(at):
                body = body.as_py() or ""
                own = base_spans(body) if _HAS.search(body) else []
                base.append([(KINDS[k], a, b, 1.0) for a, b, k in own])
                all_ = learnt.found(body, own)
                spans.append([(KINDS[k], a, b, p) for a, b, k, p in all_])
                texts.append(redacted(body, all_))
            found = [pa.array([[dict(zip(("kind", "start", "end", "chance"), s)) for s in row] for row in x], _ARROW_SPANS) for x in (base, spans)] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *RESULTS])

    return map_arrow(kept, run, T.StructType([*kept.schema.fields, *(T.StructField(r, _SPANS) for r in RESULTS[:2]), T.StructField("redacted", T.StringType())]))


_HAS = re.compile(r"[0-9@]")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of all, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
