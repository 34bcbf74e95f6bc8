"""Operators 11 to 13 against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import conversations, hard_negatives, personal_data, queries

# --- 11 ---

VECTORS = "vec_id long, embedding array<double>, label int, id string, asked string, chunk int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "i", "a", 1) for i, v, k in rows], VECTORS)


def mined(rows, asked, n_positives=5, n_negatives=3):
    good = [(i, [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for i, v, k in good:
        if asked(i):
            scores = [(clamp(sum(a * b for a, b in zip(v, w))), j, m) for j, w, m in good if j != i and len(w) == len(v)]
            scores.sort(key=lambda s: (-s[0], s[1]))
            for p, j, _ in [s for s in scores if s[2] == k][:n_positives]:
                for rank, (n, q, _) in enumerate([s for s in scores if s[2] != k and 50 * p <= 100 * s[0] <= 95 * p][:n_negatives], 1):
                    out.append((i, j, rank, q, p, n))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 1024, 256), (13, 3, 2)])
def test_hard_negatives(spark, sizes):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((260, 12)) / 3
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 4, 260)))]
    rows += [(300 + i, x[3].tolist(), i % 4) for i in range(40)]  # ties: a group of copies
    rows += [(10, x[10].tolist(), 1)] * 3 + [(7, x[8].tolist(), 2)]  # repeated rows, and an id with two vectors
    rows += [(500, None, 1), (510, [float("nan")] + [1.0] * 11, 1), (520, [None] + [1.0] * 11, 1), (530, [float("inf")] * 12, 1), (540, [0.3] * 12, None), (None, [0.3] * 12, 1)]
    rows += [(600 + i, [0.4, 0.1 * i], i % 2) for i in range(12)]  # another length
    rows += [(620 + i, [], i % 2) for i in range(0, 20, 10)] + [(625, [0.0] * 12, 1), (630, [0.0] * 12, 2)]
    rows += [(640 + i, [float(10 ** (i % 9))] * 12, i % 3) for i in range(20)]  # products beyond 24 and 53 bits
    asked = lambda i: i % 10 == 0
    out = hard_negatives.mine(vectors(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, block=sizes[0], chunk=sizes[1], group=sizes[2])
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == mined(rows, asked)


def test_hard_negatives_of_any_magnitude(spark):
    rows = [(i, [10.0 ** (3 * i), -1.0, 1e305 if i == 9 else 0.5], i % 2) for i in range(12)] + [(20, [1e-310, -2.0**-9, 0.0], 1)]
    out = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") >= 0)
    assert sorted(map(tuple, out.collect())) == mined(rows, lambda i: True)


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(vectors(spark, [(0, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(vectors(spark, [(0, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2)]), F.col("vec_id") % 50 == 0).count() == 1


def test_intervals_drop_no_pair_that_qualifies():
    rng = np.random.default_rng(1)
    q = rng.integers(-200, 200, (90, 16))
    rows = hard_negatives.Rows(16, np.arange(90).tobytes(), np.zeros(90, np.int64).tobytes(), 9, hard_negatives.sliced(q, 9))
    assert (rows.integers() == q).all()
    a = q[:20].astype(np.float32)
    seen = []

    def useful(low, high, at):
        seen.append(low.size)
        return high >= 150_000

    r, c, product = hard_negatives.sift(a, rows.planes, np.ones((20, 90), bool), useful)
    want = q[:20] @ q.T
    assert sorted(zip(r.tolist(), c.tolist())) == sorted(map(tuple, np.argwhere(want >= 150_000).tolist()))
    assert (product == want[r, c]).all() and seen[-1] < seen[0] / 4


# --- 12 ---

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_base(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)
            if good[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def plain_spans(text, base, model):
    """Trees walked row by row; every overlap looked at."""
    scored = []
    for span in personal_data.candidates(text):
        x = personal_data.features(text, span)
        margin = model.trees.first
        for feature, cut, value in model.trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(sum(c < x[feature[node]] for c in model.trees.cuts[feature[node]]) > cut[node])
            margin += value[node - len(feature)]
        at = [c for m, c in zip(model.margins, model.chances) if m <= margin + 1e-12]
        chance = at[-1] if at else 0.0
        if chance >= model.thresholds[span[2]]:
            scored.append((-chance, *span))
    held, out, emails = [(a, b) for a, b, _ in base], list(base), {(a, b) for a, b, k in base if k == 0}
    for _, a, b, k in sorted(scored):
        over = [h for h in held if h[0] < b and a < h[1]]
        if not over or k == 0 and (a, b) not in emails and all(h in emails and a <= h[0] and h[1] <= b for h in over):
            held.append((a, b))
            out.append((a, b, k))
    return sorted(out, key=lambda s: (s[0], s[2]))


PROSE = [
    "write to jan.doe@mail.example.org or jan (at) mail dot org please", "josé.ruiz@correo.es ok", "call +1 (212) 555-0199 now, or tel 0171 555 0199", "host 10.0.0.7 and 10[.]0[.]0[.]8 up, not 300.1.1.1",
    "card 4111 1111 1111 1111, mistyped 4111-1111-1111-1112.", "meet on 2021-03-04 at 12:30:45", "version 1.2.3.4567 out", "order no 123456789", "pi is 3.141592653589", "1.2.3.4.5.6.7.8.9", "a@b.c@d.e f@@g.h %x@y.z", "", " ", "😀 ö@x.yz é 5500005555555559",
]


@pytest.fixture(scope="module")
def model(spark, sf):
    return personal_data.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "1", "2", "9", ".", "..", "@", "-", "+", " ", "(", ")", "é", "%", "12.3", "a@b.c", "4111 1111", "0000", "\n"]
    for text in PROSE + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(8000)]:
        assert personal_data.base_spans(text) == plain_base(text), text


def test_patterns_are_linear():
    import time

    n = 400_000
    for text in ("a" * n, "1" * n, "1." * n, "1 " * n, "+1" + " " * n, "a@" * n, "(" * n, "1 2" + " " * n, "f:" * n, "@a." * n):
        began = time.perf_counter()
        personal_data.base_spans(text)
        personal_data.candidates(text)
        assert time.perf_counter() - began < 20, text[:10]


def test_spans_beyond_the_base(model):
    def added(text):
        base = personal_data.base_spans(text)
        return [(text[a:b], personal_data.KINDS[k]) for a, b, k, _ in model.found(text, base) if (a, b, k) not in base]

    assert added("write to jan.doe (at) mail dot org please") == [("jan.doe (at) mail dot org", "email")]
    assert added("tel 0171 555 0199 now") == [("0171 555 0199", "phone")]
    assert added("host 10[.]0[.]0[.]7 is up") == [("10[.]0[.]0[.]7", "ip")]
    assert added("card 4111-1111-1111-1112.") == [("4111-1111-1111-1112", "card")]
    for clean in ("meet on 2021-03-04 at 12:30:45", "look at the dot matrix. Then stand at the.door", "order no 123456789", 'token = "9dd3c80004c73dc9e548fee51b23b527780d4f20"', "see 1990-2005, page 12", "@home at 5"):
        assert added(clean) == []


def test_find_equals_brute_force(spark, sf, model):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + PROSE + [None, PROSE[0], "x " * 400_000 + "a.b@c.de"]
    given = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, PII_spans string, start int")
    out = personal_data.find(given, model)
    assert out.columns == ["doc_id", "text", "start", "base_spans", "pii_spans", "redacted"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = r.text or ""
        base = plain_base(text)
        assert [(s.start, s.end, personal_data.KINDS.index(s.kind)) for s in r.base_spans] == base
        want = plain_spans(text, base, model)
        assert [(s.start, s.end, personal_data.KINDS.index(s.kind)) for s in r.pii_spans] == want
        assert set(base) <= set(want)
        if not want:
            assert r.redacted == text
    assert rows[len(texts) - len(PROSE) - 3].redacted == "write to [EMAIL] or [EMAIL] please"
    assert personal_data.find(given.limit(0), model).count() == 0


def test_model_without_texts(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    learnt = personal_data.fit(nothing)
    assert [s[:3] for s in learnt.found("mail a.b@c.de", personal_data.base_spans("mail a.b@c.de"))] == [(5, 13, 0)]


def test_query_12(spark, sf):
    out = queries.op12_personal_data(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    got = {r.doc_id: r for r in out.collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = plain_base(d.text or "")
        listed = [f"{personal_data.KINDS[k]}:{a}:{b}" for a, b, k in base]
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


# --- 13 ---

TURNS = "conv_id long, turn long, role string, text string, nth string, copies string"


def plain_repair(rows):
    """Damage and repair of all conversations by plain search; rows: conv_id, turn, role, text."""
    name = lambda x: " " if x is None else str(x)
    talks = {}
    for conv, turn, role, text in rows:
        role, text = name(role), name(text)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        talks.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    out = []
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in talk if t is not None]
        kinds, earlier = [], set()
        for _, role, text in talk:
            body = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not body else "duplicate" if (role, text) in earlier else "truncated" if body[-1] not in ".!?" else "")
            earlier.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))

        @cache
        def best(i, last, inserts=0):
            """(cost, audit, turns) from row i on, after the initial last."""
            found = [(0, "", ())] if i == len(talk) and last in ("", "a") else []
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
            if inserts < 4:
                for new in ("user", "assistant"):
                    if new[0] in legal:
                        c, s, t = best(i, new[0], inserts + 1)
                        found.append((3 + c, "I" + s, (new + ":", *t)))
            if i < len(talk):
                c, s, t = best(i + 1, last)
                found.append((4 + c, "D" + s, t))
                if kinds[i] not in ("blank", "duplicate"):
                    _, role, text = talk[i]
                    for edit, new, cost in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                        if new[:1] and new[0] in legal:
                            c, s, t = best(i + 1, new[0])
                            found.append((cost + 3 * (kinds[i] == "truncated") + c, edit + s, (f"{new}:{text}", *t)))
            return min(found, default=(10**9, "", ()))

        cost, audit, repaired = best(0, "")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(spark, rows):
    return spark.createDataFrame([(*r, "n", "c") for r in rows], TURNS)


def random_talks(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 3]), role, rng.choice(["Yes.", "No", "Well!", " \t", "", None, "So?\n", f"Text {turn}.", "é 😀."])))
    return rows


def test_conversations_equal_brute_force(spark):
    rows = random_talks(400)
    out = conversations.repair(conversations.damaged(talks(spark, rows).repartition(5)))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_repair(rows)


def test_conversations_equal_sql(spark):
    import duckdb

    rows = random_talks(300, 9)
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = conversations.repair(conversations.damaged(talks(spark, rows)))
    want = con.sql(conversations.ORACLE).select(*out.columns).fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_long_and_empty_conversations(spark):
    assert conversations.repair(conversations.damaged(talks(spark, []))).count() == 0
    rows = [(5, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"Turn {t % 3000}" + "." * (t % 5 > 0)) for t in range(12_000)] + [(6, 0, "user", "x " * 600_000 + "."), (6, 1, "assistant", "Yes.")]
    out = {r.conv_id: r for r in conversations.repair(conversations.damaged(talks(spark, rows))).collect()}
    gone = next(c for c in range(10**6) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    assert set(out) == {5, 6}
    assert out[5].duplicate > 6000 and len(out[5].audit) >= 12_000 - 700
    lost = conversations.repair(conversations.damaged(talks(spark, [(gone, 0, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in lost] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
