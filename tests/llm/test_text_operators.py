"""Edge cases and brute-force versions of the operators on documents."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, common, fingerprints, language, licenses, line_dedup, mixing, near_dup, token_files, toxicity

P = pytest.importorskip("public_tokenizers")
T = pytest.importorskip("tokenizers")
WORDS = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_50k.json")

SCHEMA = "doc_id long, text string, lang string, source string, covered string, copy int, label int"
ODD = [None, "", "   ", "\n", "a", "Don't stop", "İΣας <|endoftext|> x<|startoftext|>", "é é ½ ²\x1c\x85 　", "x" * 5000, "你好 😀", "A\n\nB\nC", "one two three four", "Tie tie"]


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", [None] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], "c", 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_columns(out, given, *more):
    assert out.columns == [c for c in given.columns if c not in more] + list(more)


# --- 1 ---


def test_bpe_equals_library(spark):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("aàΣς'sS ½9\nẛ̣<|endoftext|>中.,!\x85\x1c_-") for _ in range(60)) for _ in range(200)]
    given = docs(spark, texts)
    out = bpe.round_trip(given, WORDS)
    same_columns(out, given, "token_ids", "decoded")
    lib = T.Tokenizer.from_file(WORDS)
    for r in out.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(empty(spark), WORDS).count() == 0


def test_bpe_heap_equals_scan():
    coder = bpe.RankArrayBPE(open(WORDS, encoding="utf-8").read())
    rnd = random.Random(1)
    for n in (2, 3, 60, 64, 65, 200):
        piece = "".join(rnd.choice("thean") for _ in range(n))
        raw = piece.encode()
        ids = [coder.first[b] for b in raw[:-1]] + [coder.last[raw[-1]]]
        assert T.Tokenizer.from_file(WORDS).encode(piece, add_special_tokens=False).ids == list(coder.merge_long(list(ids))) == list(coder.merge(piece))


# --- 2 ---


def shingle_set(text):
    low = (text or "").encode().translate(near_dup._LOWER)
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def varied(rnd, words, share):
    return [rnd.choice(["alpha", "beta", "gamma"]) + str(rnd.random()) if rnd.random() < share else w for w in words]


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    texts = list(ODD) + ["same words here"] * 4 + ["Same WORDS here"]
    texts += [" ".join(varied(rnd, base, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.04, 0.1) for _ in range(6)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i * 8 :] + [f"d{j}" for j in range(i * 8)]) for i in range(10)]  # each close to the next only
    component, n = brute_components(texts)
    out = {r.doc_id: r for r in near_dup.link(docs(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i in range(len(texts)):
        assert (out[i].component_id, out[i].n_shingles, out[i].kept) == (component[i], n[i], component[i] == i), i
    kept = near_dup.deduplicate(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component))


def test_near_duplicates_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(varied(rnd, base, 0.02)) for _ in range(60)]
    component, _ = brute_components(texts)
    assert {r.doc_id: r.component_id for r in near_dup.link(docs(spark, texts)).collect()} == dict(enumerate(component))


def test_near_duplicates_odd_tables(spark):
    assert near_dup.link(empty(spark)).count() == 0
    assert near_dup.deduplicate(empty(spark)).count() == 0
    rows = [(None, "a b c d e f", None, None, None, 1, 1), (3, "a b c d e f", None, None, None, 1, 1), (3, "a b c d e f", None, None, None, 1, 1), (3, "other text", None, None, None, 1, 1)]
    out = near_dup.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in out if r.doc_id is not None) == [(False, 3, True)] * 3
    assert [r.kept for r in out if r.doc_id is None] == [True]


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(4)
    for shared in (950, 800, 600):
        a = np.unique(rnd.integers(0, 1 << 63, 1000, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:shared], rnd.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)]))
        bits = int(np.bitwise_count((near_dup.odd_sketch(near_dup.minhash(a)) ^ near_dup.odd_sketch(near_dup.minhash(b))).view(np.uint64)).sum())
        assert abs(near_dup.similarity(bits) - shared / (2000 - shared)) < 0.15


# --- 3 ---


def test_fingerprints(spark):
    texts = ["p one. q two\nsecond line, with more\nthird", "third\np one. q two\nsecond line, with more", "p one. q two\nsecond line, with more", "third", "", None]
    out = docs(spark, texts).select("doc_id", fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    f = [r.f for r in out]
    assert f[0] == f[1] != f[2] and f[4] == f[5]
    pair = spark.createDataFrame([(f[2], f[3], f[0])], "a struct<equal:array<bigint>,sketch:array<int>>, b struct<equal:array<bigint>,sketch:array<int>>, c struct<equal:array<bigint>,sketch:array<int>>")
    r = pair.select(fingerprints.combine(F.col("a"), F.col("b")).alias("x"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("y")).first()
    assert r.x == f[0] and r.y == f[2]


def test_fingerprints_of_edited_texts(spark):
    rnd = random.Random(2)
    texts = ODD + ["\n".join(" ".join(f"w{rnd.randrange(99)}" for _ in range(12)) + "." for _ in range(8)) for _ in range(30)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "a null id"), (6, "again six")]
    inner, outer = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    got = inner.select("doc_id", "text", "next_text").unionByName(outer)
    got = [(r.doc_id, r.text, r.next_text, r.e) for r in got.withColumn("e", fingerprints.edited(F.col("text"), F.col("next_text"))).collect()]
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        want.append((i, t, n, t[: len(t) - m] + n[:m]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    inner, outer = fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string"))
    assert inner.count() + outer.count() == 0
    inner, outer = fingerprints.with_next(spark.createDataFrame([(1, "only one")], "doc_id long, text string"))
    assert [r.next_text for r in inner.select("next_text").unionByName(outer.select("next_text")).collect()] == ["only one"]


# --- 4 ---


def test_mix_meets_targets(spark):
    rnd = random.Random(8)
    sources = [None if i % 11 == 0 else f"s{i % 4}" if i % 3 else "s0" for i in range(400)]
    texts = [None if i % 37 == 0 else " ".join(["w"] * rnd.randrange(0, 60)) for i in range(400)]
    given = docs(spark, texts, source=sources)
    out = mixing.mix(given, slots=512).collect()
    assert len(out) == 400
    total, by = sum(r["size"] for r in out), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert abs(sum(b[0] for b in by.values()) - 1.5 * total) < 1e-6 * total
    for target, taken, size in by.values():
        assert target <= 2 * size + 1e-9 and taken == int(target)
    again = mixing.mix(given, slots=512).collect()
    assert sorted(out, key=repr) == sorted(again, key=repr)
    kept = mixing.mixed(given, slots=512)
    assert kept.columns == given.columns
    copies = {}
    for r in kept.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: -(-r.taken // r["size"]) for r in out if r.taken}


def test_schedule_decides_the_mix(spark, monkeypatch):
    """Where sources are large, their shares and the order of the mix are those of the points."""
    monkeypatch.setattr(mixing, "SMALL", 0)
    rnd = random.Random(12)
    sources = [f"s{i % 3}" for i in range(300)]
    texts = [" ".join(["w"] * rnd.randrange(1, 60)) for _ in range(300)]
    given = docs(spark, texts, source=sources).select("*", F.lit(1).alias("mix_id"), F.lit(2).alias("mix_copy"), F.lit("k").alias("mix_key"))
    out = mixing.mix(given, slots=2048).collect()
    total = sum(r["size"] for r in out)
    length = -(-int(1.5 * total) // 2048)
    for s in ("s0", "s1", "s2"):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8 * length
        assert all(r.taken <= 2 * r["size"] for r in own)
        ranked = sorted((r.key, r.slots[0]) for r in own if r.slots)
        assert [x[1] for x in ranked] == sorted(x[1] for x in ranked)  # a stream goes into the mix in its own order
    first = sorted((slot, r.source, r["size"]) for r in out for slot in r.slots)
    share = {s: sum(n for slot, x, n in first if x == s and slot < 1024) for s in ("s0", "s1", "s2")}
    goal = {r.source: r.target / 2 for r in out}
    assert all(abs(share[s] - goal[s]) < 0.1 * goal[s] + 60 for s in goal)
    kept = mixing.mixed(given, slots=2048)
    assert kept.columns == given.columns and {(r.mix_id, r.mix_copy, r.mix_key) for r in kept.collect()} == {(1, 2, "k")}
    order = [r.doc_id for r in kept.collect()]
    slots = sorted((slot, r.doc_id) for r in out for slot in r.slots)
    assert order == [d for _, d in slots]


def test_schedule_spreads_sources(spark):
    half = mixing.POINTS // 2
    quotas = spark.createDataFrame([(1, 600, 0, half, True), (2, 400, half, mixing.POINTS, True)], "source_no int, n_slots long, low long, high long, small boolean")
    rows = mixing.schedule(spark, quotas, 1024).collect()
    for source, n in ((1, 600), (2, 400)):
        assert sorted(r["rank"] for r in rows if r.source_no == source) == list(range(n))
    first = [r for r in rows if r.slot < 100]
    assert abs(sum(r.source_no == 1 for r in first) - 50) <= 9  # the ranks past 512 are spread among the others
    rows = mixing.schedule(spark, quotas.withColumn("small", F.lit(False)), 1024).collect()
    assert sum(r.source_no == 2 for r in rows) == 400 and abs(sum(r.source_no == 1 for r in rows) - 512) <= 3


def test_mix_odd_tables(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed(empty(spark)).count() == 0
    out = mixing.mix(docs(spark, [None, "", " "])).collect()
    assert [(r["size"], r.taken) for r in out] == [(0, 0)] * 3
    rows = [(1, "a b c", None, "x", None, 1, 1)] * 3 + [(None, "d e", None, "x", None, 1, 1)] * 2
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == int(1.5 * 13)


# --- 6 ---


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = ODD + ["\n".join(rnd.choice(["a", "b ", "c", " d"]) for _ in range(rnd.randrange(1, 14))) for _ in range(80)]
    given = docs(spark, texts)
    out = line_dedup.dedup(given)
    same_columns(out, given, "removed_lines")
    rows = {r.doc_id: r for r in out.collect()}
    for i, (text, n) in enumerate(brute_passages(texts)):
        assert (rows[i].text, rows[i].removed_lines) == (text, n), i
    assert line_dedup.dedup(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "x\ny\nz", None, None, None, 1, 1)] * 2 + [(None, "x\ny\nz", None, None, None, 1, 1)], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup(twice).collect()) == [(0, "x\ny\nz"), (1, ""), (1, "")]


def brute_passages(texts, size=3, long=50):
    """Lines left and removed where runs of fewer lines count too if they have over so many words."""
    places, wins = {}, []
    for i, t in enumerate(texts):
        if not t:
            continue
        ls = [x.strip(" ") for x in t.split("\n")]
        whole = min(len(ls), size)
        for n in range(1, whole + 1):
            for p in range(len(ls) - n + 1):
                w = tuple(ls[p : p + n])
                if n == whole or sum(len(x.split()) for x in w) > long:
                    wins.append((w, i, p))
                    places[w] = min(places.get(w, (i, p)), (i, p))
    gone = [set() for _ in texts]
    for w, i, p in wins:
        if (i, p) > places[w]:
            gone[i].update(range(p, p + len(w)))
    return [("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) if t else (t, 0) for i, t in enumerate(texts)]


def test_line_dedup_finds_long_passages_between_other_lines(spark):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    long, half, other, few = words("a", 60), words("b", 30), words("c", 25), words("d", 20)
    texts = [f"p\n{long}\nq", f"r\n{long} \ns", long, f"t\n{half}\n{other}\nu", f"v\n{half}\n{other}\nw", f"{half}\n{other}", f"x\n{few}\ny", f"z\n{few}\nk", few]
    rnd = random.Random(11)
    texts += ["\n".join(rnd.choice([long, half, other, few, "e", "f"]) for _ in range(rnd.randrange(1, 6))) for _ in range(40)]
    rows = {r.doc_id: r for r in line_dedup.dedup(docs(spark, texts)).collect()}
    assert [rows[i].text for i in range(9)] == [texts[0], "r\ns", "", texts[3], "v\nw", "", *texts[6:9]]
    for i, want in enumerate(brute_passages(texts)):
        assert (rows[i].text, rows[i].removed_lines) == want, i


# --- 7 ---


def toxic_corpus(n, seed):
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("an", "th", "er", "on") for b in ("in", "ea", "or") for c in ("ed", "es", "ing", "ly", "nt")]
    texts, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(20, 160))]
        if bad := i % 4 == 0:
            for _ in range(6):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "scum,", "Moron", "scumb", "idiotic"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def network():
    return toxicity.train(*toxic_corpus(300, 1))


def test_toxicity_learns(network):
    texts, labels = toxic_corpus(200, 2)
    found = toxicity.Scorer(network).scores(texts) >= 0.5
    y = np.array(labels, bool)
    assert found[y].mean() > 0.9 and found[~y].mean() < 0.1


def test_toxicity_reads_whole_texts(spark, network):
    clean = " ".join(toxic_corpus(40, 3)[0][1::4])
    texts = [clean * 20 + " idiot scum moron idiot scum moron", clean * 20, *ODD]
    given = docs(spark, texts)
    out = toxicity.score(given, network)
    same_columns(out, given, "toxic_score")
    s = {r.doc_id: r.toxic_score for r in out.collect()}
    assert s[0] > s[1] and s[0] >= 0.5 and all(0 <= x <= 1 for x in s.values())
    assert all(s[i + 2] <= 0.05 for i in range(4))
    assert toxicity.score(empty(spark), network).count() == 0


def test_toxicity_fit(spark):
    texts, y = toxic_corpus(120, 4)
    given = docs(spark, texts)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.fit(given, labels, rows=(80, 40))
    assert toxicity.fit(given, labels, rows=(80, 40)).c == net.c
    none = toxicity.fit(given, labels.where("toxic > 5"))
    assert [r.toxic_score < 0.5 for r in toxicity.score(given.limit(2), none).collect()] == [True, True]


def test_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    features = toxicity.word_features(["alpha", "beta", "gamma", "a"])
    index, y, w = np.array([[1, 2, 3, 0], [4, 1, 0, 0], [2, 2, 3, 1]]), np.array([1.0, 0.0, 1.0]), np.ones(3)
    grads = net.gradients(features, index, y, w)

    def loss():
        projected = np.concatenate([np.zeros((1, 6 * toxicity.HIDDEN)), (lambda x: np.concatenate([x @ net.p["xf"] + net.p["cf"], x @ net.p["xb"] + net.p["cb"]], axis=1))(net.inputs(features))])
        z = net.forward(projected[index.T], (index.T > 0).astype(float))
        return np.mean(np.logaddexp(0, z) - y * z)

    for k, g in grads.items():
        flat = np.abs(g).ravel().argsort()[::-1][:2]
        for i in flat:
            at = np.unravel_index(i, g.shape)
            old = net.p[k][at]
            net.p[k][at] = old + 1e-3
            up = loss()
            net.p[k][at] = old - 1e-3
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 + 0.05 * abs(g[at]), k


# --- 8 ---


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.replace("license", "licence").upper(), "text\nReleased under the MIT license\nmore", "Licensed under CC-BY-NC 4.0", mit + " and more", *ODD]
    given = docs(spark, texts)
    out = licenses.scan(given)
    same_columns(out, given, "license", "notices")
    rows = {r.doc_id: (r.license, r.notices) for r in out.collect()}
    assert rows[0][0] == rows[1][0] == "MIT" and rows[2] == (None, "MIT") and rows[3] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0") and rows[4][0] is None
    assert all(rows[i] == (None, "") for i in range(5, len(texts)))
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_in_blocks(spark, monkeypatch):
    """A license of several lines within a document, between blank lines or comment marks, and texts as tables."""
    mit = licenses.KNOWN[2][1]
    wrapped = [mit[k : k + 60] for k in range(0, len(mit), 60)]
    wrapped = "\n".join(" ".join(mit.split()[k : k + 9]) for k in range(0, len(mit.split()), 9))
    commented = "#!/bin/sh\n#\n# " + wrapped.replace("\n", "\n# ") + "\n#\nexit 0"
    texts = ["intro\n\n" + wrapped + "\n\nmore", commented, "x " + wrapped]
    extra = spark.createDataFrame([(i, t, "a", "b") for i, t in [*enumerate(texts), (0, texts[0]), (None, texts[1])]], "doc_id long, text string, license string, Notices string")
    for most in (licenses.BROADCAST, 0):
        monkeypatch.setattr(licenses, "BROADCAST", most)
        rows = sorted(((r.doc_id, r.license, r.notices) for r in licenses.scan(extra).collect()), key=repr)
        assert rows == sorted([(0, None, "MIT"), (0, None, "MIT"), (1, None, "MIT"), (2, None, ""), (None, None, "MIT")], key=repr)
    table = spark.createDataFrame([("Own", "Take it and leave")], "license string, text string")
    assert [r.license for r in licenses.scan(docs(spark, ["take, it AND leave!"]), table).collect()] == ["Own"]


def test_full_standard_licenses(spark):
    import pathlib

    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "CC0-1.0": "CC0-1.0"}
    found = [(pathlib.Path("/usr/share/common-licenses") / f, name) for f, name in files.items()]
    if not all(f.exists() for f, _ in found):
        pytest.skip("the standard texts are not on this machine")
    texts = [f.read_text(encoding="utf-8").replace("license", "licence") for f, _ in found]
    assert {r.doc_id: r.license for r in licenses.scan(docs(spark, texts)).collect()} == {i: name for i, (_, name) in enumerate(found)}


# --- 9 ---


def test_language(spark):
    rnd = random.Random(1)
    parts = {"aa": ["the", "ing", "and", "tion"], "bb": ["der", "ung", "sch", "ich"], "cc": ["los", "ado", "que", "ción"]}
    texts, langs = [], []
    for i in range(150):
        lang = ("aa", "bb", "cc")[i % 3]
        texts.append(" ".join(rnd.choice(parts[lang]) + rnd.choice(parts[lang]) for _ in range(40)))
        langs.append(lang if i % 10 else None)
    given = docs(spark, texts, lang=langs)
    coder = language.fit(given, rows=30)
    out = language.identify(given, coder)
    same_columns(out, given, "lang_pred", "score", "ambiguous")
    assert sum(r.lang_pred == ("aa", "bb", "cc")[r.doc_id % 3] for r in out.collect()) >= 148
    odd = {r.doc_id: r for r in language.identify(docs(spark, ["12 34", *ODD]), coder).collect()}
    assert all((odd[i].lang_pred, odd[i].score) == ("und", 0.0) for i in range(5))
    assert all(r.lang_pred in ("aa", "bb", "cc") for i, r in odd.items() if i > 4)
    nothing = language.fit(given.where("lang = 'zz'"))
    assert {r.lang_pred for r in language.identify(given, nothing).collect()} == {"und"}
    assert language.identify(empty(spark), coder).count() == 0


def test_codewords_lie_apart():
    words = language.codewords(6)
    assert min((words[i] != words[j]).sum() for i in range(6) for j in range(i)) >= 8


# --- 10 ---


def test_wavelet_matrix():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 8, 511, 512, 1025):
        a = rnd.choice([0, 3, 50256, 70000], n).astype(np.uint32)
        w = token_files.WaveletMatrix.load(token_files.WaveletMatrix.build(a).dump())
        assert (w.tokens() == a).all() and [w.access(i) for i in range(n)] == a.tolist()
        for v in (0, 3, 50256, 70000, 5, -1):
            assert w.occurrences(v) == np.flatnonzero(a == v).tolist()
            assert w.rank(v, n // 2) == int((a[: n // 2] == v).sum())
    with pytest.raises(IndexError):
        w.access(n)
    with pytest.raises(ValueError):
        token_files.WaveletMatrix.load(b"nothing here")
    with pytest.raises(ValueError):
        token_files.Shard.load(b"nothing here")


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 300)
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("ab éΣ 1\n中.,  <|endoftext|>") for _ in range(rnd.randrange(80))) for _ in range(120)]
    rnd.shuffle(texts)
    path = common.new_path(spark, "test-shards")
    token_files.write(docs(spark, texts).repartition(3), BYTES, path, end_id=0)
    out = {r.doc_id: r for r in token_files.read(spark, path).collect()}
    lib, start = T.Tokenizer.from_file(BYTES), 0
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)
    every = [(i, k, t) for i, x in enumerate(texts) for k, t in enumerate(lib.encode(x or "", add_special_tokens=False).ids + [0])]
    assert sorted((r.doc_id, r.place, r.position) for r in token_files.locate(spark, path, 0).collect()) == [(i, k, p) for p, (i, k, t) in enumerate(every) if t == 0]
    some = [0, 220, 50256, 49999, 70000]
    assert {r.token: r.n for r in token_files.count(spark, path, some).collect()} == {s: sum(t == s for _, _, t in every) for s in some}
    path = common.new_path(spark, "test-shards")
    token_files.write(empty(spark), BYTES, path)
    assert token_files.read(spark, path).count() == 0
    path = common.new_path(spark, "test-shards")
    token_files.write(spark.createDataFrame([(2, "b"), (2, "a"), (None, "n"), (2, "a")], "doc_id long, text string"), BYTES, path)
    assert [(r.doc_id, r.start) for r in token_files.read(spark, path).orderBy("start").collect()] == [(None, 0), (2, 2), (2, 4), (2, 6)]


def test_language_equals_brute_force(spark):
    """Counts, margins, losses and decoding in plain loops."""
    import math

    docs = [("der hund und die katze gehen", "de"), ("the dog and the cat are going", "en"), ("le chien et le chat vont", "fr")]
    learnt = language.train(language.counts([t for t, _ in docs] * 4), [n for _, n in docs] * 4)
    texts = ["der Hund", "the cat and", "chien", "x", "Ünïcode 47 über", None, "", "12 34", "le chat und the dog " * 300]

    def features(text):
        raw, mask = (" " + text.lower() + " ").encode(), (1 << 32) - 1
        out = [0] * language.FEATURES
        for n in language.ORDERS:
            for i in range(len(raw) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h * 0x01000193 & mask) ^ (raw[i + k] + (k + 1) * 257)) * 0x9E3779B1 & mask
                out[h >> 20] += 1
        length = math.sqrt(sum(out))
        return [math.sqrt(c) / length for c in out]

    def decode(text):
        x = features(text)
        used = [i for i, v in enumerate(x) if v]
        margins = [sum(x[i] * float(learnt.weights[i, b]) for i in used) + float(learnt.bias[b]) for b in range(language.BITS)]
        loss = [sum(t * math.log1p(math.exp(-m * w)) for m, w, t in zip(margins, word, learnt.trust)) for word in learnt.words]
        p = [math.exp(min(loss) - v) for v in loss]
        best = p.index(max(p))
        second = sorted(p)[-2]
        return learnt.languages[best], p[best] / sum(p), (p[best] - second) / sum(p) < language.AMBIGUOUS

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in language.identify(rows, learnt).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, False)
            continue
        name, score, flag = decode(t)
        assert got[i].lang_pred == name and got[i].ambiguous == flag
        assert abs(got[i].score - score) < 1e-4


def test_pieces_equal_the_library():
    """Texts in batches of 64 with white space of all kinds first, last and between, after tasks of others."""
    from tokenizers import Tokenizer

    with open(BYTES, encoding="utf-8") as f:
        spec = f.read()
    coder, lib, rng = token_files.PieceEncoder(spec), Tokenizer.from_str(spec), random.Random(3)
    spaces = [" ", "\n", "\n\n", "\t", "\r\n", " \n", " ", "　", "\x1c", "\x85", "", "  ", "\n\n\n", " ", "\x0b"]
    words = ["Plain", "words", "here", "Title", "of", "text", "don't", "x1", "é", "9", "...", "日本", "a\tb"]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(["Plain words here", "\n\nTitle of text"])] == [lib.encode(t, add_special_tokens=False).ids for t in ("Plain words here", "\n\nTitle of text")]
    for n in range(60):
        texts = [rng.choice(spaces) + "".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.randrange(6))) for _ in range(64)]
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        if n % 7 == 0:
            coder.forget()


def test_toxicity_is_trained_on_an_executor(spark, monkeypatch):
    texts, labels = toxic_corpus(60, 5)
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    want = toxicity.train(texts, labels)
    net = toxicity.fit(given, marks)
    assert np.allclose((net.a, net.c), (want.a, want.c), rtol=1e-3)

    def train(texts, labels):
        net = toxicity.Network()
        net.name = os.getpid()
        return net

    monkeypatch.setattr(toxicity, "train", train)
    assert toxicity.fit(given, marks).name != os.getpid()  # this process is the driver, whose memory the sample must not fill


def test_toxicity_windows_and_features_in_parts(monkeypatch):
    texts, _ = toxic_corpus(50, 6)
    words, numbers, counts = toxicity._numbered([*texts, "", "a b"])
    places, first = toxicity.windows(counts)
    monkeypatch.setattr(toxicity, "TEXTS_AT_ONCE", 7)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 11)
    index, before = toxicity._indexed(numbers, counts)
    assert (before == first).all() and (index == np.concatenate([[0], numbers])[places]).all()
    for a, b in zip(toxicity._features(words), toxicity.word_features(words)):
        assert (a == b).all()


def test_planes_cost_less_than_masks():
    import time

    now = np.random.default_rng(0).integers(0, 30_000, 1 << 20).astype(np.uint16)
    bit = (now & 256) != 0

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    masks = least(lambda: [(now[~bit], now[bit]) for _ in range(15)])  # as many planes
    matrix = token_files.WaveletMatrix.build(now)
    assert len(matrix.planes) == 15 and (matrix.tokens() == now).all()
    assert least(lambda: token_files.WaveletMatrix.build(now)) < 0.8 * masks
    assert least(matrix.tokens) < 0.8 * masks
