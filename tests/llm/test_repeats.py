"""Suffix arrays, repeated strings and near duplicates against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from wicker.llm import repeats, simhash
from wicker.llm.common import components
from wicker.llm.suffix_array import common_prefixes, suffix_array

DOCS = "doc_id long, text string, d1 string, key int, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, None) for r in rows], DOCS)


def test_suffix_array():
    r = random.Random(2)
    for _ in range(3000):
        kinds = r.choice([1, 2, 3, 5, 50])
        s = [r.randrange(kinds) for _ in range(r.randint(0, r.choice([5, 12, 40])))]
        order = suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        shared = common_prefixes(s, order)
        for x in range(1, len(s)):
            i, j = order[x - 1], order[x]
            n = shared[x]
            assert s[i : i + n] == s[j : j + n] and s[i + n : i + n + 1] != s[j + n : j + n + 1]


def brute(rows, length):
    """Bytes covered by a string that starts somewhere else too."""
    seen = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed, n, alphabet):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(r.randint(30, 120)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = prose(r.randint(0, 150))
        kind = r.random()
        if kind < 0.5:
            at = r.randint(0, len(t))
            p = r.choice(shared)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            t = t[:at] + (p if r.random() < 0.5 else p[a:b]) + t[at:]
        elif kind < 0.8 and rows:
            t = r.choice(rows)[1] or ""
            if r.random() < 0.7 and t:
                at = r.randrange(len(t))
                t = t[:at] + r.choice(["", "X", "new words"]) + t[at + r.randint(0, 3) :]
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("together", [20_000, 2])
def test_remove(spark, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = corpus(3, 60, "abcdefg") + corpus(4, 20, "é字a") + [(100, None), (101, ""), (None, "ab" * 700), (102, "z" * 1500), (103, "z" * 399), (7, "q" * 400), (7, "q" * 400), (104, "ab" * 201)]
    out = repeats.remove(table(spark, rows)).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute(rows, 400)


def test_remove_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    rows = corpus(5, 40, "abcdefg")
    out = repeats.remove(table(spark, rows), length=100).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute(rows, 100)
    texts = {r["doc_id"]: r for r in repeats.cleaned(table(spark, rows), length=100).collect()}
    assert Counter((k, hashlib.sha256(r["text"].encode()).hexdigest()) for k, r in texts.items()) == Counter((k, h) for k, _, _, _, h in brute(rows, 100))
    assert all(r["n_chars"] == len(r["text"]) and r["d1"] == "clash" for r in texts.values())


@pytest.mark.parametrize("together", [20_000, 2])
def test_passages(spark, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = corpus(6, 60, "abcdefg") + corpus(7, 20, "é字a") + [(100, None), (None, "ab" * 90), (101, "z" * 150), (102, "z" * 60), (7, "q" * 100), (7, "q" * 100), *((300 + i, "r" * 70 + "s" * 70) for i in range(20))]
    out = repeats.remove(table(spark, rows), length=100, passage=45).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute(rows, 100)
    assert Counter((r["id"], r["n_bytes"], r["passage_bytes"], r["n_passages"]) for r in out) == Counter(x[:4] for x in brute(rows, 45).elements())


def test_cleaned_keeps_all_columns(spark):
    names = ["row", "left", "spans", "copy", "d1", "text", "doc_id"]
    rows = [("r", "l", "s", 1, "d", "v" * 500, 1), ("r", "l", "s", 2, "d", "v" * 500, 1), ("r", "l", "s", 3, "d", None, None), ("r", "l", "s", 4, "d", "w" * 300, 2)]
    out = repeats.cleaned(spark.createDataFrame(rows, "row string, left string, spans string, copy int, d1 string, text string, doc_id long"))
    assert out.columns == names
    assert sorted(map(tuple, out.collect()), key=lambda x: x[3]) == [(*x[:5], "" if x[3] < 3 else x[5], x[6]) for x in rows]


def test_empty(spark):
    assert repeats.remove(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def plain_fingerprint(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most):
    """prints: (id, fp); gives fp -> set of ids reachable."""
    fps = sorted({p for _, p in prints})
    up = {p: p for p in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                up[find(a)] = find(b)
    ids = defaultdict(list)
    for i, p in prints:
        ids[find(p)].append(i)
    return {p: min((i for i in ids[find(p)] if i is not None), default=None) for p in fps}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 16)
    rows = corpus(9, 150, "abc") + [(500, None), (501, " \t\n"), (502, "One"), (503, "ONE two"), (503, "one TWO"), (None, "null id"), (504, "Éa É b"), (505, "a\x85b c d e f")]
    # Chains of small texts, whose fingerprints lie close together.
    rows += [(600 + i, " ".join(["x y z"] * 40 + ["p", "q"][: i % 3] + ["r"] * (i // 3))) for i in range(30)]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    wanted = plain_components(prints, 2)
    out = simhash.near_duplicates(table(spark, rows)).collect()
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in out) == Counter((i, p, wanted[p]) for i, p in prints)


def test_any_positions_are_covered():
    for most in range(4):
        sets = simhash.covering(most)
        assert all(any(set(x) <= set(y) for y in sets) for x in combinations(range(8), most)) and all(len(y) == most + 1 for y in sets)
    assert len(simhash.covering(2)) < 14  # of 28 choices of two


@pytest.mark.parametrize("crowded", [4096, 3])
def test_links_are_complete(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(1)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(40):
            for _ in range(r.randint(1, 3)):
                base ^= 1 << r.randrange(64)
            fps.add(base)
    base = r.getrandbits(64)
    fps |= {base ^ x for x in range(300)}  # a crowded posting
    signed = [p - (1 << 64) if p >> 63 else p for p in fps]
    got = {(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert {frozenset(x) for x in got} == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100 + i) for i in range(30)] + [(7, 7), (300, 300), (8, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in [*range(100, 130), 200]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
