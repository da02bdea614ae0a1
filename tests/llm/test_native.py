"""Sharding, mixing and quality rules against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from wicker.llm import mixing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _piece string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], DOCS)


ROWS = [
    (5, "one two three", "en", "b"),
    (1, "", "en", "a"),
    (2, None, None, None),
    (3, "x " * 300, "en", "a"),
    (3, "x " * 300, "en", "a"),
    (None, "null id here", "fr", "c"),
    (9, "ünï cödé nbsp \x0b tab\tx", "de", "b"),
    (7, "long " * 20_000, "en", "a"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_shards(spark, rows):
    out = sharding.shard_by_bytes(table(spark, rows), 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    whole, at = sum(size(r[1]) for r in rows), 0
    wanted = []
    for i, s, _ in sorted(((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows), key=lambda r: (r[0] is not None, r)):
        wanted.append((i, min(7, (2 * at + s) * 8 // (2 * whole))))
        at += s
    assert sorted(((r["doc_id"], r["shard"]) for r in out), key=str) == sorted(wanted, key=str)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_targets_are_reshared(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 50), ("d", 4000), (None, 0), ("é", 700), ("z", 10)]
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    cap, left, wanted = {s: 2.0 * n for s, n in sizes}, 1.5 * sum(n for _, n in sizes), {}
    open_ = set(cap)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap[s]}
        for s in over or open_:
            wanted[s] = min(cap[s], level * weight[s])
            left -= wanted[s]
        open_ -= over or open_
    assert found == pytest.approx(wanted)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    mask, half = mixing.masks(F.lit(n).cast("long"))
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mask, half, F.lit(3))).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert sum(abs(a - b) for a, b in zip(got, got[1:])) > n * n / 6  # far from the identity


def test_mix(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(40 + i % 90)), "en", "abc"[min(i % 7, 2)]) for i in range(400)] + [(1000, None, "en", None), (1001, "", "en", "a"), (3, "same text " * 30, "en", "a"), (3, "same text " * 30, "en", "a")]
    docs = table(spark, rows)
    out = mixing.plan(docs, block_words=8, shard_slots=64).collect()
    assert Counter((r["id"], r["size"], r["source"]) for r in out) == Counter((r[0], len(WORD.findall(r[1] or "")), r[3]) for r in rows)
    got, target = defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(p["words"] * p["times"] for p in r["pieces"]) and r["size"] == sum(p["words"] for p in r["pieces"])
        got[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(got[s] - target[s]) <= 16 for s in target)
    again = mixing.plan(docs.repartition(3), block_words=8, shard_slots=64).collect()
    key = lambda r: (r["id"], r["source"] or "", r["row_hash"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    texts = mixing.mix(docs, block_words=8, shard_slots=64).collect()
    assert sum(len(WORD.findall(r["text"])) for r in texts) == sum(r["taken"] for r in out)
    assert all(r["n_chars"] == len(r["text"]) for r in texts) and texts[0].asDict().keys() == dict(zip(docs.columns, docs.columns)).keys()
    whole = Counter((r["doc_id"], r["text"]) for r in texts)
    by_id = {r["id"]: r for r in out}
    for r in rows[:400]:
        if all(p["times"] == 2 for p in by_id[r[0]]["pieces"]):
            assert whole[r[0], r[1]] == 2
    assert mixing.plan(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0


def brute_features(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {i + d for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for d in range(3)}
    n, rep = len(ws), len(hit)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n)


def test_features(spark):
    rows = [*ROWS, (20, "a b c a b c d\na b c\n\n \na b c\n# * |", "en", "s"), (21, "a a a a a", "en", "s"), (22, "one\r\ntwo\r\none\r\n", "en", "s"), (23, " ".join("abcdefgh"[(i * i) % 7] for i in range(500)), None, "s")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(table(spark, rows), labels).collect()
    wanted = Counter((r[0], *brute_features(r[1])) for r in rows)
    assert Counter((r["doc_id"], *(r[c] for c in quality.BASE), r["base_failed"]) for r in out) == wanted
    assert all(r["kept"] == (not r["base_failed"]) for r in out)  # no labels, no cutoffs
    assert quality.judge(table(spark, []), labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 100, 0.01), (3, 1000, 0.01), (90, 10_000, 0.01), (40, 10_000, 0.005), (9_000, 1_000_000, 0.01), (12, 1000, 0.01)]
    from pyspark.sql import functions as F

    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        assert got == pytest.approx(1.0 if k >= n * p else sum(map(math.exp, log)), rel=1e-6)


def test_cutoffs_hold_the_risk(spark):
    """Junk goes, and of the good rows no more than the risk, in each stratum with labels enough."""
    good = [(i, f"w{i} " + " ".join(f"t{(i * 7 + j) % 997}q{j}" for j in range(60 + i % 9)) + (" #" if i % 400 == 0 else ""), "en", "s") for i in range(4000)]
    junk = [(10_000 + i, " ".join(f"t{i}{j}##%%" for j in range(70)), "en", "s") for i in range(300)]
    few = [(20_000 + i, " ".join(f"u{i}{j}##%%" for j in range(70)), "xx", "s") for i in range(30)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk] + [(r[0], 1, 0) for r in few] + [(0, 1, 0), (None, 1, 0), (77, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judge(table(spark, good + junk + few), labels).collect()}
    assert not any(out[r[0]]["kept"] for r in junk) and out[10_000]["failed_rules"][0] == "symbols"
    assert sum(not out[r[0]]["kept"] for r in good) <= 0.02 * len(good)
    assert all(out[r[0]]["kept"] for r in few)


def hashed(*values):
    """Spark's hash of (value, bytes) in a row, signed."""
    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain_permuted(x, n, rank, around, seed=7):
    bits = n.bit_length() - 1
    mask, half = (1 << bits) - 1, max(1, (bits + 1) // 2)
    for r in range(0, 12, 3):
        a, b, c = (hashed((seed, 4), (rank, 4), (around, 8), (r + i, 4)) for i in range(3))
        if x <= mask:
            y = (x * (a & mask | 1) + (b & mask)) & mask
            x = y ^ (y >> half)
        x = (x + c % n) % n
    return x


def plain_targets(sizes):
    """Weights 5, 2, 1 in turn; what is over twice a size is shared again."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_mix_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(r.choice([0, 1, 5, 30, 200]))), "en", r.choice(["a", "a", "a", "b", "ü", "c", None])) for i in range(120)]
    block, out = 8, {x["id"]: x for x in mixing.plan(table(spark, rows), block_words=8, shard_slots=16).collect()}
    order = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [x for x in rows if x[3] == s] for s in order}
    sizes = {s: sum(len(x[1].split()) for x in own[s]) for s in order}
    targets = plain_targets(sizes)
    for rank, s in enumerate(order, 1):
        blocks = -(-sizes[s] // block)
        slots = math.floor(targets[s] * blocks / sizes[s] + 0.5)
        times = Counter(plain_permuted(j % blocks, blocks, rank, j // blocks) for j in range(slots))
        start = 0
        for i, text, *_ in own[s]:
            n = len(text.split())
            pieces = []
            for b in range(start // block, (start + n - 1) // block + 1 if n else 0):
                lo, hi = max(b * block, start), min((b + 1) * block, start + n)
                pieces.append((lo - start, hi - lo, times[b]))
            assert out[i]["target"] == pytest.approx(targets[s]) and out[i]["source_size"] == sizes[s]
            assert [tuple(p) for p in out[i]["pieces"]] == pieces and out[i]["taken"] == sum(m * t for _, m, t in pieces)
            start += n


def test_mix_and_chunks_keep_all_columns(spark):
    from wicker.llm import chunks

    names = ["row", "row_hash", "round", "now", "words", "pieces", "doc_id", "text", "source", "n_bytes", "spans"]
    rows = [(*(f"{c}{i}" for c in names[:6]), i, " ".join(f"v{j}" for j in range(40)), "s", "b", "p") for i in range(3)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    mixed = mixing.mix(docs, block_words=4)
    assert mixed.columns == names and all(x["row"] == f"row{x['doc_id']}" and x["row_hash"] == f"row_hash{x['doc_id']}" and x["spans"] == "p" for x in mixed.collect())
    out = chunks.dedup(docs)
    assert out.columns == [c for c in names if c != "n_bytes"] + ["n_bytes", "n_removed", "n_spans", "first_ids", "kept_text"]
    assert sorted((x["doc_id"], x["n_removed"] > 0, x["spans"]) for x in out.collect()) == [(0, False, "p"), (1, True, "p"), (2, True, "p")]
