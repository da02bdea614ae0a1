"""Repeated runs of an anchor's regions against brute force."""

import random

from wicker.llm import repeats


def brute(regions, length, over_anchor):
    """For each region the places of strings that another has at the same distance from the anchor."""
    out = []
    for k, (r, a) in enumerate(regions):
        places = range(max(0, a - length + 1), min(a, len(r) - length) + 1) if over_anchor else range(len(r) - length + 1)
        starts = [i for i in places if any(j != k and i - a + b >= 0 and s[i - a + b : i - a + b + length] == r[i : i + length] for j, (s, b) in enumerate(regions))]
        out.append({x for i in starts for x in range(i, i + length)})
    return out


def found(regions, length):
    return [{x for i, j in spans for x in range(i, j)} for spans in repeats.repeated_runs(regions, length)]


def test_passage_whose_surroundings_agree_crosswise():
    r = random.Random(1)
    passage = r.randbytes(500)
    around = ((b"c", b"a"), (b"d", b"a"), (b"c", b"b"), (b"d", b"b"))
    regions = [(r.randbytes(9) + before + passage + after + r.randbytes(9), 260) for before, after in around]
    got = found(regions, 400)
    assert got == brute(regions, 400, False) and all(len(x) >= 500 for x in got)


def test_runs_like_brute_force():
    r = random.Random(2)
    side = lambda: bytes(r.choices(b"ab", weights=(4, 1), k=r.randint(0, 8)))
    for _ in range(2000):
        length = r.randint(2, 8)
        regions = [(x, x.index(b"X")) for x in sorted({side() + b"X" + side() for _ in range(r.randint(1, 7))})]
        for least, got, most in zip(brute(regions, length, True), found(regions, length), brute(regions, length, False), strict=True):
            assert least <= got <= most


def test_counted_runs_like_brute_force(spark):
    r = random.Random(5)
    groups = []
    for key in range(25):
        core = bytes(r.choices(b"abc", k=60))
        group = set()
        for _ in range(r.randint(2, 12)):
            a, b = r.randint(0, 20), r.randint(0, 20)
            ahead, after = (bytes(r.choices(b"ab", k=r.randint(0, 20))) for _ in range(2))
            group.add((ahead + core[a : 60 - b] + after, len(ahead) + 30 - a))
        groups.append((key, sorted(group)))
    rows = [(key, n, at, data) for key, group in groups for n, (data, at) in enumerate(group)]
    regions = spark.createDataFrame(rows, "key long, r long, at int, bytes binary")
    for length in (24, 40):
        got = {(x["key"], x["r"]): {p for y in x["runs"] for p in range(y["a"], y["b"])} for x in repeats._counted_runs(regions, length, True).collect()}
        for key, group in groups:
            for n, wanted in enumerate(brute(group, length, False)):
                assert got.get((key, n), set()) == wanted
