"""Nearest neighbours, preference pairs, perplexity, chunks and BPE against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wicker.llm import ann, bpe, chunks, perplexity, preference
from wicker.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, id string, list int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)


def brute_nearest(rows, asked, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in [x for x in good if asked(x[0])]:
        scores = sorted((-float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), j) for j, v in good if j != i)
        out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, part int, v string")


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_BLOCK", 150)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[100][1]) for i in range(300)]  # a hot group of copies
    rows += [(3000, None), (3050, [0.0] * 64), (3100, [1.0] * 63 + [None]), (3150, [float("nan")] * 64), (3200, [float("inf")] * 64), (None, rows[3][1]), (3250, [1e-30] * 64), (3300, [1e30] * 64)]
    df = vectors(spark, rows)
    out = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["id"], r["score"]))
    wanted = brute_nearest(rows, lambda i: i % 50 == 0)
    assert out.keys() == wanted.keys()
    hits = sum(len({j for j, _ in out[i]} & {j for j, _ in wanted[i]}) for i in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))
    assert [j for j, _ in out[100]] == [2000, 2001, 2002, 2003, 2004]
    exact = {i: np.array(v, float) for i, v in rows if v and i is not None and None not in v}
    for i, found in out.items():
        for j, s in found:
            assert s == pytest.approx(float(exact[i] @ exact[j] / np.linalg.norm(exact[i]) / np.linalg.norm(exact[j])), abs=1e-12)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_nearest_of_few(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = vectors(spark, rows)
    out = sorted((r["query_id"], r["rank"], r["id"]) for r in ann.search(df, df.filter("vec_id % 50 = 0"), probes=9).collect())
    assert out == [(0, 1, 1), (0, 2, 1), (0, 3, 50), (50, 1, 1), (50, 2, 1), (50, 3, 0)]
    none = vectors(spark, [])
    assert ann.search(none, none).count() == 0 and ann.search(df, none).count() == 0


def test_tiny_and_huge_vectors(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1e-200, 2e-200, 3.1e-200]), (2, [1e200, -2e200, 3e200]), (50, [1e200, 2e200, 2.9e200]), (3, [5e-324, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect()}
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    for q in (0, 50):
        scores = sorted((-float(unit[q] @ unit[j] / np.linalg.norm(unit[q]) / np.linalg.norm(unit[j])), j) for j in unit if j != q)
        assert [out[q, n][0] for n in range(1, 5)] == [j for _, j in scores]
        assert [out[q, n][1] for n in range(1, 5)] == pytest.approx([-s for s, _ in scores], abs=1e-12)


def test_rows_are_abandoned_early():
    rng = np.random.default_rng(1)
    x = ann._unit(rng.standard_normal((3000, 64)))
    x[:40] = ann._unit(x[0] + 0.3 * rng.standard_normal((40, 64)) / 8)
    alive = ann.scan(x[:1], x, 5, np.array([0]), np.arange(3000), np.array([np.inf]))[0]
    true = np.argsort(((x - x[0]) ** 2).sum(axis=1))[1:6]
    assert set(true) <= set(alive) and len(alive) < 100


def test_preference_pairs(spark):
    rows = [
        (1, True, 0, "system", "s"), (1, True, 1, "user", "q"), (1, True, 2, "assistant", "good"),
        (1, False, 0, "system", "s"), (1, False, 1, "user", "q"), (1, False, 2, "assistant", "bad <|end|>"), (1, False, 2, "assistant", "bad <|end|>"), (1, False, 3, "user", "more"),
        (2, True, 5, "user", "a"), (2, True, 9, None, None),
        (2, False, 1, "user", "a"), (2, False, 3, "unknown", ""),
        (3, True, 0, "user", "only one side"),
        (4, True, 0, "user", "x"), (4, True, 1, "assistant", "y"), (4, False, 0, "user", "x"),
        (None, True, 0, "user", "no id"), (5, True, None, "user", "z"), (5, False, 0, "assistant", "w"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, prompt string")
    show = lambda turns: "".join(f"<|{r}|>\n{t.replace('<|', '< |')}<|end|>\n" for r, t in turns)
    got = {r["pair_id"]: r for r in preference.format_pairs(df).collect()}
    assert got.keys() == {1, 2, 3, 4, 5}
    for i, r in got.items():
        sides = []
        for which in (True, False):
            own = sorted({(x[2] is not None, x[2] or 0, x[3] or "unknown", x[4] or "") for x in rows if x[0] == i and x[1] is which})
            sides.append([x[2:] for x in own])
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, show(sides[0][:n]), show(sides[0][n:]), show(sides[1][n:]))
        for side, text, mask in ((sides[0], r["chosen"], r["chosen_mask"]), (sides[1], r["rejected"], r["rejected_mask"])):
            assert [text[m["from"] : m["to"]] for m in mask] == [t.replace("<|", "< |") + "<|end|>" for who, t in side[n:] if who == "assistant"]
    assert preference.format_pairs(df.limit(0)).count() == 0


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by its definition: a function from a gram to a probability."""
    counts = Counter()
    for t in texts:
        x = " " * (order - 1) + t
        counts.update(x[i : i + order] for i in range(len(t)))
    tables = [counts]
    for _ in range(order - 1):
        tables.insert(0, Counter(g[1:] for g in tables[0]))
    known, own = [], []
    for t in tables:
        n = [0, *(sum(v == k for v in t.values()) for k in range(1, 5))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        known.append([0, *(min(max(k - (k + 1) * y * n[k + 1] / max(n[k], 1), 0.1), k - 0.1) for k in (1, 2, 3))])
        after = {}
        for g, c in t.items():
            after.setdefault(g[:-1], []).append(c)
        own.append(after)

    def p(gram):
        t, d, after = tables[len(gram) - 1], known[len(gram) - 1], own[len(gram) - 1]
        lower = p(gram[1:]) if len(gram) > 1 else 1 / (len(t) + 1)
        if gram[:-1] not in after:
            return lower
        total, freed = sum(after[gram[:-1]]), sum(d[min(c, 3)] for c in after[gram[:-1]])
        return (t[gram] - d[min(t[gram], 3)] if gram in t else 0) / total + freed / total * lower

    return p


def plain_perplexity(p, text, order):
    x = " " * (order - 1) + text
    return math.exp(-sum(math.log(max(p(x[i : i + order]), perplexity.LEAST)) for i in range(len(text))) / len(text))


@pytest.mark.parametrize(("shard", "order"), [(1 << 20, 5), (300, 3)])
def test_perplexity_threshold_and_verdict(spark, monkeypatch, shard, order):
    monkeypatch.setattr(perplexity, "SHARD", shard)
    monkeypatch.setattr(perplexity, "BLOCK", 50)
    r = random.Random(8)
    words = {"en": ["the", "ing", "on re", "ed", "a"], "zh": ["字 母", "中文", "的", "一", "好"], "ru": ["это", "не", "что", "да ", "и"]}
    rows = [(i, "".join(r.choices(words[lang], k=r.randint(1, 60))), lang) for i, lang in enumerate(["en", "zh", "ru"] * 25)]
    rows += [(200, "zzqq 12", "en"), (201, "母母母母字", "zh"), (202, "ненеенен", "ru"), (203, "x", "xx"), (204, None, "en"), (204, "", "en"), (7, rows[7][1], rows[7][2]), (None, "the null", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60)] + [(3, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = Counter((x["id"], x["lang"], x["n_chars"], round(x["perplexity"] or 0, 6), round(x["threshold"] or 0, 6), x["kept"]) for x in perplexity.classify(table(spark, rows), labels, order=order).collect())
    trusted = set(range(60)) - {3, 4}
    fold = {x["i"]: x["f"] for x in spark.range(60).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(perplexity.FOLDS)) + 1).alias("f")).collect()}
    wanted, values = [], {}
    models = {(m, lang): kneser_ney([t for i, t, own in rows if own == lang and i in trusted and fold[i] != m], order) for m in range(perplexity.FOLDS + 1) for lang in words}
    for i, t, lang in rows:
        m = fold[i] if i in trusted else 0
        value = plain_perplexity(models[m, lang], t, order) if t and lang in words else 0
        values.setdefault(lang, []).extend([value] if i in trusted else [])
        wanted.append((i, lang, len(t or ""), value))
    limit = {lang: sorted(v)[math.ceil(0.99 * len(v)) - 1] for lang, v in values.items() if v}
    assert out == Counter((i, lang, n, round(v, 6), round(limit.get(lang, 0), 6), n > 0 and (lang not in limit or v <= limit[lang])) for i, lang, n, v in wanted)
    assert not next(x[5] for x in out if x[0] == 201) and limit.keys() == words.keys()  # other scripts are judged too


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([([0], "en", f"some plain words number {i} and a few more, {'ab' * i}") for i in range(30)], "models array<long>, lang string, text string")
    texts = [x["text"] for x in docs.collect()]
    got = {x["gram"]: x["value"] for x in perplexity.model(docs, 4).filter("kind = 'p'").collect()}
    p, letters = kneser_ney(texts, 4), sorted(set("".join(texts)) | {" "})
    for g, value in [*got.items()][::5]:
        assert value == pytest.approx(p(g), rel=1e-9)
    for context in ("ome", "  s", "zzz", "aba"):
        assert sum(p(context + c) for c in letters) + p(context + "?") == pytest.approx(1)


def test_blocks_do_not_matter(monkeypatch):
    text = "Some text, ünïcode 字 and 12 numbers\n" * 9
    whole = np.concatenate(list(perplexity.grams(text)))
    monkeypatch.setattr(perplexity, "BLOCK", 7)
    assert (np.concatenate(list(perplexity.grams(text))) == whole).all() and len(whole) == len(text)


def test_junk_is_held_out(spark):
    r = random.Random(3)
    part = ["ing", "the", "re", "on", "ed", "tion", "ha", "in"]
    clean = lambda: " ".join("".join(r.choices(part, k=r.randint(1, 3))) for _ in range(80)) + "."
    junk = lambda: " ".join("".join(r.choices("zqxj#%&*$kvw", k=6)) for _ in range(80))
    rows = [(i, clean(), "en") for i in range(600)] + [(1000 + i, junk(), "en") for i in range(60)] + [(2000, None, "en"), (2001, "", None), (2002, "no model", None), (2003, "keine", "de")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)] + [(1000 + i, 0, 0) for i in range(30)] + [(5, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    out = {x["id"]: x for x in perplexity.classify(table(spark, rows), labels).collect()}
    assert sum(out[i]["kept"] for i in range(500, 600)) >= 95  # held out
    assert not any(out[1000 + i]["kept"] for i in range(60))
    assert [out[i]["kept"] for i in (2000, 2001, 2002, 2003)] == [False, False, True, True]
    assert perplexity.classify(table(spark, []), labels).count() == 0


def test_chunks_cover_and_resist_shifts():
    r = random.Random(8)
    data = bytes(r.choice(b"abcdefgh ") for _ in range(20_000))
    for x in (data, b"", b"a", b"z" * 5000, data[:23], data[:100]):
        spans = list(chunks.cuts(x))
        assert b"".join(x[a:b] for a, b in spans) == x
        assert all(b - a <= chunks.MOST for a, b in spans) and all(b - a >= chunks.LEAST for a, b in spans[:-1])
    pieces = lambda x: {x[a:b] for a, b in chunks.cuts(x)}
    assert len(pieces(data) - pieces(data[:7000] + b"inserted" + data[7000:])) < 12


def test_chunks_in_blocks(monkeypatch):
    data = random.Random(5).randbytes(5000)
    whole = list(chunks.cuts(data))
    monkeypatch.setattr(chunks, "BLOCK", 333)
    assert list(chunks.cuts(data)) == whole
    h = 0
    for i, b in enumerate(data):
        h = (2 * h + int(chunks._GEAR[b])) % (1 << 32)
        assert i or h == chunks.gear(np.frombuffer(data, np.uint8))[0]
    assert h == chunks.gear(np.frombuffer(data, np.uint8))[-1]


def test_chunk_dedup(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(80) + (" " + passage + " " if i % 3 == 0 else "") + prose(30), "en") for i in range(30)]
    rows += [(100, rows[4][1], "en"), (101, None, "en"), (102, "", "en"), (None, rows[5][1], "en"), (7, rows[7][1], "en")]
    first, owner = {}, {}
    key = lambda i, t: (i is not None, i or 0, t)  # noqa: E731  nulls first
    for i, t, _ in sorted(set(rows), key=lambda x: key(x[0], 0)):
        data = (t or "").encode()
        for a, b in chunks.cuts(data):
            if b - a >= chunks.LEAST and data[a:b] not in first:
                first[data[a:b]], owner[data[a:b]] = (i, a), i
    wanted = Counter()
    for i, t, _ in rows:
        data, gone, ids = (t or "").encode(), bytearray(len((t or "").encode())), set()
        for a, b in chunks.cuts(data):
            if b - a >= chunks.LEAST and first[data[a:b]] != (i, a):
                gone[a:b] = b"\1" * (b - a)
                ids.add(owner[data[a:b]])
        kept = bytes(x for x, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        wanted[i, len(data), sum(gone), kept, str(sorted(x for x in ids if x is not None))] += 1
    out = chunks.dedup(table(spark, rows)).collect()
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["kept_text"], str(x["first_ids"])) for x in out) == wanted
    lost = {x["doc_id"]: x["n_removed"] for x in out}
    assert all(lost[i] > 150 for i in range(3, 30, 3)) and not any(lost[i] for i in range(30) if i % 3 and i != 5)
    assert chunks.dedup(table(spark, [])).count() == 0


@pytest.fixture(scope="module")
def merges():
    return bpe.load(bpe.definition_at(tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(merges, library, text, block=bpe.BLOCK):
    wanted = library.encode(text, add_special_tokens=False).ids
    ids = b"".join(bpe.encode(merges, text, block))
    assert np.frombuffer(ids, "<u4").tolist() == wanted, (text[:80], block)
    assert "".join(bpe.decode(merges, (ids[i : i + 12] for i in range(0, len(ids), 12)))) == library.decode(wanted, skip_special_tokens=False)


def test_bpe_like_the_library(merges, library):
    r = random.Random(1)
    parts = ["a", "b", "'", "re", "ve", "s", " ", "  ", "\n", "1", "é", "字", "😀", "%$", "<|endoftext|>", "<|end", "　", "the", " the", "ll", "ing", "\x00", "ſ", "²", "Ⅷ", "́", "\x85"]
    for _ in range(600):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        check(merges, library, text)
        check(merges, library, text, r.choice([1, 2, 3, 5, 9]))


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 2000, "%" * 3000, "1" * 2000, "x" + " " * 999, "the" * 2000 + " a", "é" * 2500, "aaaaabaaab" * 500])
def test_bpe_long_pieces(merges, library, text):
    for block in (37, 64, 1000):
        check(merges, library, text, block)
        check(merges, library, " " + text + "\n" + text, block)


def test_lookahead_suffices(merges):
    """Tokens that are sure do not change, whatever follows."""
    r = random.Random(7)
    for _ in range(30):
        data = "".join(r.choice(["the", "ing", "er", "a", "aa", "tion", "s"]) for _ in range(1500)).encode()
        sure, rest = merges.stable(data)
        assert len(rest) >= merges.lookahead or not sure
        for more in (b"", b"ing", b"zzzz", data[:300]):
            assert merges.merge(data + more)[: len(sure)] == sure


def test_bpe_streams(merges, library, monkeypatch):
    """At the block of the query: text leaves block by block, long pieces through the lookahead, and little is held."""
    calls, held = [], []
    stable, feed = bpe.Merges.stable, bpe.Encoder.feed
    monkeypatch.setattr(bpe.Merges, "stable", lambda self, data: calls.append(len(data)) or stable(self, data))

    def watched(self, text, last=False):
        yield from feed(self, text, last)
        held.append(len(self.text) + len(self.open or b""))

    monkeypatch.setattr(bpe.Encoder, "feed", watched)
    check(merges, library, "some plain words and " * 3000)
    assert len(held) > 10 and max(held) < 50 and not calls
    held.clear()
    check(merges, library, "ab" * 30_000 + " end")
    assert len(calls) > 10 and max(calls) <= 2 * bpe.BLOCK + merges.lookahead and max(held) <= bpe.BLOCK + merges.lookahead + 2 * max(map(len, merges.bytes_of.values()))


def test_bpe_queries(spark, library):
    rows = [(1, "Hello wörld", "en"), (2, None, "en"), (3, "", "en"), (None, "x<|endoftext|>y", "en"), (1, "Hello wörld", "en"), (4, "long " * 50_000 + "é" * 70_000, "en")]
    docs = table(spark, rows)
    wanted = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        wanted[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, tokenizer_path()).collect()) == wanted
    encoded = bpe.encode_documents(docs, tokenizer_path())
    texts = bpe.decode_documents(encoded, tokenizer_path()).collect()
    assert Counter(tuple(r) for r in texts) == Counter((i, t or "") for i, t, _ in rows)
    assert bpe.round_trip(table(spark, []), tokenizer_path()).count() == 0
