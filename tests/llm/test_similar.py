"""Near copies at the contracted similarity against brute force."""

import random

import pytest

from wicker.llm import simhash


def prose(r, n):
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


def shingles(words, k=5):
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(r, words, low, high):
    """A copy whose similarity lies between the two."""
    out = list(words)
    while similarity(words, out) >= high:
        out[r.randrange(len(out))] = prose(r, 1)[0]
    return out if similarity(words, out) >= low else edited(r, words, low, high)


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


def kept(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in simhash.deduplicated(docs).collect()}


@pytest.mark.parametrize("band", [(0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 0.95)])
def test_every_isolated_copy_is_found(spark, band):
    r = random.Random(band[0])
    texts = [prose(r, r.randint(60, 300)) for _ in range(60)]
    texts += [edited(r, t, *band) for t in texts]
    assert kept(spark, texts) == set(range(60))


def test_first_shared_shingle_is_among_the_rarest():
    r = random.Random(3)
    np = simhash.np
    for _ in range(500):
        n = r.randint(1, 60)
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        for b in (a[: r.randint(-(-4 * len(a) // 5), len(a))], np.union1d(a, np.array([r.getrandbits(64) for _ in range(len(a) // 4)], np.uint64))):
            if 5 * len(b) < 4 * len(a) or not len(b):
                continue
            known = np.unique(r.sample(list(a), len(a) // 2)).astype(np.uint64)
            common = known, np.array(r.sample(range(1, len(known) + 1), len(known)), np.int64)
            assert set(simhash.rarest(a, 0.8, common).tolist()) & set(simhash.rarest(b, 0.8, common).tolist())


@pytest.mark.parametrize("together", [1000, 7])
def test_crowded_postings_lose_nothing(spark, monkeypatch, together):
    """Short versions meet in one posting of their template only, with many that are not alike."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    r = random.Random(5)
    texts = []
    for _ in range(30):
        template = prose(r, 12)
        for _ in range(12):
            one = template + prose(r, 1)
            texts += [one, one + prose(r, 1)] if r.random() < 0.4 else [template + prose(r, 2), template[:-1] + prose(r, 2)]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]
    assert kept(spark, texts) == groups(range(len(texts)), links)
