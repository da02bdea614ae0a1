"""Pairs that the index over the SimHash's byte positions proposes to the near-duplicate stage."""

import random

from wicker.llm import simhash


def test_groups_by_simhash_have_fewer_pairs_than_nodes(spark):
    r = random.Random(5)
    far = [r.getrandbits(62) for _ in range(50)]
    rows = [(i, x) for i, x in enumerate(far)] + [(100 + i, x ^ (1 << i % 60)) for i, x in enumerate(far)] + [(200 + i, far[0] ^ (1 << i)) for i in range(40)] + [(300, far[1])]
    found = sorted((p["a"], p["b"]) for p in simhash.proposed(spark.createDataFrame(rows, "node long, f0 long")).collect())
    assert found == sorted([(i, 100 + i) for i in range(50)] + [(0, 200 + i) for i in range(40)] + [(1, 300)])


def test_near_copies_go_through_the_index_over_byte_positions(spark, monkeypatch):
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, most: seen.append({r["fp"] for r in prints.collect()}) or links(prints, most))
    r = random.Random(7)
    texts = [[f"w{r.randrange(100_000)}" for _ in range(400)] for _ in range(6)]
    texts += [[*t[:-1], "x"] for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == set(range(6))
    prints = [simhash.wide_fingerprint(simhash.np.unique(simhash.shingle_hashes(" ".join(t), 5)))[0] for t in texts]
    assert len(seen) == 1 and seen[0] == set(prints)
