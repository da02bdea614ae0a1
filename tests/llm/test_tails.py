"""Chunks of short tails and short texts."""

import random

from wicker.llm import chunks


def test_an_exact_copy_loses_all_its_bytes(spark):
    r = random.Random(4)
    texts = [" ".join("".join(r.choices("abcdefgé", k=r.randint(2, 8))) for _ in range(r.randint(1, 60))) for _ in range(40)] + ["x", "short text", "y" * 23, "z" * 513, "q" * 530]
    rows = [(100 * copy + i, t) for copy in range(2) for i, t in enumerate(texts)]
    out = {x["doc_id"]: x for x in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[100 + i]["n_removed"] == out[100 + i]["n_bytes"] == len(t.encode()) and out[100 + i]["kept_text"] == "" for i, t in enumerate(texts))


def test_only_whole_texts_are_short():
    r = random.Random(5)
    for n in [*range(1, 60), *range(500, 560), *range(1020, 1080)]:
        for data in (b"z" * n, r.randbytes(n)):
            spans = list(chunks.cuts(data))
            assert b"".join(data[a:b] for a, b in spans) == data
            assert spans == [(0, n)] and n < chunks.LEAST or all(chunks.LEAST <= b - a <= chunks.MOST for a, b in spans)
