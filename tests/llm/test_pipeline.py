"""The pipeline's stages against brute force on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from wicker.llm import quality, simhash
from wicker.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = prose(r, 1)
    return " ".join(words)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def corpus():
    r = random.Random(12)
    texts = [prose(r, r.randint(60, 400)) for _ in range(150)]
    near = [edited(r, t, max(1, len(t.split()) // 150)) for t in texts[:80]]
    some = [edited(r, t, len(t.split()) // 12) for t in texts[80:110]]
    hot = [edited(r, texts[140], 1) for _ in range(120)]
    every = texts + texts[:40] + near + some + hot + ["", "", "one two", None, "a " * 200, "§ " * 90]
    return [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(every)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 11 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_quality_stage_keeps_what_the_query_keeps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    assert kept.columns == docs.columns
    judged = quality.judge(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged.filter("kept").collect()}
    assert {r["doc_id"]: r["text"] for r in kept.collect()}.items() <= {r[0]: r[1] for r in corpus()}.items()


@pytest.mark.parametrize("together", [1000, 40])
def test_near_duplicate_stage(spark, folder, monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r[0]: r[1] for r in corpus()}
    kept = {r["doc_id"]: r for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert all(kept[i]["text"] == rows[i] and kept[i]["lang"] == ["en", "fr", None][i % 3] for i in kept)
    ids = sorted(rows)
    links = {(a, b): similarity(rows[a], rows[b]) for n, a in enumerate(ids) for b in ids[n + 1 :] if (shingles(rows[a]) & shingles(rows[b])) or not (shingles(rows[a]) or shingles(rows[b]))}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), s in links.items():
        if s >= 0.8 or rows[a] == rows[b] or not (shingles(rows[a]) or shingles(rows[b])):
            up[max(find(a), find(b))] = min(find(a), find(b))
    groups = Counter(find(i) for i in ids)
    assert {find(i) for i in kept} == set(groups)  # one of each group stays at least: nothing clean goes
    assert min(groups) in kept and len(kept) <= 1.03 * len(groups)  # and hardly a second one
    texts = [t for t in (kept[i]["text"] for i in kept) if t]
    assert len(texts) == len(set(texts))  # no exact copy


def test_run(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    wanted = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect())
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == wanted and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
