"""Names, full text, words, signatures and vectors."""

import pytest
from pyspark.sql import functions as F

from wicker import schema
from wicker.functions import minhash, text
from wicker.operators import lexical, semantic, vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "words"), [("parseHTTPRequest", "parse http request"), ("snake_case-name.rs/x", "snake case name rs x"), ("v2Engine", "v2 engine"), ("ABC", "abc"), ("", ""), ("ÄpfelBaum", "Äpfel baum"), ("a1B2c", "a1 b2c")])
def test_camel_split(spark, name, words):
    assert one(spark, text.camel_split(F.lit(name))) == words
    assert lexical.query_terms(name) == words.split()


def test_paths(spark):
    assert one(spark, text.path_join(F.lit("a/"), F.lit(""), F.lit("/b"), F.lit("c.py"))) == "a/b/c.py"
    for path, want in {"a/b.tar.gz": ("b.tar.gz", "a", "gz", "b.tar"), ".env": (".env", "", "", ".env"), "x/y": ("y", "x", "", "y")}.items():
        p = F.lit(path)
        assert tuple(one(spark, f(p)) for f in (text.base_name, text.dir_name, text.extension, text.stem)) == want
    assert one(spark, text.json_escape(F.lit('a"b\n'))) == 'a\\"b\\n'
    assert one(spark, text.valid_shell_argument(F.lit("a b"))) and not one(spark, text.valid_shell_argument(F.lit("a;b")))
    assert not one(spark, text.valid_project(F.lit("..x")))
    assert sorted(one(spark, text.path_segments(F.lit("src/auth.rs::Login::check")))) == ["auth", "login", "rs", "src"]


def content(spark, lines):
    return spark.createDataFrame([("p", f"f{i}.rs", 1, x) for i, x in enumerate(lines)], schema.CONTENT)


def hits(df):
    return [r["rel_path"] for r in df.orderBy("rank").collect()]


def test_bm25_order(spark):
    c = content(spark, ["alpha beta gamma delta", "alpha alpha", "beta only here and there", "nothing at all"])
    assert hits(lexical.search_code(c, "alpha", 10)) == ["f1.rs", "f0.rs"]
    assert hits(lexical.search_code(c, "alpha beta", 10)) == ["f0.rs"]
    assert hits(lexical.search_code(c, "alpha !!!", 10)) == []
    assert lexical.count_content(c, "beta").first()["n"] == 2


def test_phrases(spark):
    c = content(spark, ["foo_bar x", "bar foo", "schön", "foo x bar", "the Foo.Bar call"])
    assert sorted(hits(lexical.search_code(c, "foo.bar", 10))) == ["f0.rs", "f4.rs"]
    assert hits(lexical.search_code(c, "schon", 10)) == ["f2.rs"]
    assert hits(lexical.search_code(c, '"foo.bar"', 10))[0] == "f4.rs"
    ranked = lexical.search_code_ranked(c, "foo", 10).orderBy("rank_score").collect()
    assert ranked[0]["relevance"] == 1.0 and ranked[-1]["relevance"] == 0.0
    assert lexical.search_code_ranked(c, "schon", 10).first()["relevance"] == 1.0


def symbols(spark):
    rows = [(1, "Function", "loadConfig", "src/config.rs::Function::loadConfig", "src/config.rs"), (2, "Struct", "Config", "src/config.rs::Struct::Config", "src/config.rs"), (3, "Function", "saveStore", "src/store.rs::Function::saveStore", "src/store.rs"), (4, "Call", "Config", "src/main.rs::Call::Config", "src/main.rs"), (5, "Module", "config", "src/config.rs::__file__", "src/config.rs")]
    return spark.createDataFrame([(i, "p", label, name, q, f, 1, 9, '{"doc":"reads the file"}' if i == 1 else "{}") for i, label, name, q, f in rows], schema.NODES)


def test_symbol_search(spark):
    n = symbols(spark)
    assert [r["id"] for r in lexical.search_symbols(n, "loadCon", 10).collect()] == [1]
    assert {r["id"] for r in lexical.search_symbols(n, "config", 10).collect()} == {1, 2}
    assert lexical.search_symbols(n, "config", 10, "other").count() == 0 and lexical.search_symbols(n, "--", 10).count() == 0


def test_semantic(spark):
    n = symbols(spark)
    e = spark.createDataFrame([(1, "p", 3, 2, "CALLS", "{}")], schema.EDGES)
    rows = semantic.semantic_query(n, e, "config struct", 10).orderBy("rank").collect()
    assert rows[0]["id"] == 2 and 4 not in {r["id"] for r in rows} and 5 not in {r["id"] for r in rows}
    parts = ["token_overlap", "label_affinity", "file_proximity", "simhash", "qname_path", "edge_proximity"]
    assert all(r["score"] == pytest.approx(sum(r[p] for p in parts), abs=1e-8) for r in rows)
    assert {r["id"]: r["edge_proximity"] for r in rows}[3] == 0.14  # next to the anchor, no word shared
    assert rows[0]["label_affinity"] == 0.15 and not semantic.label_words("configs structs")
    assert {r["id"] for r in semantic.semantic_query_expanded(n, e, "Config", 10).collect()} >= {4, 5}
    related = {r["id"]: (r["score"], r["edge_adjacent"]) for r in semantic.related_symbols(n, e, "Config", 10).collect()}
    anchor = semantic.resolve_anchor(n, ["config"]).first()["id"]  # the lowest qualified name that has no other word
    assert anchor not in related and related.keys() >= {1, 5} - {anchor}
    assert semantic.semantic_query_fielded(n, "file", "doc", 5).first()["id"] == 1
    assert semantic.semantic_query_diversified(n, e, "config", 5, 1).filter("confidence < 0 or confidence > 1").count() == 0
    assert semantic.related_symbols(n, e, "nowhere", 5).count() == 0


def plain_hash(token, seed):
    m = (1 << 64) - 1
    h = minhash.OFFSET ^ (seed * minhash.PRIME & m)
    for b in token.encode():
        h = (h ^ b) * minhash.PRIME & m
    for shift, factor in ((30, minhash.FINISH[0]), (27, minhash.FINISH[1])):
        h = (h ^ (h >> shift)) * factor & m
    return (h ^ (h >> 31)) & 0xFFFFFFFF


def test_minhash(spark):
    words = ["load", "config", "ä"]
    got = one(spark, minhash.signature(F.array(*map(F.lit, words))))
    assert got == [min(plain_hash(w, k) for w in words) for k in range(64)]
    assert one(spark, minhash.is_empty(minhash.signature(F.array().cast("array<string>"))))


def vectors(spark, rows):
    data = [("p", "m", "v", "t", node, chunk, q, "f", "0" * 64, gen, list(map(float, v))) for node, chunk, q, gen, v in rows]
    return spark.createDataFrame(data, "project string, model_id string, prompt_version string, task string, node_id long, chunk_idx long, qualified_name string, file_path string, content_sha256 string, graph_generation long, vector array<float>")


def test_vector_search(spark):
    v = vectors(spark, [(1, 0, "alpha", 2, (1, 0)), (2, 0, "beta", 2, (0.8, 0.6)), (3, 0, "gamma", 2, (0, 1)), (3, 1, "gamma", 2, (0.1, 1)), (9, 0, "old", 1, (0, 1))])
    now = vector.scoped(v, graph_generation=2)
    assert [r["qualified_name"] for r in vector.search(now, [0.0, 1.0], 2).orderBy("rank").collect()] == ["gamma", "beta"]
    assert vector.search(now, [0.0, 1.0], 5, 0.99).count() == 1
    ties = vectors(spark, [(5, 0, "b", 1, (1, 0)), (4, 0, "a", 1, (2, 0))])
    assert [r["node_id"] for r in vector.search(ties, [1.0, 0.0], 2).orderBy("rank").collect()] == [4, 5]
    with pytest.raises(ValueError, match="over the limit"):
        vector.guarded(v, 3)
    with pytest.raises(Exception, match="dimension"):
        vector.validated(v, 3).collect()
    assert vector.validated(v, 2).count() == 5


def test_windows_and_batches():
    out = vector.windows("head", [f"a{i} b c" for i in range(30)], 31)
    assert all(w.startswith("head\n") and len(w.split()) <= 31 for w in out)
    assert {x for w in out for x in w.split("\n")[1:]} == {f"a{i} b c" for i in range(30)}
    assert out[0].split("\n")[-1] == out[1].split("\n")[1]  # windows overlap
    assert vector.windows("h", ["x" * 5000, "ok"], 9) == ["h\nok"]
    lengths = [5, 100, 7, 6, 110, 300, 5]
    groups = list(vector.batches(lengths))
    assert sorted(i for g in groups for i in g) == list(range(7))
    assert all(max(lengths[i] for i in g) <= 1.5 * min(lengths[i] for i in g) for g in groups)
