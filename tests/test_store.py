"""Resolution, extraction, files, freshness, caches, snapshots and evaluation on hand-built cases."""

import hashlib
import json
import os
import textwrap

import pytest
from pyspark.sql import functions as F

from wicker import schema
from wicker.operators import evaluation, extract, resolve, store
from wicker.operators.graphquery import GraphQuery
from wicker.plans.commands import Index
from wicker.sources import files
from wicker.streaming.incremental import Snapshots, follow


def nodes(spark, rows):
    return spark.createDataFrame([(i, "p", label, name, q, f, 1, 9, "{}") for i, label, name, q, f in rows], schema.NODES)


def raw(spark, rows):
    return spark.createDataFrame([("p", f, s, t, kind, json.dumps(p)) for f, s, t, kind, p in rows], schema.RAW_EDGES)


def edges_of(n, r):
    return sorted((x["source_id"], x["target_id"], x["edge_type"]) for x in resolve.resolve(n, r).collect())


CALLER = (1, "Function", "main", "a.rs::Function::main", "a.rs")


@pytest.mark.parametrize(
    ("others", "properties", "target", "found"),
    [
        ([(2, "Function", "go", "b.rs::Function::go", "b.rs")], {"callee_name": "go"}, "", [2]),
        ([(2, "Function", "go", "b.rs::Function::go", "b.rs"), (3, "Function", "go", "c.rs::Function::go", "c.rs")], {"callee_name": "go"}, "", []),
        ([(2, "Function", "go", "b.rs::Function::go", "b.rs"), (3, "Function", "go", "a.rs::Function::go", "a.rs")], {"callee_name": "go"}, "", [3]),
        ([(2, "Method", "go", "b.rs::B::go", "b.rs"), (3, "Method", "go", "b.rs::A::go", "b.rs")], {"callee_name": "go"}, "", [3]),
        ([(2, "Struct", "Go", "b.rs::Struct::Go", "b.rs")], {"callee_name": "Go"}, "", [2]),
        ([(2, "Struct", "go", "b.rs::Struct::go", "b.rs"), (3, "Function", "go", "c.rs::Function::go", "c.rs"), (4, "Function", "go", "d.rs::Function::go", "d.rs")], {"callee_name": "go"}, "", []),
        ([(2, "Function", "go", "b.rs::Function::go", "b.rs"), (3, "Function", "go", "c.rs::Function::go", "c.rs")], {"callee_name": "go"}, "c.rs::Function::go", [3]),
        ([(2, "Method", "go", "b.rs::B::go", "b.rs"), (3, "Function", "go", "c.rs::Function::go", "c.rs")], {"callee_name": "go", "callee_form": "receiver", "receiver_owner": "B"}, "", [2]),
        ([(2, "Method", "go", "b.rs::B::go", "b.rs"), (3, "Method", "go", "a.rs::B::go", "a.rs")], {"callee_name": "go", "callee_form": "receiver", "receiver_owner": "B"}, "", [3]),
        ([(3, "Function", "go", "c.rs::Function::go", "c.rs")], {"callee_name": "go", "callee_form": "receiver"}, "", []),
        ([], {"callee_name": "main"}, "", [1]),
        ([], {"callee_name": ""}, "", []),
    ],
)
def test_calls(spark, others, properties, target, found):
    n = nodes(spark, [CALLER, *others])
    assert [t for _, t, _ in edges_of(n, raw(spark, [("a.rs", CALLER[3], target, "CALLS", properties)]))] == found


def test_imports_decide(spark):
    n = nodes(spark, [CALLER, (2, "Function", "go", "src/b.rs::Function::go", "src/b.rs"), (3, "Function", "go", "src/c/mod.rs::Function::go", "src/c/mod.rs"), (4, "Module", "a", "a.rs::__file__", "a.rs")])
    rows = [("a.rs", "a.rs::__file__", "", "IMPORTS", {"imported_name": "go", "path": "crate::c::go"}), ("a.rs", CALLER[3], "", "CALLS", {"callee_name": "go"}), ("a.rs", CALLER[3], "", "USAGE", {"ref_name": "main"}), ("x.rs", "unknown", "", "CALLS", {"callee_name": "go"})]
    assert edges_of(n, raw(spark, rows)) == [(1, 3, "CALLS"), (4, 3, "IMPORTS")]  # a usage of itself is none
    kept = resolve.persisted(resolve.resolve(n, raw(spark, [("a.rs", CALLER[3], "", k, {"ref_name": "go", "type_name": "go"}) for k in ("USES", "USAGE")] + rows[:1])), "p")
    assert sorted((x["target_id"], x["edge_type"]) for x in kept.collect()) == [(3, "IMPORTS"), (3, "USAGE")]


def test_file_imports_and_spine(spark):
    n = nodes(spark, [(1, "Module", "a", "a.py::__file__", "a.py"), (2, "File", "util.py", "p.lib.util.__file__", "lib/util.py")])
    r = raw(spark, [("a.py", "a.py::__file__", "", "IMPORTS", {"imported_name": "nope", "path": "lib::util"})])
    assert [(x["source_id"], x["target_id"]) for x in resolve.file_imports(n, r).collect()] == [(1, 2)]
    paths = spark.createDataFrame([("lib/deep/__init__.py",), ("lib/util.py",), ("index.js",)], "rel_path string")
    got_nodes, got_edges = resolve.spine(paths, n, "p")
    assert {x["qualified_name"] for x in got_nodes.collect()} == {"p", "p.lib", "p.lib.deep", "p.lib.deep.__file__", "p.lib.util.__file__", "p.__file__"}
    got = {(x["source"], x["target"], x["edge_type"]) for x in got_edges.collect()}
    assert ("p.lib", "p.lib.deep", "CONTAINS_FOLDER") in got and ("p", "p.__file__", "CONTAINS_FILE") in got and ("p.lib.util.__file__", "p.lib.util.__file__", "DEFINES") in got


SOURCE = textwrap.dedent('''
    from lib.util import helper as h

    class Base:
        """A base."""
        def run(self):
            return helper()

    class Child(Base):
        pass

    def main():
        Child().run()
''')


def test_walk_extract_and_resolve(spark, tmp_path):
    for path, text in {"app.py": SOURCE, "lib/util.py": "def helper():\n    pass\n", "bad.py": "def (", "node_modules/x.js": "function f() {}\n", "tool": "#!/usr/bin/env -S python3 -u\nx = 1\n", "lib.rs": "pub fn go() {\n  if x { y }\n}\nstruct S;\nuse a::b::C;\n", "blob.txt": "a\0b"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.walk(spark, str(tmp_path))
    rows = {r["rel_path"]: r for r in found.collect()}
    assert rows["tool"]["language"] == "Python" and rows["lib.rs"]["language"] == "Rust" and rows["node_modules/x.js"]["skip"] == "folder"
    assert rows["blob.txt"]["binary"] and not rows["app.py"]["binary"]
    assert set(r["rel_path"] for r in files.walk(spark, str(tmp_path), ["**/*.py", "!lib/"]).collect()) == {"app.py", "bad.py"}
    texts = found.filter("skip is null and not binary").select("rel_path", "language", F.decode("content", "UTF-8").alias("text"))
    n = extract.nodes(texts)
    got = {r["qualified_name"]: r for r in n.collect()}
    assert got["app.py::Class::Base"]["properties"] == '{"doc": "A base."}' and (got["app.py::Base::run"]["start_line"], got["app.py::Base::run"]["end_line"]) == (6, 7)
    assert (got["lib.rs::Function::go"]["start_line"], got["lib.rs::Function::go"]["end_line"]) == (1, 3)
    assert [r["rel_path"] for r in extract.failures(texts).collect()] == ["bad.py"] and "bad.py::__file__" not in got
    graph = n.withColumns({"id": F.xxhash64("qualified_name"), "project": F.lit("p")}).select([c.split()[0] for c in schema.NODES.split(", ")])
    names = {r["id"]: r["qualified_name"] for r in graph.collect()}
    edges = {(names[r["source_id"]], names[r["target_id"]], r["edge_type"]) for r in resolve.resolve(graph, extract.references(texts)).collect()}
    assert {("app.py::Base::run", "lib/util.py::Function::helper", "CALLS"), ("app.py::Function::main", "app.py::Class::Child", "CALLS"), ("app.py::Class::Child", "app.py::Class::Base", "TYPE_REF"), ("app.py::__file__", "lib/util.py::Function::helper", "IMPORTS")} <= edges
    assert all(r["accepted"] for r in resolve.quality(n).collect())


def test_languages_and_policy(spark, tmp_path):
    def lang(path):
        return spark.range(1).select(files.language(F.lit(path)).alias("x"), files.parser_language(F.lit(path)).alias("y")).first()

    assert tuple(lang("a/x.H")) == ("Cpp", "C") and lang("Makefile")["x"] == "Makefile" and lang("x.unknown")["x"] is None and lang("go.mod")["x"] == "GoMod"
    head = lambda s: spark.range(1).select(files.shebang_language(F.lit(s)).alias("x")).first()["x"]
    assert [head(s) for s in ("#!/bin/bash\n", "#!/usr/bin/env A=b ruby2.7", "#!/usr/bin/python3.11 -u", "plain", "#!")] == ["Bash", "Ruby", "Python", None, None]
    binary = spark.createDataFrame([(bytearray(b"x" * 8191 + "é".encode()),), (bytearray(b"\xff\xfe"),), (bytearray(b""),)], "c binary")
    assert [r["x"] for r in binary.select(files.is_binary("c").alias("x")).collect()] == [False, True, False]
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert files.repo_root(str(tmp_path / "a" / "b")) == str(tmp_path)


def inventory(spark, rows):
    return spark.createDataFrame(rows, schema.FILES)


def test_file_diff(spark):
    before = inventory(spark, [("same", 1, 1, 1, 1, "a"), ("touched", 1, 1, 1, 1, "a"), ("changed", 1, 1, 1, 1, "a"), ("gone", 1, 1, 1, 1, "a"), ("nulls", None, None, None, None, "a")])
    after = inventory(spark, [("same", 1, 1, 1, 1, "other"), ("touched", 1, 2, 1, 1, "a"), ("changed", 1, 2, 1, 1, "b"), ("new", 1, 1, 1, 1, "a"), ("nulls", None, None, None, None, "a")])
    got = {r["rel_path"]: (r["status"], r["hashed"]) for r in store.file_diff(before, after).collect()}
    assert got == {"same": ("unchanged", False), "touched": ("unchanged", True), "changed": ("modified", True), "gone": ("deleted", False), "new": ("added", False), "nulls": ("unchanged", False)}


@pytest.mark.parametrize(("stored", "status", "reasons"), [(None, "cold", ""), (("/r", "main", "h", "i", "s"), "fresh", ""), (("/r", "dev", "g", "i", "s"), "stale", "branch,head"), (("/x", "main", "h", "i", "s"), "root mismatch", "")])
def test_workspace(spark, stored, status, reasons):
    kind = "root_path string, branch string, head string, index_sha string, scope_key string"
    now = spark.createDataFrame([("/r", "main", "h", "i", "s")], kind)
    got = store.workspace_status(spark.createDataFrame([stored] if stored else [], kind), now)
    assert tuple(got.first()) == (status, reasons)
    diff = spark.createDataFrame([("a", "unchanged")], "rel_path string, status string")
    assert store.only_metadata(got, diff).first()["metadata_only"] == (status == "stale")


def test_upserts(spark):
    n = nodes(spark, [(1, "Function", "a", "q1", "f"), (2, "Function", "b", "q2", "f")])
    new = nodes(spark, [(9, "Method", "a", "q1", "g"), (10, "Struct", "c", "q3", "g")])
    assert sorted((r["id"], r["label"]) for r in store.upsert_nodes(n, new).collect()) == [(1, "Method"), (2, "Function"), (10, "Struct")]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    batch = spark.createDataFrame([(2, "late", 2), (2, "early", 1), (3, "z", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, store.upsert(old, batch, ["k"], "seq").collect())) == [(1, "x"), (2, "late"), (3, "z")]


def test_snapshots_and_stream(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "table"))
    assert snapshots.read() is None and snapshots.generation() == 0
    changes, kind = str(tmp_path / "changes"), "k long, v string, seq long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], kind).write.parquet(changes)
    follow(spark, changes, kind, snapshots, ["k"], "seq", str(tmp_path / "offsets"))
    assert sorted((r["k"], r["v"]) for r in snapshots.read().collect()) == [(1, "c"), (2, "b")]
    with pytest.raises(Exception):  # noqa: B017  a build that fails changes nothing
        snapshots.publish(spark.range(1).select(F.raise_error(F.lit("broken")).alias("k")))
    assert snapshots.generation() == 1 and snapshots.read().count() == 2
    spark.createDataFrame([(2, "d", 5), (3, "e", 5)], kind).write.mode("append").parquet(changes)
    follow(spark, changes, kind, snapshots, ["k"], "seq", str(tmp_path / "offsets"))
    assert sorted((r["k"], r["v"]) for r in snapshots.read().collect()) == [(1, "c"), (2, "d"), (3, "e")] and snapshots.generation() == 2


def test_commands(spark):
    n = nodes(spark, [(1, "Function", "loadConfig", "a::loadConfig", "a.rs"), (2, "Function", "main", "a::main", "a.rs"), (3, "Struct", "Config", "b::Config", "b.rs")])
    e = spark.createDataFrame([(1, "p", 2, 1, "CALLS", "{}"), (2, "p", 1, 3, "USAGE", "{}")], schema.EDGES)
    c = spark.createDataFrame([("p", "a.rs", 2, "fn load config here")], schema.CONTENT)
    index = Index(n, e, c)
    assert [r["name"] for r in index.who_calls("loadConfig").collect()] == ["main"] and index.callees("main").count() == 1
    assert [r["name"] for r in index.impact("Config").orderBy("rank").collect()] == ["loadConfig", "main"]
    assert index.path("main", "loadConfig").count() == 2 and index.locate("b.rs", 3).count() == 1 and index.locate("zz.rs", 3).count() == 0
    assert index.fused_search("load config").orderBy("rank").first()["id"] == 1
    assert index.context("loadConfig").first()["line"] == 2 and index.search_graph(GraphQuery(name="main")).count() == 1
    assert index.shown(n)["truncated"] is False and index.brief("main")["callees"].count() == 1 and index.trace("main").count() == 2
    hunks = spark.createDataFrame([("b.rs", 4)], "file_path string, line long")
    assert index.impact_since(hunks).count() == 2
    with pytest.raises(LookupError):
        index.callees("nowhere")
    with pytest.raises(RuntimeError, match="stale"):
        Index(n, e, c, status="stale").who_calls("main")


def test_evaluation(spark):
    assert evaluation.sign_test(5, 0) == 1 / 32 and evaluation.sign_test(0, 0) == 1.0 and evaluation.sign_test(1, 1) == 0.75
    pairs = spark.createDataFrame([(1, 10.0, 5.0), (2, 4.0, 4.0), (3, 1.0, 2.0), (4, None, 7.0), (5, 0.0, 3.0)], "task long, b double, c double")
    assert tuple(evaluation.outcomes(pairs).first()) == (2, 1, 1)
    assert evaluation.ratio_of_totals(pairs).first()["ratio"] == pytest.approx(14 / 15)
    assert {r["task"]: r["flag"] for r in evaluation.flagged(pairs).collect()} == {1: "strong win", 2: "even", 3: "regression", 5: "regression"}
    assert evaluation.compared(pairs).filter("task = 5").first()["ratio"] is None
    rows = spark.createDataFrame([("The Foo-Bar, then baz.",), (None,)], "answer string")
    got = evaluation.graded(rows, ["foo bar"], ["qux"], ["foo", "baz"], 1).collect()
    assert got[0]["passed"] and not got[1]["passed"]


def test_ignore_rules():
    rules = {"": files.ignore_rules("# remark\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/draft*\na[0-9].md \n"), "sub": files.ignore_rules("!x.log\n*.tmp\n")}
    out = ["x.log", "sub/y.log", "build/a.txt", "p/build/b.txt", "top.txt", "docs/draft1.txt", "docs/a/b/draft.md", "a3.md", "sub/z.tmp", ".hidden", "p/.git/HEAD", "build/keep.log"]
    kept = ["keep.log", "sub/x.log", "build", "p/top.txt", "ax.md", "z.tmp", "sub/deep/x.txt", "docs/drift"]
    assert [p for p in out if not files.is_ignored(p, rules)] == [] and [p for p in kept if files.is_ignored(p, rules)] == []


def test_git_fingerprint(tmp_path):
    from wicker.sources import git

    a, b = "a" * 40, "b" * 40
    own = tmp_path / "r" / ".git"
    (own / "refs" / "heads").mkdir(parents=True)
    root = str(tmp_path / "r")
    assert git.fingerprint(str(tmp_path))["head"] is None and git.fingerprint(root)["head"] is None
    (own / "HEAD").write_text("ref: refs/heads/main\n")
    (own / "packed-refs").write_text(f"# pack\n{b} refs/heads/main\n^{a}\n")
    assert (git.fingerprint(root)["branch"], git.fingerprint(root)["head"], git.fingerprint(root)["index_sha"]) == ("main", b, None)
    (own / "refs" / "heads" / "main").write_text(a + "\n")
    (own / "index").write_bytes(b"x")
    found = git.fingerprint(root, "s")
    assert found["head"] == a and found["index_sha"] == hashlib.sha256(b"x").hexdigest() and found["scope_key"] == "s"
    (own / "HEAD").write_text(b + "\n")
    assert (git.fingerprint(root)["branch"], git.fingerprint(root)["head"]) == (None, b)
    linked = tmp_path / "w"
    linked.mkdir()
    (own / "worktrees" / "w").mkdir(parents=True)
    (own / "worktrees" / "w" / "HEAD").write_text("ref: refs/heads/main")
    (own / "worktrees" / "w" / "commondir").write_text("../..")
    (linked / ".git").write_text(f"gitdir: {own}/worktrees/w\n")
    assert git.fingerprint(str(linked))["head"] == a
