"""Hand-built graphs: filters, references, traversal, paths and cycles."""

import pytest

from wicker import schema
from wicker.operators import graph, graphquery, stats, traverse
from wicker.operators.graph import IN, OUT
from wicker.operators.graphquery import GraphQuery


def make(spark, nodes, edges):
    n = spark.createDataFrame([(i, "p", label, name, qname or f"f.rs::{label}::{name}", path, a, b, "{}") for i, label, name, qname, path, a, b in nodes], schema.NODES)
    e = spark.createDataFrame([(i + 1, "p", s, t, kind, "{}") for i, (s, t, kind) in enumerate(edges)], schema.EDGES)
    return n, e


def functions(spark, names, edges):
    ids = {x: i + 1 for i, x in enumerate(names)}
    nodes = [(ids[x], "Function", x, x, "f.rs", 1, 9) for x in names]
    return ids, *make(spark, nodes, [(ids[s], ids[t], k) for s, t, k in edges])


def calls(*pairs):
    return [(s, t, "CALLS") for s, t in pairs]


def ids_of(df, column="id"):
    return [r[column] for r in df.orderBy("rank").collect()] if "rank" in df.columns else sorted(r[column] for r in df.collect())


def test_golden_graph(spark):
    ids, n, e = functions(spark, "ABC", calls("AB", "AC", "BA") + [("C", "B", "IMPORTS")])
    got = {(r["kind"], r["key"]): r["n"] for r in stats.graph_stats(n, e).collect()}
    assert got == {("label", "Function"): 3, ("edge_type", "CALLS"): 3, ("edge_type", "IMPORTS"): 1, ("total", "label"): 3, ("total", "edge_type"): 4}
    assert graph.edge_scan(e, ids["B"], IN, None, 10).count() == 2


def test_filters(spark):
    nodes = [(1, "Function", "alpha", None, "src/a.rs", 1, 9), (2, "Function", "beta", None, "src/b.rs", 1, 9), (3, "Struct", "Gamma_x", None, "src/b.rs", 20, 30), (4, "Import", "alpha", None, "main.rs", 1, 1), (5, "Module", "f", "f.rs::__file__", "f.rs", 1, 1)]
    n, e = make(spark, nodes, [(1, 2, "CALLS")])
    assert ids_of(GraphQuery(label="Function").run(n)) == [1, 2]
    assert ids_of(GraphQuery(name="alpha").run(n)) == [1, 4]
    assert ids_of(GraphQuery(name_prefix="GAM").run(n)) == [3]
    assert ids_of(GraphQuery(name="ALPHA").run(n)) == []
    assert ids_of(GraphQuery(name_contains="a_x").run(n)) == [3] and ids_of(GraphQuery(name_contains="%").run(n)) == []
    assert ids_of(GraphQuery(file_contains="B.RS", order="file").run(n)) == [2, 3]
    assert ids_of(GraphQuery(has_outgoing="CALLS").run(n, e)) == [1] and ids_of(GraphQuery(has_incoming="CALLS").run(n, e)) == [2]
    assert GraphQuery(limit=1).count(n).first()["n"] == 5 and GraphQuery(limit=1).run(n).count() == 1
    assert [r["degree"] for r in GraphQuery(order="out_degree").run(n, e).orderBy("rank").collect()] == [1, 0, 0, 0, 0]
    assert sorted(r["id"] for r in graphquery.without_pseudo(n).collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in graphquery.without_pseudo(n, ("Import",)).collect()) == [1, 2, 3, 4]


def test_multihop(spark):
    ids, n, e = functions(spark, ["a", "b", "c", "d", "e", "island"], calls("ab", "bc", "cd", "ae"))
    got = [(r["name"], r["hops"]) for r in traverse.reachable_within(n, e, ids["a"], ["CALLS"], 2).orderBy("rank").collect()]
    assert got == [("b", 1), ("e", 1), ("c", 2)]
    assert traverse.reachable_within(n, e, ids["island"], ["CALLS"], 5).count() == 0
    assert traverse.reachable_within(n, e, ids["a"], ["CALLS"], 0).count() == 0


def test_types_mix_in_one_search(spark):
    ids, n, e = functions(spark, "abc", [("a", "b", "CALLS"), ("b", "c", "USAGE")])
    assert [(r["name"], r["hops"]) for r in traverse.reachable_within(n, e, ids["a"], ["USAGE", " CALLS "], 3).orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    assert [r["name"] for r in traverse.impact(n, e, ids["c"]).orderBy("rank").collect()] == ["b", "a"]


def test_cycles(spark):
    ids, _, e = functions(spark, "abcd", calls("ab", "bc", "ca", "cd", "dd", "ba"))
    got = sorted((r["length"], r["cycle"]) for r in traverse.cycles(e, 16).collect())
    assert got == [(1, [4]), (2, [1, 2]), (3, [1, 2, 3])]
    assert [r["length"] for r in traverse.cycles(e, 1).collect()] == [1]


def test_path_takes_the_first_discovered(spark):
    # Two shortest ways to t: through x (found first) and through y, whose last edge is older.
    ids, n, e = functions(spark, ["s", "x", "y", "t"], calls("yt", "sx", "sy", "xt"))
    path = traverse.shortest_path(e, ids["s"], ids["t"], ["CALLS"])
    assert [r["id"] for r in path.orderBy("step").collect()] == [ids["s"], ids["x"], ids["t"]]
    assert traverse.path_summary(path, n).first()["path"] == "s -> x -> t"
    assert traverse.shortest_path(e, ids["t"], ids["s"], ["CALLS"]).count() == 0
    assert traverse.shortest_path(e, ids["s"], ids["s"], ["CALLS"]).count() == 1


def test_tree_and_hierarchy(spark):
    ids, n, e = functions(spark, "abcd", calls("ab", "ac", "bd", "cd", "da", "aa", "bb"))
    tree = {r["id"]: (r["depth"], list(r["children"])) for r in traverse.call_tree(n, e, 1, 5).collect()}
    assert tree == {1: (0, [2, 3]), 2: (1, [4]), 3: (1, [4]), 4: (2, [1])}  # no self-call
    rows = sorted((r["depth"], list(r["path"]), r["cyclic"], r["truncated"]) for r in traverse.call_hierarchy(n, e, 1, 3).collect())
    assert rows == [(0, [1], False, False), (1, [1, 2], False, False), (1, [1, 3], False, False), (2, [1, 2, 4], False, False), (2, [1, 3, 4], False, False), (3, [1, 2, 4, 1], True, False), (3, [1, 3, 4, 1], True, False)]
    assert all(r["truncated"] for r in traverse.call_hierarchy(n, e, 1, 1).filter("depth = 1").collect())
    up = {r["id"]: (r["depth"], list(r["children"])) for r in traverse.call_tree(n, e, 4, 2, IN).collect()}
    assert up == {4: (0, [2, 3]), 2: (1, [1]), 3: (1, [1]), 1: (2, [])}
    callers = sorted(list(r["path"]) for r in traverse.call_hierarchy(n, e, 4, 1, IN).collect())
    assert callers == [[4], [4, 2], [4, 3]]
    assert traverse.call_tree(n, e, 99, 2).count() == traverse.call_hierarchy(n, e, 99, 2).count() == 0


def test_fan_out_cap_ranks_the_crowded_only(spark, monkeypatch):
    monkeypatch.setattr(schema, "TRACE_FANOUT", 2)
    _, n, e = functions(spark, "abcde", calls("ac", "ab", "ad", "be"))
    assert sorted((r["id"], r["parent"]) for r in traverse.trace(n, e, 1, ["CALLS"], 2).collect() if r["parent"]) == [(2, 1), (3, 1), (5, 2)]


def test_cycles_against_brute_force(spark):
    import itertools
    import random

    r = random.Random(4)
    pairs = {(r.randrange(1, 9), r.randrange(1, 9)) for _ in range(26)}
    e = spark.createDataFrame([(i, "p", s, t, "CALLS", "{}") for i, (s, t) in enumerate(sorted(pairs))], schema.EDGES)
    wanted = {(x,) for x, y in pairs if x == y}
    for n in range(2, 6):
        wanted |= {p for p in itertools.permutations(range(1, 9), n) if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, (*p[1:], p[0]), strict=True))}
    got = [tuple(x["cycle"]) for x in traverse.cycles(e, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_cluster_and_subgraph(spark):
    _, _, e = functions(spark, "abcdx", [("a", "b", "IMPORTS"), ("c", "b", "IMPORTS"), ("c", "d", "IMPORTS")])
    whole = traverse.cluster(e, 1).orderBy("rank").collect()
    assert [r["id"] for r in whole] == [1, 2, 3, 4] and not whole[0]["truncated"]
    assert [(r["id"], r["truncated"]) for r in traverse.cluster(e, 1, limit=2).orderBy("rank").collect()] == [(1, True), (2, True)]
    near, inner = traverse.subgraph(e, 1, ["IMPORTS"], 2)
    assert sorted(r["id"] for r in near.collect()) == [1, 2, 3] and inner.count() == 2


def test_references_and_unused(spark):
    _, n, e = functions(spark, "abcd", [("a", "b", "CALLS"), ("a", "b", "USAGE"), ("a", "b", "CALLS"), ("b", "b", "CALLS"), ("c", "c", "CALLS")])
    refs = graph.ordered_references(n, e, n.filter("id = 2"), 10).orderBy("rank").collect()
    assert [(r["id"], r["edge_type"]) for r in refs] == [(1, "CALLS"), (1, "USAGE")]
    # A self-reference is a use, though it is no reference.
    assert sorted(r["name"] for r in graph.unused(n, e, ["Function"]).collect()) == ["a", "d"]


def test_degrees(spark):
    hub = [f"c{i:02}" for i in range(60)]
    ids, n, e = functions(spark, ["hub", *hub], calls(*((c, "hub") for c in hub)) + calls(("hub", "hub")))
    assert [(r["name"], r["degree"]) for r in graph.fan(n, e, IN, "CALLS", 1).collect()] == [("hub", 61)]
    assert graph.fan_total(n, e, OUT, "CALLS").first()["n"] == 61
    top = graph.most_connected(n, e, "total", 100)
    assert top.filter("name = 'hub'").first()["degree"] == 62 and top.count() == 61
    assert graph.first_neighbours(n, e, ids["hub"], IN).count() == 60
    assert graph.capped(e, IN, 7).count() == 7


@pytest.mark.parametrize(("line", "found"), [(5, "outer"), (12, "inner"), (40, None)])
def test_innermost_span(spark, line, found):
    n, _ = make(spark, [(1, "Class", "outer", None, "a.py", 1, 30), (2, "Method", "inner", None, "a.py", 10, 20), (3, "Class", "other", None, "b.py", 1, 99)], [])
    hits = graph.enclosing(n, spark.createDataFrame([("a.py", line)], "file_path string, line long")).collect()
    assert [r["qualified_name"].rsplit("::")[-1] for r in hits] == ([found] if found else [])
