"""Filters, counts, one hop and several hops over the adapted graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker import schema
from wicker.operators import graph, graphquery, stats, traverse
from wicker.operators.graph import IN, OUT
from wicker.operators.graphquery import GraphQuery
from wicker.queries.registry import query
from wicker.sources import adapters as A
from wicker.sources import published as P

N, NE = f"with {A.NODES_SQL} ", f"with {A.NODES_SQL}, {A.EDGES_SQL} "
E, T = f"with {A.EDGES_SQL} ", f"with recursive {A.EDGES_SQL}, calls as (select * from edges where edge_type = 'CALLS') "
#: The same with all calls turned round.
T_IN = T.replace("select * from edges", "select * replace (target_id as source_id, source_id as target_id) from edges")
NODE = ["rank", "id", "label", "name", "qualified_name", "file_path", "start_line", "end_line"]
#: Nodes that the single-node queries start from: a part, a nation and a supplier.
PART, NATION, SUPPLIER = 17 * 8 + 4, 3 * 8 + 1, 5 * 8 + 3


def top(sql: str, order: str, limit: int = schema.MAX_ROWS, columns: str = ", ".join(NODE[1:])) -> str:
    return f"select cast(row_number() over (order by {order}) as int) as rank, {columns} from ({sql}) order by {order} limit {limit}"


# Filters


@query(N + top("select * from nodes where project = 'tpch' and label = 'Function' and name = 'red plate'", "qualified_name, id"))
def filter_equal(spark, d):
    return GraphQuery(project="tpch", label="Function", name="red plate").run(P.nodes(spark, d)).select(NODE)


@query(N + top("select * from nodes where qualified_name ilike '%brand#1%' and file_path ilike '%RT/b%'", "qualified_name, id", 500))
def filter_contains(spark, d):
    return GraphQuery(qname_contains="brand#1", file_contains="RT/b", limit=500).run(P.nodes(spark, d)).select(NODE)


@query(N + top("select * from nodes where file_path ilike 'CUSTOMER/m%' and name ilike '%00002%'", "file_path, start_line, qualified_name, id"))
def filter_prefix(spark, d):
    return GraphQuery(file_prefix="CUSTOMER/m", name_contains="00002", order="file").run(P.nodes(spark, d)).select(NODE)


@query(N + top("select * from nodes where name ilike 'red%' and file_path = 'part/Brand#5.sql'", "name, qualified_name, id"))
def filter_name_prefix(spark, d):
    return GraphQuery(name_prefix="RED", file="part/Brand#5.sql", order="name").run(P.nodes(spark, d)).select(NODE)


@query(N + top("select * from nodes where qualified_name = 'geo::nation::NATION_3'", "qualified_name, id"))
def filter_qname(spark, d):
    return GraphQuery(qname="geo::nation::NATION_3").run(P.nodes(spark, d)).select(NODE)


@query(N + top(r"select * from nodes where name ilike '%\_1%' escape '\'", "qualified_name, id"))
def filter_escaped(spark, d):
    return GraphQuery(name_contains="_1").run(P.nodes(spark, d)).select(NODE)


@query(NE + top("select * from nodes n where exists (select 1 from edges e where e.source_id = n.id and e.edge_type = 'CALLS') and exists (select 1 from edges e where e.target_id = n.id and e.edge_type = 'USAGE')", "qualified_name, id", 1000))
def filter_has_edges(spark, d):
    return GraphQuery(has_outgoing="CALLS", has_incoming="USAGE", limit=1000).run(P.nodes(spark, d), P.edges(spark, d, ("CALLS", "USAGE"))).select(NODE)


@query(N + "select count(*) as n from nodes where label = 'Method' and file_path ilike 'part/%'")
def filter_count(spark, d):
    return GraphQuery(label="Method", file_prefix="part/", limit=3).count(P.nodes(spark, d))


for _how, _end in (("out_degree", "source_id"), ("in_degree", "target_id")):
    _sql = NE + top(f"select n.*, least(coalesce(k, 0), 10000) as degree from nodes n left join (select {_end} as i, count(*) as k from edges where edge_type = 'CALLS' group by 1) on i = id where label = 'Function'", "degree desc, qualified_name, id", 100, ", ".join([*NODE[1:], "degree"]))

    def _run(spark, d, how=_how):
        return GraphQuery(label="Function", order=how, degree_type="CALLS", limit=100).run(P.nodes(spark, d), P.edges(spark, d, ("CALLS",))).select(*NODE, "degree")

    _run.__name__ = f"order_{_how}"
    query(_sql)(_run)


@query(N + top("select * from nodes where file_path = 'part/Brand#7.sql'", "start_line, end_line desc, qualified_name, id"))
def symbols_in_file(spark, d):
    return graphquery.symbols_in_file(P.nodes(spark, d), "part/Brand#7.sql").select(NODE)


@query(N + top("select * from nodes where label = 'Struct' and file_path = 'part/Brand#7.sql'", "file_path, start_line, qualified_name, id"))
def labelled_in_file(spark, d):
    return graphquery.labelled_in_file(P.nodes(spark, d), "Struct", "part/Brand#7.sql").select(NODE)


@query(N + "select cast(row_number() over (order by length(name), name) as int) as rank, name from (select distinct name from nodes where name ilike '%RING%') order by rank limit 10")
def similar_names(spark, d):
    return graphquery.similar_names(P.nodes(spark, d), "RING", 10).select("rank", "name")


@query(N + "select id, qualified_name from nodes order by qualified_name, id limit 25 offset 50")
def page(spark, d):
    return graphquery.page(P.nodes(spark, d), 50, 25).select("id", "qualified_name")


@query(N + f"select id, label, qualified_name, properties from nodes where id = {PART}")
def node_by_id(spark, d):
    return P.nodes(spark, d).filter(F.col("id") == PART).select("id", "label", "qualified_name", "properties")


@query(N + "select id, json_extract_string(properties, '$.url_path') as url_path from nodes where label = 'Class'")
def json_property(spark, d):
    return P.nodes(spark, d).filter("label = 'Class'").select("id", F.get_json_object("properties", "$.url_path").alias("url_path"))


# Counts


@query(N + "select label, count(*) as n from nodes group by 1")
def nodes_by_label(spark, d):
    return stats.count_by(P.nodes(spark, d), "label")


@query(E + "select edge_type, count(*) as n from edges group by 1")
def edges_by_type(spark, d):
    return stats.count_by(P.edges(spark, d), "edge_type")


@query("with " + A.CONTENT_SQL + " select rel_path, count(*) as n from content group by 1")
def lines_by_file(spark, d):
    return stats.count_by(P.content(spark, d), "rel_path")


_STATS = "both_ as (select 'label' as kind, label as key, count(*) as n from nodes group by 1, 2 union all select 'edge_type', edge_type, count(*) from edges group by 1, 2), every as (select * from both_ union all select 'total', kind, cast(sum(n) as bigint) from both_ group by 1, 2) "


@query(NE.rstrip() + ", " + _STATS + "select kind, key, n from every")
def graph_stats(spark, d):
    return stats.graph_stats(P.nodes(spark, d), P.edges(spark, d))


@query(NE.rstrip() + ", " + _STATS + "select string_agg(kind || ':' || key || '=' || n, ';' order by kind, key, n) as stats from every")
def canonical_stats(spark, d):
    return stats.canonical_stats(P.nodes(spark, d), P.edges(spark, d))


@query(N + "select project, label, file_path, count(*) as n from nodes group by all")
def nodes_by_place(spark, d):
    return P.nodes(spark, d).groupBy("project", "label", "file_path").agg(F.count("*").alias("n"))


@query("with " + A.VECTORS_SQL + " select distinct model_id from vectors")
def vector_models(spark, d):
    return A.vectors(spark, d).select("model_id").distinct()


for _name, _ends in (("fan_out", OUT), ("fan_in", IN)):
    _sql = NE + top(f"select n.*, k as degree from nodes n join (select {_ends[0]} as i, count(*) as k from edges where edge_type = 'CALLS' group by 1) on i = id", "degree desc, qualified_name, id", 40, ", ".join([*NODE[1:], "degree"]))

    def _run(spark, d, ends=_ends):
        return graph.fan(P.nodes(spark, d), P.edges(spark, d, ("CALLS",)), ends, "CALLS", 40).select(*NODE, "degree")

    _run.__name__ = _name
    query(_sql)(_run)

    def _run(spark, d, ends=_ends):
        return graph.fan_total(P.nodes(spark, d), P.edges(spark, d, ("CALLS",)), ends, "CALLS")

    _run.__name__ = f"{_name}_total"
    query(NE + f"select count(distinct nodes.id) as n from nodes join edges on {_ends[0]} = nodes.id where edge_type = 'CALLS'")(_run)

for _how, _ids in (("out", "source_id"), ("in", "target_id"), ("total", "source_id, target_id")):
    _sql = NE + top(f"select n.*, coalesce(k, 0) as degree from nodes n left join (select i, count(*) as k from (select unnest([{_ids}]) as i from edges) group by 1) on i = id", "degree desc, qualified_name, id", 100, ", ".join([*NODE[1:], "degree"]))

    def _run(spark, d, how=_how):
        return graph.most_connected(P.nodes(spark, d), P.edges(spark, d), how, 100).select(*NODE, "degree")

    _run.__name__ = f"most_connected_{_how}"
    query(_sql)(_run)


# One hop


@query(E + f"select id, source_id, target_id, edge_type from edges where source_id = {PART} order by id limit 50")
def outgoing_edges(spark, d):
    return graph.edge_scan(P.edges(spark, d), PART, OUT, None, 50).select("id", "source_id", "target_id", "edge_type")


@query(E + f"select id, source_id, target_id, edge_type from edges where target_id = {PART} and edge_type = 'USAGE' order by id limit 50")
def incoming_edges(spark, d):
    return graph.edge_scan(P.edges(spark, d), PART, IN, "USAGE", 50).select("id", "source_id", "target_id", "edge_type")


@query(E + "select cast(row_number() over (order by source_id, target_id, id) as int) as rank, id, source_id, target_id from edges where edge_type = 'IMPORTS' order by rank limit 10000")
def edges_of_type(spark, d):
    return graph.edges_of_type(P.edges(spark, d, ("IMPORTS",)), "IMPORTS").select("rank", "id", "source_id", "target_id")


@query(E + f"select cast(row_number() over (order by edge_type, id) as int) as rank, id, edge_type from edges where source_id = {NATION} and target_id = 24 order by rank")
def edges_between(spark, d):
    return graph.edges_between(P.edges(spark, d), NATION, 24).select("rank", "id", "edge_type")


@query(E + f"select distinct target_id as id from edges where source_id = {SUPPLIER} order by id limit 100")
def neighbour_ids(spark, d):
    return graph.neighbour_ids(P.edges(spark, d), SUPPLIER, OUT, None, 100)


@query(NE + top(f"select * from nodes where id in (select target_id from edges where source_id = {PART} and edge_type = 'CALLS' and target_id <> {PART})", "qualified_name, id"))
def neighbours(spark, d):
    return graph.neighbours(P.nodes(spark, d), P.edges(spark, d, ("CALLS",)), PART, OUT, "CALLS").select(NODE)


_REFS = "select distinct n.*, e.edge_type from nodes n join edges e on e.source_id = n.id join nodes t on t.id = e.target_id where t.name = 'red plate' and e.source_id <> e.target_id"


@query(NE + top(_REFS, "qualified_name, id, edge_type", 500, ", ".join([*NODE[1:], "edge_type"])))
def references(spark, d):
    n = P.nodes(spark, d)
    return graph.ordered_references(n, P.edges(spark, d), n.filter("name = 'red plate'"), 500).select(*NODE, "edge_type")


@query(NE + f"select count(*) as n from ({_REFS})")
def count_references(spark, d):
    n = P.nodes(spark, d)
    return graph.references(n, P.edges(spark, d), n.filter("name = 'red plate'")).agg(F.count("*").alias("n"))


@query(NE + "select id, label, qualified_name from nodes where label in ('Function', 'Method', 'Variable') and id not in (select target_id from edges)")
def unused_symbols(spark, d):
    return graph.unused(P.nodes(spark, d), P.edges(spark, d), ["Function", "Method", "Variable"]).select("id", "label", "qualified_name")


for _name, _ends in (("callees", OUT), ("callers", IN)):
    _sql = NE + top(f"select n.*, edge_id from nodes n join (select {_ends[1]} as i, min(id) as edge_id from edges where edge_type = 'CALLS' and {_ends[0]} = {PART} and {_ends[1]} <> {PART} group by 1) on i = n.id", "edge_id", columns=", ".join([*NODE[1:], "edge_id"]))

    def _run(spark, d, ends=_ends):
        return graph.first_neighbours(P.nodes(spark, d), P.edges(spark, d, ("CALLS",)), PART, ends).select(*NODE, "edge_id")

    _run.__name__ = _name
    query(_sql)(_run)


@query(N + ", places as (select distinct 'part/Brand#' || (1 + event_id % 25) || '.sql' as file_path, 1 + (event_id * 37) % 20000 as line from events) select * exclude (r) from (select p.file_path, p.line, n.id, n.label, n.qualified_name, n.start_line, n.end_line, row_number() over (partition by p.file_path, p.line order by n.start_line desc, n.end_line, n.qualified_name, n.id) as r from places p join nodes n on n.file_path = p.file_path and n.start_line <= p.line and p.line <= n.end_line) where r = 1")
def definition_at(spark, d):
    e = A.read(spark, d, "events")
    places = e.select(F.concat(F.lit("part/Brand#"), (1 + F.col("event_id") % 25).cast("string"), F.lit(".sql")).alias("file_path"), (1 + (F.col("event_id") * 37) % 20000).alias("line")).distinct()
    return graph.enclosing(P.nodes(spark, d), places)


@query(NE + top(f"select n.*, k as shared from nodes n join (select e.source_id as i, count(distinct e.target_id) as k from edges e join edges m on m.target_id = e.target_id and m.edge_type = 'USAGE' and m.source_id = {SUPPLIER} where e.edge_type = 'USAGE' and e.source_id <> {SUPPLIER} group by 1) on i = n.id", "shared desc, qualified_name, id", 100, ", ".join([*NODE[1:], "shared"])))
def co_change(spark, d):
    return graph.co_change(P.nodes(spark, d), P.edges(spark, d, ("USAGE",)), SUPPLIER, "USAGE", 100).select(*NODE, "shared")


@query(NE + "select n.id, n.qualified_name, cast(count(e.id) as bigint) as n_edges, string_agg(cast(e.target_id as varchar), ',' order by e.id) as targets from nodes n left join edges e on e.source_id = n.id where n.name = 'red plate' group by 1, 2")
def nodes_with_outgoing(spark, d):
    out = graph.with_outgoing(P.nodes(spark, d), P.edges(spark, d), "red plate")
    return out.select("id", "qualified_name", F.coalesce(F.size("outgoing"), F.lit(0)).cast("long").alias("n_edges"), F.array_join(F.transform("outgoing", lambda x: x["target_id"].cast("string")), ",").alias("targets"))


@query(E + "select id from (select id, row_number() over (partition by source_id, edge_type order by id) as r from edges) where r <= 5")
def fanout_cap(spark, d):
    return graph.capped(P.edges(spark, d), OUT, 5).select("id")


# Several hops

_WALK = "walk as (select cast({start} as bigint) as id, 0 as h union select {b}, h + 1 from walk join links on {a} = walk.id where h < {hops}), seen as (select id, min(h) as hops from walk group by 1) "


def _reach(links: str, start: int, hops: int, a: str = "source_id", b: str = "target_id") -> str:
    return f"links as ({links}), " + _WALK.format(start=start, hops=hops, a=a, b=b)


_REC = f"with recursive {A.NODES_SQL}, {A.EDGES_SQL}, "


@query(_REC + _reach("select * from edges where edge_type in ('CALLS', 'USAGE')", SUPPLIER, 2) + top(f"select n.*, hops from nodes n join seen using (id) where id <> {SUPPLIER}", "hops, qualified_name, id", 5000, ", ".join([*NODE[1:], "hops"])))
def reachable_within(spark, d):
    return traverse.reachable_within(P.nodes(spark, d), P.edges(spark, d, ("CALLS", "USAGE")), SUPPLIER, ["USAGE ", "CALLS", "CALLS"], 2, OUT, 5000).select(*NODE, "hops")


@query(_REC + _reach("select * from edges", 8, 3, "target_id", "source_id") + top("select n.*, hops from nodes n join seen using (id) where id <> 8", "hops, qualified_name, id", 10000, ", ".join([*NODE[1:], "hops"])))
def impact(spark, d):
    return traverse.impact(P.nodes(spark, d), P.edges(spark, d), 8, 3).select(*NODE, "hops")


_SYM = "select source_id as x, target_id as y from edges where edge_type = 'IMPORTS' union all select target_id, source_id from edges where edge_type = 'IMPORTS'"


@query(_REC + _reach(_SYM, NATION, 2, "x", "y") + "select e.id, e.source_id, e.target_id from edges e where edge_type = 'IMPORTS' and source_id in (select id from seen) and target_id in (select id from seen)")
def subgraph_edges(spark, d):
    return traverse.subgraph(P.edges(spark, d, ("IMPORTS",)), NATION, ["IMPORTS"], 2)[1].select("id", "source_id", "target_id")


@query(_REC + _reach(_SYM, NATION, 2, "x", "y") + "select id, hops from seen")
def subgraph_nodes(spark, d):
    return traverse.subgraph(P.edges(spark, d, ("IMPORTS",)), NATION, ["IMPORTS"], 2)[0]


@query(_REC + _reach(_SYM, NATION, 6, "x", "y") + ", n as (select count(*) as k from seen) " + "select cast(row_number() over (order by id) as int) as rank, id, k > 200 as truncated from seen, n order by id limit 200")
def dependency_cluster(spark, d):
    return traverse.cluster(P.edges(spark, d, ("IMPORTS",)), NATION, "IMPORTS", 200)


_BFS = "{pre}, bfs as (select cast({start} as bigint) as id, 0 as depth, cast([] as bigint[]) as key, cast(null as bigint) as parent, cast(null as bigint) as edge_id union all select * exclude (r) from (select target_id as id, depth + 1 as depth, list_append(key, e.id) as key, source_id as parent, e.id as edge_id, row_number() over (partition by target_id order by list_append(key, e.id)) as r from bfs join calls e on e.source_id = bfs.id where depth < {hops}) where r = 1), first as (select * from (select *, row_number() over (partition by id order by depth, key) as r from bfs) where r = 1) "


def _bfs(start: int, hops: int, calls: str = T) -> str:
    return _BFS.format(pre=calls.rstrip(), start=start, hops=hops)


@query(_bfs(PART, 4).replace("with recursive ", f"with recursive {A.NODES_SQL}, ", 1) + "select id, name, qualified_name, depth, coalesce(parent, -1) as parent, coalesce(edge_id, -1) as edge_id from first join nodes using (id)")
def trace(spark, d):
    return traverse.trace(P.nodes(spark, d), P.edges(spark, d, ("CALLS",)), PART, ["CALLS"], 4).fillna(-1, ["parent", "edge_id"]).select("id", "name", "qualified_name", "depth", "parent", "edge_id")


GOAL = 420


@query(_bfs(PART, 8) + f", back as (select id, depth, parent, edge_id from first where id = {GOAL} union all select f.id, f.depth, f.parent, f.edge_id from back join first f on f.id = back.parent) select depth as step, id, coalesce(edge_id, -1) as edge_id from back")
def shortest_path(spark, d):
    return traverse.shortest_path(P.edges(spark, d, ("CALLS",)), PART, GOAL, ["CALLS"], 8).fillna(-1, ["edge_id"])


@query(_bfs(PART, 8).replace("with recursive ", f"with recursive {A.NODES_SQL}, ", 1) + f", back as (select id, depth, parent, edge_id from first where id = {GOAL} union all select f.id, f.depth, f.parent, f.edge_id from back join first f on f.id = back.parent) select coalesce(string_agg(name, ' -> ' order by depth), '') as path, cast(count(*) - 1 as int) as hops from back join nodes using (id)")
def path_summary(spark, d):
    path = traverse.shortest_path(P.edges(spark, d, ("CALLS",)), PART, GOAL, ["CALLS"], 8)
    return traverse.path_summary(path, P.nodes(spark, d))


for _name, _ends, _t in (("call_tree", OUT, T), ("caller_tree", IN, T_IN)):

    def _run(spark, d, ends=_ends):
        out = traverse.call_tree(P.nodes(spark, d), P.edges(spark, d, ("CALLS",), ends[0]), PART, 3, ends)
        return out.select("id", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), F.array_join("children", ",").alias("children"))

    _run.__name__ = _name
    query(_bfs(PART, 3, _t) + "select f.id, f.depth, coalesce(f.parent, -1) as parent, coalesce(string_agg(cast(e.target_id as varchar), ',' order by e.id), '') as children from first f left join calls e on f.id = e.source_id and e.source_id <> e.target_id and f.depth < 3 group by f.id, f.depth, f.parent")(_run)


for _name, _ends, _t in (("call_hierarchy", OUT, T), ("caller_hierarchy", IN, T_IN)):

    def _run(spark, d, ends=_ends):
        out = traverse.call_hierarchy(P.nodes(spark, d), P.edges(spark, d, ("CALLS",), ends[0]), PART, 3, ends)
        return out.select("depth", "id", F.array_join("path", ",").alias("path"), "cyclic", "truncated")

    _run.__name__ = _name
    query(_t.rstrip() + f", tree as (select 0 as depth, cast({PART} as bigint) as id, [cast({PART} as bigint)] as path, false as cyclic union all select depth + 1, target_id, list_append(path, target_id), list_contains(path, target_id) from tree join calls on source_id = tree.id and source_id <> target_id where depth < 3 and not cyclic) select depth, id, array_to_string(path, ',') as path, cyclic, not cyclic and depth = 3 as truncated from tree")(_run)


@query(E.rstrip() + ", calls as (select * from edges where edge_type = 'CALLS'), two as (select a.source_id as x, a.target_id as y, b.target_id as z from calls a join calls b on b.source_id = a.target_id where a.target_id > a.source_id and b.target_id > a.source_id and b.target_id <> a.target_id), found as (select [source_id] as cycle from calls where source_id = target_id union all select [a.source_id, a.target_id] from calls a join calls b on b.source_id = a.target_id and b.target_id = a.source_id where a.source_id < a.target_id union all select [x, y, z] from two join calls c on c.source_id = z and c.target_id = x) select cast(len(cycle) as bigint) as length, array_to_string(cycle, ',') as cycle from found")
def cycles(spark, d):
    return traverse.cycles(P.edges(spark, d, ("CALLS",)), 3).select("length", F.array_join("cycle", ",").alias("cycle"))


@query(N.rstrip() + f", {A.EDGES_SQL}, {A.CONTENT_SQL} select 'nodes' as name, count(*) as rows from nodes union all select 'words', count(*) from nodes union all select unnest(['edges', 'edges_in']), count(*) from edges union all select 'content', count(*) from content union all select unnest(['symbol_size', 'content_size']), 1")
def build_index(spark, d):
    """All tables of the index, written anew; the postings are compared row by row in ``postings``."""
    return P.build(spark, d).filter("name not like '%postings'")
