"""The commands of an index, by name, over the published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker import schema
from wicker.operators import store
from wicker.operators.graph import IN, OUT
from wicker.operators.graphquery import GraphQuery
from wicker.plans.commands import Index
from wicker.queries.graph_queries import NE, NODE, N, T, _BFS, _reach, top
from wicker.queries.registry import query
from wicker.queries.text_queries import _FOUND, best, scored_sql
from wicker.queries.vector_queries import _BEST, ASKED
from wicker.sources import adapters as A
from wicker.sources import published as P

NAME, OTHER = "red plate", "hot rod"
COLUMNS = ", ".join(NODE[1:])
#: A line for each place where a node begins: its first name.
LINES_SQL = "source_lines as (select file_path as rel_path, start_line as line, min(name) as snippet from nodes group by all)"


def one(name: str) -> str:
    """The node that a name means: the first by qualified name."""
    return f"(select id from nodes where name = '{name}' order by qualified_name, id limit 1)"


def index(spark, d, end: str = "source_id") -> Index:
    lines = P.nodes(spark, d).groupBy(F.lit(A.PROJECT).alias("project"), F.col("file_path").alias("rel_path"), F.col("start_line").alias("line")).agg(F.min("name").alias("snippet"))
    return Index(P.words(spark, d), P.edges(spark, d, None, end), lines, A.vectors(spark, d))


for _name, _ends in (("command_callees", OUT), ("command_who_calls", IN)):
    _sql = NE + top(f"select n.*, edge_id from nodes n join (select {_ends[1]} as i, min(id) as edge_id from edges where edge_type = 'CALLS' and {_ends[0]} = {one(NAME)} and {_ends[1]} <> {one(NAME)} group by 1) on i = n.id", "edge_id", columns=f"{COLUMNS}, edge_id")

    def _run(spark, d, ends=_ends):
        asked = index(spark, d, ends[0])
        return (asked.callees(NAME) if ends is OUT else asked.who_calls(NAME)).select(*NODE, "edge_id")

    _run.__name__ = _name
    query(_sql)(_run)


@query(NE + top(f"select distinct n.*, e.edge_type from nodes n join edges e on e.source_id = n.id join nodes t on t.id = e.target_id where t.name = '{NAME}' and e.source_id <> e.target_id", "qualified_name, id, edge_type", schema.MAX_ROWS, f"{COLUMNS}, edge_type"))
def command_references(spark, d):
    return index(spark, d, "target_id").references(NAME).select(*NODE, "edge_type")


_REC = f"with recursive {A.NODES_SQL}, {A.EDGES_SQL}, "


@query(_REC + _reach("select * from edges", one("NATION_3"), 2, "target_id", "source_id") + top(f"select n.*, hops from nodes n join seen using (id) where id <> {one('NATION_3')}", "hops, qualified_name, id", schema.MAX_ROWS, f"{COLUMNS}, hops"))
def command_impact(spark, d):
    return index(spark, d, "target_id").impact("NATION_3", 2).select(*NODE, "hops")


_PLACES = [("part/Brand#1.sql", 60), ("part/Brand#2.sql", 333), ("geo/nation.sql", 45), ("nowhere", 1)]
_STARTS = f"places as (select * from (values {', '.join(f'({chr(39)}{p}{chr(39)}, {n})' for p, n in _PLACES)}) as t(file_path, line)), starts as (select distinct id from (select n.id, row_number() over (partition by p.file_path, p.line order by n.start_line desc, n.end_line, n.qualified_name, n.id) as r from places p join nodes n on n.file_path = p.file_path and n.start_line <= p.line and p.line <= n.end_line) where r = 1)"


@query(_REC + f"{_STARTS}, walk as (select id, 0 as h from starts union select source_id, h + 1 from walk join edges on target_id = walk.id where h < 1), seen as (select id, min(h) as hops from walk group by 1) " + top("select n.*, hops from nodes n join seen using (id) where hops > 0", "hops, qualified_name, id", schema.MAX_ROWS, f"{COLUMNS}, hops"))
def command_impact_since(spark, d):
    """What depends on the symbols in which some changed lines lie."""
    hunks = spark.createDataFrame(_PLACES, "file_path string, line long")
    return index(spark, d, "target_id").impact_since(hunks, 1).select(*NODE, "hops")


_SIDES = " union all ".join(f"select '{part}' as part, n.id, n.qualified_name from nodes n where id in (select {b} from edges where edge_type = 'CALLS' and {a} = {one(NAME)} and {b} <> {one(NAME)})" for part, a, b in (("callees", *OUT), ("callers", *IN)))


@query(NE + f"select 'symbol' as part, id, qualified_name from nodes where name = '{NAME}' union all {_SIDES}")
def command_brief(spark, d):
    parts = index(spark, d).brief(NAME)
    return reduce(DataFrame.unionByName, (rows.select(F.lit(part).alias("part"), "id", "qualified_name") for part, rows in parts.items()))


def _found(start: str, hops: int) -> str:
    return _BFS.format(pre=T.rstrip(), start=start, hops=hops).replace("with recursive ", f"with recursive {A.NODES_SQL}, ", 1)


@query(_found(one(NAME), 5) + f", back as (select id, depth, parent, edge_id from first where id = {one(OTHER)} union all select f.id, f.depth, f.parent, f.edge_id from back join first f on f.id = back.parent) select depth as step, id, coalesce(edge_id, -1) as edge_id from back")
def command_path(spark, d):
    return index(spark, d).path(NAME, OTHER, 5).fillna(-1, ["edge_id"])


@query(_found(one(NAME), 2) + "select id, name, qualified_name, depth, coalesce(parent, -1) as parent, coalesce(edge_id, -1) as edge_id from first join nodes using (id)")
def command_trace(spark, d):
    return index(spark, d).trace(NAME, 2).fillna(-1, ["parent", "edge_id"]).select("id", "name", "qualified_name", "depth", "parent", "edge_id")


@query(N + "select id, qualified_name, start_line, end_line from nodes where file_path = 'part/Brand#2.sql' and start_line <= 333 and end_line >= 333 order by start_line desc, end_line, qualified_name, id limit 1")
def command_locate(spark, d):
    return index(spark, d).locate("part/Brand#2.sql", 333).select("id", "qualified_name", "start_line", "end_line")


for _name, _ends in (("command_fan_out", OUT), ("command_fan_in", IN)):
    _sql = NE + top(f"select n.*, k as degree from nodes n join (select {_ends[0]} as i, count(*) as k from edges where edge_type = 'CALLS' group by 1) on i = id", "degree desc, qualified_name, id", 15, f"{COLUMNS}, degree")

    def _run(spark, d, ends=_ends):
        asked = index(spark, d)
        return (asked.fan_out(15) if ends is OUT else asked.fan_in(15)).select(*NODE, "degree")

    _run.__name__ = _name
    query(_sql)(_run)


@query(NE + top("select * from nodes n where label = 'Function' and name ilike '%ring%' and exists (select 1 from edges e where e.source_id = n.id and e.edge_type = 'CALLS')", "file_path, start_line, qualified_name, id", 30))
def command_search_graph(spark, d):
    return index(spark, d).search_graph(GraphQuery(label="Function", name_contains="ring", has_outgoing="CALLS", order="file", limit=30)).select(NODE)


@query(N + f"select cast(row_number() over (order by rank_score, id) as int) as rank, id, qualified_name, rank_score from {_FOUND} order by rank limit 20")
def command_search_symbols(spark, d):
    return index(spark, d).search_symbols("brandRi 1").select("rank", "id", "qualified_name", "rank_score")


def _line_hits(word: str) -> str:
    """Scores of source lines with a word, by BM25."""
    tokens = r"list_filter(regexp_split_to_array(lower(snippet), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
    idf = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
    return f"{LINES_SQL}, tokened as (select *, {tokens} as tokens, len(list_filter({tokens}, lambda t: t = '{word}')) as tf from source_lines), known as (select count(*)::double as n, sum(len(tokens))::double as total, (count(*) filter (tf > 0))::double as df from tokened), line_hits as (select rel_path, line, snippet, round(-({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) * n / total))), 9) as rank_score from tokened, known where tf > 0)"


@query(N.rstrip() + f", {_line_hits('anvil')} select cast(row_number() over (order by rank_score, rel_path, line) as int) as rank, rel_path, line, snippet, rank_score from line_hits order by rank limit 20")
def command_search_code(spark, d):
    return index(spark, d).search_code("anvil").select("rank", "rel_path", "line", "snippet", "rank_score")


@query(f"with {A.VECTORS_SQL}, {_BEST.replace(' and graph_generation = 2', '')}, hits as (select cast(row_number() over (order by score desc, qualified_name, chunk_idx, node_id) as int) as rank, * from best order by rank limit 10), {A.NODES_SQL} select rank, node_id, coalesce(n.qualified_name, hits.qualified_name) as qualified_name, score from hits left join nodes n on n.id = node_id")
def command_vector_search(spark, d):
    return index(spark, d).vector_search(ASKED, 10).select("rank", "node_id", "qualified_name", "score")


@query(NE.rstrip() + ", " + scored_sql("select * from nodes", ["red", "plate"], [["red", "plate"]]) + best("id, qualified_name, score", 20))
def command_semantic_search(spark, d):
    return index(spark, d).semantic_search("red plate").select("rank", "id", "qualified_name", "score")


_WORD = "anvil"
_FUSED = f"""{_line_hits(_WORD)}, shown as (select rel_path, line, row_number() over (order by rank_score, rel_path, line) as rank from line_hits order by rank limit 200),
 at_ as (select id, rank from (select n.id, s.rank, row_number() over (partition by s.rel_path, s.line order by n.start_line desc, n.end_line, n.qualified_name, n.id) as r from shown s join nodes n on n.file_path = s.rel_path and n.start_line <= s.line and s.line <= n.end_line) where r = 1),
 by_word as ({best("id, qualified_name", 200)}),
 parts_ as (select id, 0.6 / (rank + 60) as part from by_word union all select id, 0.8 / (rank + 60) from by_symbol union all select id, 1.0 / (rank + 60) from at_),
 sums_ as (select id, sum(part) as own from parts_ group by 1),
 strong as (select id from sums_ order by round(own, 9) desc, id limit 5),
 next_ as (select distinct case when source_id = s.id then target_id else source_id end as id from edges e join strong s on source_id = s.id or target_id = s.id where edge_type in ('CALLS', 'USES', 'IMPORTS') and source_id <> target_id),
 total as (select id, round(sum(part), 9) as score from (select id, own as part from sums_ union all select id, 0.3 / 60 from next_ where id not in (select id from strong)) group by 1)
 select cast(row_number() over (order by t.score desc, n.qualified_name, n.id) as int) as rank, n.id, n.qualified_name, t.score from total t join nodes n on n.id = t.id order by 1 limit 20"""


def _symbol_ranks(word: str) -> str:
    from wicker.queries.text_queries import _SYMBOLS, bm25_sql

    found = bm25_sql(_SYMBOLS, [f"len(list_filter(tokens, lambda t: starts_with(t, '{word}')))"], "id")
    return f"by_symbol as (select id, row_number() over (order by rank_score, id) as rank from {found} order by rank limit 200)"


@query(NE.rstrip() + ", " + scored_sql("select * from nodes", [_WORD], [[_WORD]]).rstrip() + f", {_symbol_ranks(_WORD)}, {_FUSED}")
def command_plus(spark, d):
    """Lines, symbols, words and their neighbours in one ranking; no vector is asked for."""
    return index(spark, d).fused_search(_WORD).select("rank", "id", "qualified_name", "score")


@query(N.rstrip() + f", {LINES_SQL}, span as (select file_path, start_line, end_line from nodes where name = '{NAME}' order by qualified_name, id limit 1) select rel_path, line, snippet from source_lines join span on file_path = rel_path where line between start_line and least(end_line, start_line + 59)")
def command_context(spark, d):
    return index(spark, d).context(NAME).select("rel_path", "line", "snippet")


@query(N + f"select least(count(*), 40) as shown, greatest(count(*) - 40, 0) as omitted, count(*) as total_exact, count(*) > 40 as truncated from nodes where name = '{NAME}'")
def command_bounds(spark, d):
    """How a command tells what it shows and what it leaves out."""
    asked = index(spark, d)
    out = asked.shown(asked.nodes.filter(F.col("name") == NAME))
    return out["rows"].agg(F.count("*").alias("shown")).select("shown", F.lit(out["omitted"]).cast("long").alias("omitted"), F.lit(out["total_exact"]).cast("long").alias("total_exact"), F.lit(out["truncated"]).alias("truncated"))


@query("select event_id as id, left(sha256(event_type || chr(31) || event_id), 16) as pack from events where event_id = (select min(event_id) from events where epoch(ts) > 1704153600)")
def command_expand(spark, d):
    e = A.read(spark, d, "events")
    packs = e.select(F.col("event_id"), store.pack_id("event_type", F.col("event_id").cast("string")).alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + store.PACK_SECONDS).alias("expires_at"))
    wanted = packs.filter(F.col("expires_at") > 1704153600 + store.PACK_SECONDS).agg(F.min(F.struct("event_id", "id"))["id"].alias("id")).first()["id"]  # one row
    return index(spark, d).expand(packs, wanted, 1704153600 + store.PACK_SECONDS).select(F.col("event_id").alias("id"), F.col("id").alias("pack"))


@query(NE + ", f as (select 'nodes' as figure, count(*) as n from nodes union all select 'edges', count(*) from edges union all select 'files', count(distinct file_path) from nodes union all select 'status fresh', 1) select figure, n from f")
def command_status(spark, d):
    return index(spark, d).status_figures()


@query("select * from (values ('fresh', true), ('stale', false), ('root mismatch', false), ('unknown', true)) as t(status, answers)")
def command_refusal(spark, d):
    """A stale index answers no query."""
    out = []
    for status in ("fresh", "stale", "root mismatch", "unknown"):
        asked = index(spark, d)
        asked.status = status
        try:
            asked.references(NAME)
            out.append((status, True))
        except RuntimeError:
            out.append((status, False))
    return spark.createDataFrame(out, "status string, answers boolean")
