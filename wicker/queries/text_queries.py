"""Full-text and word-based semantic search over the adapted graph and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.functions import minhash, text
from wicker.operators import lexical, semantic, stats
from wicker.queries.graph_queries import PART, N, NE
from wicker.queries.registry import query
from wicker.sources import adapters as A
from wicker.sources import published as P


def camel_sql(x: str) -> str:
    """The words of an identifier in DuckDB."""
    s = rf"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    return rf"translate(trim(regexp_replace({s}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '{text.UPPER}', '{text.LOWER}')"


def tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def words_sql(x: str) -> str:
    """Distinct words of ``camel_split``."""
    return f"list_distinct(list_filter(string_split({camel_sql(x)}, ' '), lambda t: t <> ''))"


def bm25_sql(docs: str, tfs: list[str], columns: str) -> str:
    """docs (with tokens) -> columns and rank_score; tfs are counts over ``tokens``."""
    k = range(len(tfs))
    idf = [f"greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 1e-6)" for i in k]
    score = " + ".join(f"{idf[i]} * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * len(tokens) * n / total))" for i in k)
    counted = f"select *, {', '.join(f'{t} as tf_{i}' for i, t in enumerate(tfs))} from ({docs})"
    known = f"select count(*)::double as n, sum(len(tokens))::double as total, {', '.join(f'(count(*) filter (tf_{i} > 0))::double as df_{i}' for i in k)} from counted"
    return f"(with counted as ({counted}), known as ({known}) select {columns}, round(-({score}), 9) as rank_score from counted, known where {' and '.join(f'tf_{i} > 0' for i in k)})"


_BOTH = tokens_sql(camel_sql("name") + " || ' ' || " + camel_sql("qualified_name"))
_SYMBOLS = f"select *, {_BOTH} || {tokens_sql('qualified_name')} || {tokens_sql('label')} || {tokens_sql('file_path')} as tokens from nodes"
_PREFIX = [f"len(list_filter(tokens, lambda t: starts_with(t, '{t}')))" for t in ("brand", "ri", "1")]
_FOUND = bm25_sql(_SYMBOLS, _PREFIX, "id, name, qualified_name, project")


@query(N + f"select cast(row_number() over (order by rank_score, id) as int) as rank, id, name, qualified_name, rank_score from {_FOUND} order by rank limit 30")
def search_symbols(spark, d):
    return lexical.search_symbols(P.nodes(spark, d), "brandRi 1", 30, "tpch", P.symbol_index(spark, d)).select("rank", "id", "name", "qualified_name", "rank_score")


@query(N + f"select count(*) as n from {_FOUND}")
def count_symbols(spark, d):
    return lexical.count_symbols(P.nodes(spark, d), "brandRi 1", P.symbol_index(spark, d))


_LINES = f"select *, {tokens_sql('strip_accents(snippet)')} as tokens from content"
_PHRASES = [
    "len(list_filter(tokens, lambda t: t = 'the'))",
    "len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'of' and tokens[i + 1] = 'the'))",
]
_HITS = bm25_sql(_LINES, _PHRASES, "rel_path, line, snippet")
_C = f"with {A.CONTENT_SQL} "


@query(_C + f"select cast(row_number() over (order by rank_score, rel_path, line) as int) as rank, rel_path, line, rank_score from {_HITS} order by rank limit 20")
def search_content(spark, d):
    return lexical.search_code(P.content(spark, d), "the of-the", 20, index=P.content_index(spark, d)).select("rank", "rel_path", "line", "rank_score")


@query(_C + f"select count(*) as n from {_HITS}")
def count_content(spark, d):
    return lexical.count_content(P.content(spark, d), "the of-the", P.content_index(spark, d))


_QUOTED = bm25_sql(_LINES, ["len(list_filter(tokens, lambda t: t = 'by'))", _PHRASES[0]], "rel_path, line, snippet")


@query(_C + f", hits as (select *, contains(lower(snippet), 'by the') as exact from {_QUOTED}), shown as (select cast(row_number() over (order by exact desc, rank_score, rel_path, line) as int) as rank, * from hits order by rank limit 50) select rank, rel_path, line, exact, rank_score, case when max(rank_score) over () = min(rank_score) over () then 1.0::double else (max(rank_score) over () - rank_score) / (max(rank_score) over () - min(rank_score) over ()) end as relevance from shown")
def search_code_ranked(spark, d):
    return lexical.search_code_ranked(P.content(spark, d), '"by the"', 50, P.content_index(spark, d)).select("rank", "rel_path", "line", "exact", "rank_score", "relevance")


@query(_C + f", changed as (select rel_path from (with {A.FILES_SQL} select a.rel_path from after a join before b using (rel_path) where a.sha256 <> b.sha256)) select rel_path, line from content where rel_path in (select rel_path from changed) and regexp_matches(snippet, '\\b[Tt]he [a-z]+ing\\b')")
def search_changed(spark, d):
    before, after = A.file_states(spark, d, False), A.file_states(spark, d, True)
    changed = after.join(before.select("rel_path", F.col("sha256").alias("was")), "rel_path").filter("sha256 <> was")
    return lexical.search_changed(P.content(spark, d), changed, r"\b[Tt]he [a-z]+ing\b").select("rel_path", "line")


@query("select doc_id, cast(p as int) as line, regexp_replace(raw, '\\s+$', '') as snippet from (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as p from documents) where regexp_replace(raw, '\\s+$', '') <> ''")
def content_rows(spark, d):
    files = A.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), "text")
    return lexical.content_rows(files).select(F.col("rel_path").cast("long").alias("doc_id"), "line", "snippet")


@query(N + f"select id, {camel_sql('qualified_name')} as words from nodes")
def camel_split(spark, d):
    return P.nodes(spark, d).select("id", text.camel_split(F.col("qualified_name")).alias("words"))


@query(N + f"select token, count(*) as df from (select id, unnest({words_sql('name || chr(32) || qualified_name')}) as token from nodes) group by 1")
def document_frequency(spark, d):
    rows = semantic.with_tokens(P.nodes(spark, d))
    return stats.document_frequency(rows, "id", F.col("tokens"))


@query(_C + f"select rel_path, line, token, count(*) as tf, any_value(len(tokens)) as length from (select rel_path, line, tokens, unnest(tokens) as token from ({_LINES})) group by all")
def postings(spark, d):
    return P.content_index(spark, d).postings.select("rel_path", "line", "token", "tf", "length")


@query(N + f"select id, token, count(*) as tf, any_value(len(tokens)) as length from (select id, tokens, unnest(tokens) as token from ({_SYMBOLS})) group by all")
def symbol_postings(spark, d):
    return P.symbol_index(spark, d).postings.select("id", "token", "tf", "length")


# Semantic scores. The 64-bit wrap-around of the signatures is a modulus of 128-bit numbers in SQL.


def overlap_sql(rows: str, own: str, terms: list[str], base: str | None = None) -> str:
    """rows (with id) -> id, jaccard, meets; ``own`` are a row's words, ``base`` those that are counted."""
    asked = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    words = f"words as (select id, unnest({own}) as token from ({rows}))"
    counted = f"counted as (select id, unnest({base or own}) as token from ({rows}))"
    df = "freq as (select token, count(*) as df from counted group by 1), docs as (select count(distinct id)::double as docs from counted)"
    weigh = "ln((docs + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0"
    whole = f"whole as (select sum({weigh}) as query_w from (select unnest({asked}) as token) left join freq using (token), docs)"
    sums = f"sums as (select id, sum({weigh}) as node_w, sum(case when token in {asked} then {weigh} else 0 end) as inter_w from words left join freq using (token), docs group by 1)"
    return f"(with {words}, {counted}, {df}, {whole}, {sums} select id, inter_w / (node_w + query_w - inter_w) as jaccard, inter_w > 0 as meets from sums, whole)"


_NAMES = words_sql("name || chr(32) || qualified_name")
_ASK = ["red", "plate", "function", "brand"]
_ANCHOR = f"anchor as (select id from nodes where len({words_sql('name')}) > 0 and list_has_all(['red', 'plate', 'function', 'brand'], {words_sql('name')}) order by qualified_name, id limit 1)"
_NEAR = "near as (select distinct case when source_id = a.id then target_id else source_id end as id from edges e join anchor a on source_id = a.id or target_id = a.id where edge_type in ('CALLS', 'USES', 'IMPORTS') and source_id <> target_id)"
_SEGMENTS = f"list_distinct(flatten(list_transform(list_filter(string_split_regex(qualified_name, '[:/.]'), lambda x: x <> '')[:-2], lambda x: list_filter(string_split({camel_sql('x')}, ' '), lambda t: t <> ''))))"
_SCORED = f"scored as (select n.id, n.label, n.qualified_name, jaccard as token_overlap, case when lower(label) = 'function' then 0.15 else 0.0 end::double as label_affinity, case when file_path like 'part/%' then 0.1 else 0.0 end::double as file_proximity, case when len({_SEGMENTS}) = 0 then 0.0 else len(list_intersect({_SEGMENTS}, ['red', 'plate', 'function', 'brand'])) / len({_SEGMENTS}) * 0.12 end::double as qname_path, case when n.id in (select id from near) then 0.14 else 0.0 end::double as edge_proximity from nodes n join {overlap_sql('select * from nodes', _NAMES, _ASK)} using (id) where meets or n.id in (select id from near))"


@query(NE.rstrip() + f", {_ANCHOR}, {_NEAR}, {_SCORED} select id, qualified_name, round(token_overlap, 6) as token_overlap, label_affinity, file_proximity, round(qname_path, 6) as qname_path, edge_proximity from scored")
def semantic_breakdown(spark, d):
    asked = "red plate function Brand"
    nodes, edges, terms = P.words(spark, d), P.edges(spark, d, ("CALLS", "IMPORTS")), lexical.query_terms(asked)
    found = semantic.score(semantic.without_pseudo(nodes), terms, asked, "part/x.sql", semantic.near(edges, semantic.resolve_anchor(nodes, terms)))
    return found.select("id", "qualified_name", F.round("token_overlap", 6).alias("token_overlap"), "label_affinity", "file_proximity", F.round("qname_path", 6).alias("qname_path"), "edge_proximity")


def signature_sql(rows: str, terms: list[str]) -> str:
    """CTEs up to ``agree`` (id, a): the share of slots in which the signatures of a row's words and of the terms agree."""
    whole = "18446744073709551616::uhugeint"
    spread = lambda x, shift, factor: f"xor({x}, {x} // {1 << shift}::uhugeint) * {factor}::uhugeint % {whole}"
    start = f"xor({minhash.OFFSET}::uhugeint, slot::uhugeint * {minhash.PRIME}::uhugeint % {whole})"
    fed = f"list_reduce(list_prepend({start}, list_transform(range(1, len(token) + 1), lambda i: ord(token[i])::uhugeint)), lambda x, c: xor(x, c) * {minhash.PRIME}::uhugeint % {whole})"
    steps = f"fed as (select token, slot, {fed} as h from toks, range({minhash.SLOTS}) as r(slot)), once as (select token, slot, {spread('h', 30, minhash.FINISH[0])} as h from fed), mixed as (select token, slot, {spread('h', 27, minhash.FINISH[1])} as h from once), hashed as (select token, slot, (xor(h, h // {1 << 31}::uhugeint) % {1 << 32}::uhugeint)::bigint as v from mixed)"
    return f"worded as (select id, unnest({_NAMES}) as token from ({rows})), toks as (select token from worded union select unnest({terms}::varchar[])), {steps}, own as (select id, slot, min(v) as v from worded join hashed using (token) group by 1, 2), asked as (select slot, min(v) as v from hashed where list_contains({terms}::varchar[], token) group by 1), agree as (select id, (count(*) filter (own.v = asked.v))::double / {minhash.SLOTS} as a from own join asked using (slot) group by 1)"


def scored_sql(rows: str, terms: list[str], anchors: list[list[str]], label: str = "", folder: str = "", extra: float = 0.0) -> str:
    """CTEs up to ``ranking``: rows with all parts of their score, and the score."""
    own = words_sql("name")
    one = " union ".join(f"(select id from rows where len({own}) > 0 and list_has_all({t}, {own}) order by qualified_name, id limit 1)" for t in anchors)
    near = "near as (select id, count(*) as k from (select distinct a.id as anchor, case when source_id = a.id then target_id else source_id end as id from edges e join anchor a on source_id = a.id or target_id = a.id where edge_type in ('CALLS', 'USES', 'IMPORTS') and source_id <> target_id) where id not in (select id from anchor) group by 1)"
    segments = _SEGMENTS
    path = f"case when len({segments}) = 0 then 0.0 else len(list_intersect({segments}, {terms})) / len({segments}) * 0.12 end::double"
    parts = f"parts as (select n.*, jaccard as token_overlap, case when lower(label) = '{label}' then 0.15 else 0.0 end::double as label_affinity, case when '{folder}' <> '' and regexp_replace(file_path, '/[^/]*$', '') = '{folder}' then 0.1 else 0.0 end::double as file_proximity, case when a > 0.3 then (a - 0.3) / (1 - 0.3) * 0.1 else 0.0 end::double as simhash, {path} as qname_path, case when near.id is not null then 0.14 + {extra} * (near.k - 1) else 0.0 end::double as edge_proximity from rows n join {overlap_sql('select * from rows', _NAMES, terms)} o using (id) left join agree using (id) left join near on near.id = n.id where meets or near.id is not null)"
    return f"rows as ({rows}), anchor as ({one}), {near}, {signature_sql('select * from rows', terms)}, {parts}, ranking as (select *, round(token_overlap + label_affinity + file_proximity + simhash + qname_path + edge_proximity, 9) as score from parts) "


def best(columns: str, limit: int, source: str = "ranking") -> str:
    return f"select cast(row_number() over (order by score desc, qualified_name, id desc) as int) as rank, {columns} from {source} order by rank limit {limit}"


_ALL = "select * from nodes"


@query(NE.rstrip() + ", " + scored_sql(_ALL, _ASK, [_ASK], "function", "part") + best("id, qualified_name, score, round(simhash, 9) as simhash", 40))
def semantic_query(spark, d):
    return semantic.semantic_query(P.words(spark, d), P.edges(spark, d, ("CALLS", "IMPORTS")), "red plate function Brand", 40, "part/x.sql").select("rank", "id", "qualified_name", "score", F.round("simhash", 9).alias("simhash"))


@query(NE.rstrip() + ", " + scored_sql("select * from nodes where label = 'Function'", ["red", "plate", "brand", "2"], [["red", "plate", "brand", "2"]]) + best("id, qualified_name, score", 40))
def semantic_query_expanded(spark, d):
    return semantic.semantic_query_expanded(P.words(spark, d), P.edges(spark, d, ("CALLS", "IMPORTS")), "redPlate Brand#2", 40, labels=("Function",)).select("rank", "id", "qualified_name", "score")


@query(NE.rstrip() + ", " + scored_sql(_ALL, ["small", "ring"], [["red", "plate"], ["hot", "rod"]], extra=0.14) + best("id, qualified_name, score, round(edge_proximity, 9) as edge_proximity", 40))
def semantic_query_multi_anchor(spark, d):
    out = semantic.semantic_query_multi_anchor(P.words(spark, d), P.edges(spark, d, ("CALLS", "IMPORTS")), "small ring", ["red plate", "hot rod"], 40)
    return out.select("rank", "id", "qualified_name", "score", F.round("edge_proximity", 9).alias("edge_proximity"))


_DIVERSE = "shown as (" + best("*", 160) + "), few as (select * exclude (rank, r) from (select *, row_number() over (partition by file_path, name order by rank) as r from shown) where r <= 1) "


@query(NE.rstrip() + ", " + scored_sql(_ALL, ["red", "plate"], [["red", "plate"]]).rstrip() + ", " + _DIVERSE + best("id, file_path, name, score, round(least(greatest(score / 1.61, 0.0), 1.0), 9) as confidence", 20, "few"))
def semantic_query_diversified(spark, d):
    out = semantic.semantic_query_diversified(P.words(spark, d), P.edges(spark, d, ("CALLS", "IMPORTS")), "red plate", 20, 1)
    return out.select("rank", "id", "file_path", "name", "score", F.round("confidence", 9).alias("confidence"))


_RELATED = "related as (select n.id, n.qualified_name, n.id in (select id from near) as edge_adjacent, round(jaccard + case when n.id in (select id from near) then 0.5 else 0.0 end, 9) as score from nodes n join " + overlap_sql("select * from nodes", words_sql("name"), ["red", "plate"], _NAMES) + " using (id) where n.id not in (select id from anchor) and (meets or n.id in (select id from near)))"


@query(NE.rstrip() + f", {_ANCHOR.replace(str(_ASK), str(['red', 'plate']))}, {_NEAR}, {_RELATED} select cast(row_number() over (order by score desc, qualified_name, id desc) as int) as rank, id, score, edge_adjacent from related order by rank limit 60")
def related_symbols(spark, d):
    return semantic.related_symbols(P.nodes(spark, d), P.edges(spark, d, ("CALLS", "IMPORTS")), "red plate", 60).select("rank", "id", "score", "edge_adjacent")


_DOC = overlap_sql("select * from nodes", words_sql("json_extract_string(properties, '$.doc')"), ["economy", "ring"])


@query(N + f"select cast(row_number() over (order by round(jaccard, 9) desc, qualified_name, id desc) as int) as rank, id, round(jaccard, 9) as score from nodes join {_DOC} using (id) where meets order by rank limit 50")
def semantic_query_fielded(spark, d):
    return semantic.semantic_query_fielded(P.nodes(spark, d), "economy ring", "doc", 50).select("rank", "id", "score")


_LINED = "lined as (select n.id, slot, coalesce(v, 4294967295) as v from nodes n cross join range(64) as r(slot) left join own using (id, slot)), other as (select slot, v from lined where id = 25)"


@query(N.rstrip() + ", " + signature_sql(_ALL, ["x"]) + f", {_LINED} select id, string_agg(l.v::varchar, ',' order by slot) as signature, (count(*) filter (l.v = o.v))::double / 64 as jaccard, cast(count(*) filter (l.v <> o.v) as int) as hamming, bool_and(l.v = 4294967295) as empty from lined l join other o using (slot) group by 1")
def minhash_signatures(spark, d):
    own = P.words(spark, d)
    one = own.filter("id = 25").select(F.col("signature").alias("other"))
    return own.crossJoin(F.broadcast(one)).select("id", F.array_join("signature", ",").alias("signature"), minhash.agreement(F.col("signature"), F.col("other")).alias("jaccard"), minhash.hamming(F.col("signature"), F.col("other")).alias("hamming"), minhash.is_empty(F.col("signature")).alias("empty"))


@query(NE.rstrip() + f", anchor as (select cast({PART} as bigint) as id), {_NEAR} select id, 1::bigint as anchors from near")
def near_nodes(spark, d):
    anchor = spark.createDataFrame([(PART,)], "id bigint")
    return semantic.near(P.edges(spark, d), anchor)
