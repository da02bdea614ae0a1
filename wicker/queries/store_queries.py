"""Writes, freshness, caches, source policy and plumbing over the adapted tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wicker.functions import text
from wicker.operators import stats, store
from wicker.queries.graph_queries import NE, N
from wicker.queries.registry import query
from wicker.session import checkpoint_folder
from wicker.sources import adapters as A
from wicker.sources import published as P
from wicker.sources import files
from wicker.streaming import incremental

D = f"with {A.FILES_SQL}, diff as (select coalesce(a.rel_path, b.rel_path) as rel_path, case when b.rel_path is null then 'added' when a.rel_path is null then 'deleted' when a.sha256 = b.sha256 then 'unchanged' else 'modified' end as status, a.rel_path is not null and b.rel_path is not null and not (a.size = b.size and a.mtime_ns = b.mtime_ns and a.ctime_ns = b.ctime_ns and a.file_id = b.file_id) as hashed from after a full join before b on a.rel_path = b.rel_path) "


@query(D + "select rel_path, status, hashed from diff")
def file_diff(spark, d):
    return store.file_diff(A.file_states(spark, d, False), A.file_states(spark, d, True))


_DOC_NODES = "select doc_id as id, 'p' as project, 'File' as label, 'doc' || doc_id as name, 'doc::' || doc_id as qualified_name, 'doc/' || doc_id || '.txt' as file_path"


@query(D + f", old as ({_DOC_NODES}, n_chars as end_line from documents where doc_id % 10 <> 2), now as ({_DOC_NODES}, n_chars + case when doc_id % 7 = 3 then 1 else 0 end as end_line from documents where doc_id % 10 <> 1) select id, qualified_name, end_line from now")
def incremental_equals_full(spark, d):
    """Nodes updated by the diff alone; the SQL takes them all anew."""
    docs = A.read(spark, d, "documents")
    node = lambda lines: [F.col("doc_id").alias("id"), F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("qualified_name"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), lines.alias("end_line")]
    old = docs.filter("doc_id % 10 <> 2").select(*node(F.col("n_chars")))
    new = docs.filter("doc_id % 10 <> 1").select(*node(F.col("n_chars") + (F.col("doc_id") % 7 == 3).cast("long")))
    diff = store.file_diff(A.file_states(spark, d, False), A.file_states(spark, d, True))
    return store.incremental(old, new, diff).select("id", "qualified_name", "end_line")


_CHANGED = "select id + 1000000 as id, project, 'Renamed' as label, name, qualified_name, file_path, start_line + 1 as start_line, end_line, properties from nodes where id % 40 = 4"


@query(N + f", fresh as ({_CHANGED}) select coalesce(n.id, f.id) as id, coalesce(f.label, n.label) as label, coalesce(f.start_line, n.start_line) as start_line, coalesce(n.qualified_name, f.qualified_name) as qualified_name from nodes n full join fresh f on f.qualified_name = n.qualified_name")
def upsert_nodes(spark, d):
    n = P.nodes(spark, d)
    new = n.filter("id % 40 = 4").withColumns({"id": F.col("id") + 1_000_000, "label": F.lit("Renamed"), "start_line": F.col("start_line") + 1})
    return store.upsert_nodes(n, new).select("id", "label", "start_line", "qualified_name")


@query(NE + "select id, source_id, target_id, edge_type, case when source_id % 3 = 0 then '{\"n\":1}' else properties end as properties from edges where edge_type = 'IMPORTS' union all select 5, 1, 2, 'IMPORTS', '{\"n\":1}'")
def upsert_edges(spark, d):
    e = P.edges(spark, d, ("IMPORTS",))
    new = e.filter("source_id % 3 = 0").withColumns({"id": F.lit(7).cast("long"), "properties": F.lit('{"n":1}')})
    extra = e.limit(1).withColumns({"id": F.lit(5).cast("long"), "source_id": F.lit(1).cast("long"), "target_id": F.lit(2).cast("long"), "properties": F.lit('{"n":1}')})
    return store.upsert_edges(e, new.unionByName(extra)).select("id", "source_id", "target_id", "edge_type", "properties")


@query(NE.rstrip() + f", {A.VECTORS_SQL}, kept as (select id from nodes where file_path not in ('part/Brand#3.sql', 'geo/nation.sql')) select 'nodes' as kind, count(*) as n from kept union all select 'edges', count(*) from edges where source_id in (select id from kept) and target_id in (select id from kept) union all select 'vectors', count(*) from vectors where node_id in (select id from kept)")
def delete_cascades(spark, d):
    paths = spark.createDataFrame([("part/Brand#3.sql",), ("geo/nation.sql",)], "rel_path string")
    left = store.delete_files(P.nodes(spark, d), P.edges(spark, d), A.vectors(spark, d), paths)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in zip(("nodes", "edges", "vectors"), left, strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


@query(f"with {A.CONTENT_SQL} select rel_path, line, case when rel_path like 'doc/1%' then translate(snippet, 'abcdefghij', 'ABCDEFGHIJ') else snippet end as snippet from content where not (rel_path like 'doc/1%' and line > 2)")
def replace_content(spark, d):
    c = P.content(spark, d)
    new = c.filter("rel_path like 'doc/1%' and line <= 2").withColumn("snippet", F.translate("snippet", "abcdefghij", "ABCDEFGHIJ"))
    every = store.replace_files(c, new)
    return every.filter("not (rel_path like 'doc/1%' and line > 2)").select("rel_path", "line", "snippet")


@query("select event_id as id, left(sha256(event_type || chr(31) || event_id), 16) as pack from events where epoch(ts) + 86400 > 1704153600 + 86400")
def live_packs(spark, d):
    e = A.read(spark, d, "events")
    packs = e.select(F.col("event_id").alias("id"), store.pack_id("event_type", F.col("event_id").cast("string")).alias("pack"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + store.PACK_SECONDS).alias("expires_at"))
    return store.live_packs(packs, F.lit(1704153600 + 86400)).select("id", "pack")


_CACHE = "cache as (select event_type as model_key, 'q' || event_id as query_text, epoch_us(ts) as last_accessed, cast(1000 + event_id % 9000 as bigint) as bytes from events), sums as (select count(*) as r, sum(bytes) as b from cache), ranked as (select *, row_number() over (order by last_accessed desc, model_key, query_text) as n, sum(bytes) over (order by last_accessed desc, model_key, query_text rows unbounded preceding) as upto from cache, sums)"


@query(f"with {_CACHE} select model_key, query_text from ranked where (r <= 10000 or n <= 8000) and (b <= 67108864 or upto <= 0.8 * 67108864)")
def pruned_cache(spark, d):
    e = A.read(spark, d, "events")
    cache = e.select(F.col("event_type").alias("model_key"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_text"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last_accessed"), (1000 + F.col("event_id") % 9000).alias("bytes"))
    return store.pruned_cache(cache).select("model_key", "query_text")


@query("with e as (select event_type as cache, 'f' || event_id as path, epoch_us(ts) // 1000000 as last_used, 1000 + event_id % 9000 as bytes from events), f as (select *, case when last_used >= 1705000000 - 500000 then bytes else 0 end as b from e), g as (select *, sum(b) over (partition by cache order by last_used desc, path rows unbounded preceding) as upto, sum(b) over (partition by cache) as whole from f) select cache, path, case when last_used < 1705000000 - 500000 then 'expired' when whole > 2000000 and upto > 1500000 then 'evicted' else 'kept' end as verdict from g")
def collected_cache(spark, d):
    e = A.read(spark, d, "events")
    entries = e.select(F.col("event_type").alias("cache"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("last_used"), (1000 + F.col("event_id") % 9000).alias("bytes"))
    return store.collected(entries, 1705000000, 500000, 2_000_000, 1_500_000).select("cache", "path", "verdict")


@query(f"with {A.FILES_SQL} select rel_path, case when size > 5000 then 'too large' when rel_path not in (select rel_path from after where size <= 5000 order by rel_path limit 100) then 'file limit' end as skip from after")
def skipped_by_limits(spark, d):
    return store.skipped_by_limits(A.file_states(spark, d, True), 100, 5000).select("rel_path", "skip")


_PAGE = "(select url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') || case page_id % 6 when 0 then '/main.py' when 1 then '/node_modules/x.js' when 2 then '/App.TSX' when 3 then '/a.min.js' when 4 then '/Makefile' else '/api.pb.go' end as path, page_id, length(html) as size from pages)"
_EXPECT = {0: "Python", 1: "JavaScript", 2: "Tsx", 3: "JavaScript", 4: "Makefile", 5: "Go"}


def _paths(spark, d):
    p = A.read(spark, d, "pages")
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "")
    ends = F.element_at(F.array(*map(F.lit, ("/main.py", "/node_modules/x.js", "/App.TSX", "/a.min.js", "/Makefile", "/api.pb.go"))), (F.col("page_id") % 6 + 1).cast("int"))
    return p.select("page_id", F.concat(plain, ends).alias("path"), F.length("html").alias("size"))


@query(f"select page_id, path, case page_id % 6 {' '.join(f'when {k} then {chr(39)}{v}{chr(39)}' for k, v in _EXPECT.items())} end as language from {_PAGE}")
def detected_language(spark, d):
    return _paths(spark, d).select("page_id", "path", files.language(F.col("path")).alias("language"))


@query(f"select page_id, case when page_id % 6 = 1 then 'folder' when page_id % 6 = 3 then 'suffix' when page_id % 6 = 5 then 'pattern' when size > 3000 then 'size' else '' end as reason from {_PAGE}")
def skip_reasons(spark, d):
    return _paths(spark, d).select("page_id", F.coalesce(files.skip_reason(F.col("path"), F.col("size"), 3000), F.lit("")).alias("reason"))


@query(f"select case when page_id % 6 = 1 then 'folder' when page_id % 6 = 3 then 'suffix' when page_id % 6 = 5 then 'pattern' end as reason, count(*) as n from {_PAGE} where page_id % 2 = 1 group by 1")
def skips_by_reason(spark, d):
    rows = _paths(spark, d).select(files.skip_reason(F.col("path"), F.col("size"), None).alias("reason")).filter("reason is not null")
    return stats.count_by(rows, "reason")


@query(f"select case page_id % 6 {' '.join(f'when {k} then {chr(39)}{v}{chr(39)}' for k, v in _EXPECT.items())} end as language, count(*) as seen, count(*) filter (page_id % 5 <> 0) as indexed, count(*) filter (page_id % 5 = 0) as failed from {_PAGE} group by 1")
def provider_counts(spark, d):
    rows = _paths(spark, d).select(F.concat("path", F.col("page_id").cast("string")).alias("rel_path"), files.language(F.col("path")).alias("language"), "page_id")
    skips = rows.filter("page_id % 5 = 0").select("rel_path", F.lit("failed").alias("reason"))
    return stats.provider_counts(rows, skips)


@query("select page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '_') as project, regexp_matches(replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '_'), '^[A-Za-z0-9_-][A-Za-z0-9._-]*$') as valid, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') as base, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*)/[^/]*$', 1) as dir from pages")
def path_functions(spark, d):
    p = A.read(spark, d, "pages")
    host = F.replace(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("."), F.lit("_"))
    plain = F.regexp_replace("url", "[?#].*$", "")
    return p.select("page_id", host.alias("project"), text.valid_project(host).alias("valid"), text.base_name(plain).alias("base"), text.dir_name(plain).alias("dir"))


@query("select item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as canonical, sha256(text) as sha from benchmark")
def text_functions(spark, d):
    return A.read(spark, d, "benchmark").select("item_id", text.canonical(F.col("text")).alias("canonical"), text.sha256_hex(F.col("text")).alias("sha"))


@query(NE + ", f as (select 'nodes' as figure, count(*) as n from nodes union all select 'edges', count(*) from edges union all select 'files', count(*) from documents union all select 'skips', count(*) from pages union all select 'incomplete providers', 1 union all select 'skip r' || (page_id % 3), count(*) from pages group by 1) select * from f")
def diagnostics(spark, d):
    skips = A.read(spark, d, "pages").select(F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string")).alias("reason"))
    providers = spark.createDataFrame([("Go", "accepted", []), ("Lua", "accepted", ["Calls"])], "language string, status string, unsupported array<string>")
    return stats.diagnostics(P.nodes(spark, d), P.edges(spark, d), A.read(spark, d, "documents"), skips, providers)


@query("select event_type, n, round(mean, 6) as mean, largest, p50, p95, error_rate from (select event_type, count(*) as n, avg(value) as mean, max(value) as largest, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, avg(case when value > 60 then 1.0 else 0.0 end) as error_rate from (select *, row_number() over (partition by event_type order by event_id desc) as r from events) where r <= 500 group by 1)")
def latency_counters(spark, d):
    out = stats.latency(A.read(spark, d, "events"), "event_id", "value", F.when(F.col("value") > 60, 1.0).otherwise(0.0), "event_type", 500)
    return out.withColumn("mean", F.round("mean", 6))


@query("select doc_id, max(n_chars) as n_chars from (select doc_id, n_chars from documents union all select doc_id, n_chars + 1 from documents where doc_id % 4 = 0) group by 1")
def followed_changes(spark, d):
    """Two batches of changes through the stream, then the published table."""
    docs = A.read(spark, d, "documents").select("doc_id", "n_chars", F.lit(1).alias("seq"))
    at = f"{checkpoint_folder(spark)}/follow-{uuid.uuid4().hex}"
    snapshots = incremental.Snapshots(spark, f"{at}/table")
    for batch in (docs, docs.filter("doc_id % 4 = 0").withColumns({"n_chars": F.col("n_chars") + 1, "seq": F.lit(2)})):
        batch.write.mode("append").parquet(f"{at}/changes")
        incremental.follow(spark, f"{at}/changes", "doc_id long, n_chars long, seq int", snapshots, ["doc_id"], "seq", f"{at}/offsets")
    return snapshots.read().select("doc_id", "n_chars")
