"""A symbol graph, content lines, vectors and file states out of the driver's tables.

Each relation is there twice: as DataFrames, and as SQL text for DuckDB. Ids come
from keys, never from a global ordering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "tpch"
KINDS = {"CALLS": 0, "IMPORTS": 1, "USAGE": 2}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _span(key: Column) -> tuple[Column, Column]:
    """Four keys in a row nest: one around, one inside it, two inside that."""
    base, place = F.floor(key / 4) * 40 + 1, key % 4
    first = F.element_at(F.array(*map(F.lit, (0, 5, 10, 22))), (place + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, (39, 34, 20, 30))), (place + 1).cast("int"))
    return (base + first).cast("long"), (base + last).cast("long")


def _nodes_of(df: DataFrame, kind: int, key: str, label: Column, name: Column, qname: Column, path: Column, doc: Column) -> DataFrame:
    key = F.col(key).cast("long")
    first, last = _span(key)
    props = F.concat(F.lit('{"doc":"'), doc, F.lit('","url_path":"/'), path, F.lit('"}'))
    columns = ((key * 8 + kind), F.lit(PROJECT), label, name, qname, path, first, last, props)
    names = ("id", "project", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties")
    return df.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit, cat = F.col, F.lit, F.concat
    region, nation, customer, supplier, part = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part"))
    kind = F.when(c("p_partkey") % 5 == 0, "Method").when(c("p_partkey") % 11 == 0, "Struct").otherwise("Function")
    parts = [
        _nodes_of(region, 0, "r_regionkey", lit("Module"), c("r_name"), cat(lit("geo::"), c("r_name")), lit("geo/region.sql"), c("r_name")),
        _nodes_of(nation, 1, "n_nationkey", lit("Class"), c("n_name"), cat(lit("geo::nation::"), c("n_name")), lit("geo/nation.sql"), c("n_name")),
        _nodes_of(customer, 2, "c_custkey", lit("Variable"), c("c_name"), cat(lit("customer::"), c("c_mktsegment"), lit("::"), c("c_name")), cat(lit("customer/"), c("c_mktsegment"), lit(".sql")), c("c_mktsegment")),
        _nodes_of(supplier, 3, "s_suppkey", lit("Interface"), c("s_name"), cat(lit("supplier::"), c("s_name")), lit("supplier.sql"), c("s_name")),
        _nodes_of(part, 4, "p_partkey", kind, c("p_name"), cat(c("p_type"), lit("::"), c("p_brand"), lit("::Part"), c("p_partkey").cast("string"), lit("OfSize"), c("p_size").cast("string")), cat(lit("part/"), c("p_brand"), lit(".sql")), cat(c("p_type"), lit(" "), c("p_name"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    """One number that sorts like (type, source, target); fails on node ids that are not below 2^30."""
    number = kind.cast("long") * F.lit(1 << 60) + source * F.lit(1 << 30) + target
    return F.when((F.least(source, target) >= 0) & (F.greatest(source, target) < F.lit(1 << 30)), number).otherwise(F.raise_error(F.lit("a node id is out of range")).cast("long"))


def _edges_of(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select(edge_id(F.lit(KINDS[kind]), F.col("s"), F.col("t")).alias("id"), F.lit(PROJECT).alias("project"), F.col("s").alias("source_id"), F.col("t").alias("target_id"), F.lit(kind).alias("edge_type"), F.lit("{}").alias("properties"))


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("CALLS", "IMPORTS", "USAGE")) -> DataFrame:
    key = lambda c, k: (F.col(c).cast("long") * 8 + k)
    out = []
    if "IMPORTS" in kinds:
        found = [("nation", "n_nationkey", 1, "n_regionkey", 0), ("customer", "c_custkey", 2, "c_nationkey", 1), ("supplier", "s_suppkey", 3, "s_nationkey", 1)]
        out += [_edges_of(read(spark, sf_dir, t).select(key(a, i).alias("s"), key(b, j).alias("t")).distinct(), "IMPORTS") for t, a, i, b, j in found]
    if "USAGE" in kinds:
        out.append(_edges_of(read(spark, sf_dir, "lineitem").select(key("l_suppkey", 3).alias("s"), key("l_partkey", 4).alias("t")).distinct(), "USAGE"))
    if "CALLS" in kinds:
        line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key("l_partkey", 4).alias("s")).distinct()
        then = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("s").alias("t"))
        out.append(_edges_of(line.join(then, ["l_orderkey", "l_linenumber"]).select("s", "t").distinct(), "CALLS"))
    return reduce(DataFrame.unionByName, out)


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: trimmed on the right, empty ones dropped, counted from 1."""
    lines = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.posexplode(F.split("text", "\n")).alias("p", "raw"))
    return lines.select(F.lit(PROJECT).alias("project"), "rel_path", (F.col("p") + 1).alias("line"), F.rtrim("raw").alias("snippet")).filter("snippet <> ''")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks a node; the last tenth of the ids is an older generation."""
    e = read(spark, sf_dir, "embeddings")
    node = F.floor(F.col("vec_id") / 5)
    return e.select(
        F.lit(PROJECT).alias("project"),
        F.lit("model").alias("model_id"),
        F.lit("v1").alias("prompt_version"),
        F.lit("retrieval").alias("task"),
        (node * 8 + 4).alias("node_id"),
        (F.col("vec_id") % 5).alias("chunk_idx"),
        F.concat(F.lit("vec::"), node.cast("string")).alias("qualified_name"),
        F.concat(F.lit("vec/"), F.col("label").cast("string"), F.lit(".sql")).alias("file_path"),
        F.sha2(F.col("vec_id").cast("string"), 256).alias("content_sha256"),
        F.when(F.col("vec_id") % 10 == 9, 1).otherwise(2).cast("long").alias("graph_generation"),
        F.col("embedding").alias("vector"),
    )


def file_states(spark: SparkSession, sf_dir: str, now: bool) -> DataFrame:
    """Two inventories of the documents: before, and after some came, went, changed or were touched."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    changed, touched = (i % 7 == 3) & F.lit(now), (i % 7 == 5) & F.lit(now)
    d = d.filter(i % 10 != 1) if now else d.filter(i % 10 != 2)
    return d.select(
        F.concat(F.lit("doc/"), i.cast("string"), F.lit(".txt")).alias("rel_path"),
        (F.col("n_chars") + changed.cast("long")).alias("size"),
        (i * 1000 + changed.cast("long") + touched.cast("long")).alias("mtime_ns"),
        (i * 1000 + 7).alias("ctime_ns"),
        (i + 100).alias("file_id"),
        F.sha2(F.concat(F.col("text"), F.when(changed, "!").otherwise("")), 256).alias("sha256"),
    )


_SPAN = "cast(floor({k} / 4) * 40 + 1 + [0, 5, 10, 22][{k} % 4 + 1] as bigint) as start_line, cast(floor({k} / 4) * 40 + 1 + [39, 34, 20, 30][{k} % 4 + 1] as bigint) as end_line"


def _node_sql(table: str, kind: int, key: str, label: str, name: str, qname: str, path: str, doc: str) -> str:
    props = f"""'{{"doc":"' || {doc} || '","url_path":"/' || {path} || '"}}'"""
    return f"select cast({key} as bigint) * 8 + {kind} as id, '{PROJECT}' as project, {label} as label, {name} as name, {qname} as qualified_name, {path} as file_path, {_SPAN.format(k=f'cast({key} as bigint)')}, {props} as properties from {table}"


NODES_SQL = "nodes as (" + " union all ".join([
    _node_sql("region", 0, "r_regionkey", "'Module'", "r_name", "'geo::' || r_name", "'geo/region.sql'", "r_name"),
    _node_sql("nation", 1, "n_nationkey", "'Class'", "n_name", "'geo::nation::' || n_name", "'geo/nation.sql'", "n_name"),
    _node_sql("customer", 2, "c_custkey", "'Variable'", "c_name", "'customer::' || c_mktsegment || '::' || c_name", "'customer/' || c_mktsegment || '.sql'", "c_mktsegment"),
    _node_sql("supplier", 3, "s_suppkey", "'Interface'", "s_name", "'supplier::' || s_name", "'supplier.sql'", "s_name"),
    _node_sql("part", 4, "p_partkey", "case when p_partkey % 5 = 0 then 'Method' when p_partkey % 11 = 0 then 'Struct' else 'Function' end", "p_name", "p_type || '::' || p_brand || '::Part' || p_partkey || 'OfSize' || p_size", "'part/' || p_brand || '.sql'", "p_type || ' ' || p_name"),
]) + ")"

_EDGE = "select cast({n} as bigint) * 1152921504606846976 + s * 1073741824 + t as id, '" + PROJECT + "' as project, s as source_id, t as target_id, '{kind}' as edge_type, '{{}}' as properties from ({pairs})"
_PAIRS = {
    "IMPORTS": "select distinct cast(n_nationkey as bigint) * 8 + 1 as s, cast(n_regionkey as bigint) * 8 as t from nation union all select distinct c_custkey * 8 + 2, cast(c_nationkey as bigint) * 8 + 1 from customer union all select distinct s_suppkey * 8 + 3, cast(s_nationkey as bigint) * 8 + 1 from supplier",
    "USAGE": "select distinct l_suppkey * 8 + 3 as s, l_partkey * 8 + 4 as t from lineitem",
    "CALLS": "select distinct a.l_partkey * 8 + 4 as s, b.l_partkey * 8 + 4 as t from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber",
}
EDGES_SQL = "edges as (" + " union all ".join(_EDGE.format(n=KINDS[k], kind=k, pairs=_PAIRS[k]) for k in ("CALLS", "IMPORTS", "USAGE")) + ")"
CONTENT_SQL = f"content as (select '{PROJECT}' as project, 'doc/' || doc_id || '.txt' as rel_path, cast(p as int) as line, rtrim(raw) as snippet from (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as p from documents) where rtrim(raw) <> '')"
VECTORS_SQL = f"vectors as (select '{PROJECT}' as project, 'model' as model_id, 'v1' as prompt_version, 'retrieval' as task, (vec_id // 5) * 8 + 4 as node_id, vec_id % 5 as chunk_idx, 'vec::' || (vec_id // 5) as qualified_name, 'vec/' || label || '.sql' as file_path, sha256(cast(vec_id as varchar)) as content_sha256, cast(case when vec_id % 10 = 9 then 1 else 2 end as bigint) as graph_generation, embedding as vector from embeddings)"


def _files_sql(name: str, now: bool) -> str:
    changed = "cast(doc_id % 7 = 3 as bigint)" if now else "0"
    touched = "cast(doc_id % 7 = 5 as bigint)" if now else "0"
    mark = "case when doc_id % 7 = 3 then '!' else '' end" if now else "''"
    return f"{name} as (select 'doc/' || doc_id || '.txt' as rel_path, n_chars + {changed} as size, doc_id * 1000 + {changed} + {touched} as mtime_ns, doc_id * 1000 + 7 as ctime_ns, doc_id + 100 as file_id, sha256(text || {mark}) as sha256 from documents where doc_id % 10 <> {1 if now else 2})"


FILES_SQL = _files_sql("before", False) + ", " + _files_sql("after", True)
