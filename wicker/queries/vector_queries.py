"""Exact vector search, quantization and reuse over the adapted embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import vector
from wicker.queries.registry import query
from wicker.sources import adapters as A
from wicker.sources import published as P

V = f"with {A.VECTORS_SQL} "
ASKED = [((i * 37) % 19 - 9) / 9.0 for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::double" for x in ASKED) + "]"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"


_SCORE = f"round({dot_sql('vector', _Q)} / sqrt({dot_sql('vector', 'vector')}) / sqrt({dot_sql(_Q, _Q)}), 9)"
_BEST = f"scored as (select *, {_SCORE} as score from vectors where project = 'tpch' and graph_generation = 2), best as (select * exclude (n) from (select *, row_number() over (partition by node_id order by score desc, qualified_name, chunk_idx) as n from scored) where n = 1)"


@query(V.rstrip() + f", {_BEST} select cast(row_number() over (order by score desc, qualified_name, chunk_idx, node_id) as int) as rank, node_id, chunk_idx, score from best where score >= 0.05 order by rank limit 10")
def vector_search(spark, d):
    rows = vector.scoped(A.vectors(spark, d), project="tpch", model_id="model", graph_generation=2, file_path=None)
    return vector.search(vector.guarded(rows), ASKED, 10, 0.05).select("rank", "node_id", "chunk_idx", "score")


@query(V.rstrip() + f", {_BEST}, hits as (select cast(row_number() over (order by score desc, qualified_name, chunk_idx, node_id) as int) as rank, * from best order by rank limit 10), named as (select cast(p_partkey as bigint) * 8 + 4 as id, p_type || '::' || p_brand || '::Part' || p_partkey || 'OfSize' || p_size as q, 'part/' || p_brand || '.sql' as f from part) select rank, node_id, coalesce(q, qualified_name) as qualified_name, coalesce(f, file_path) as file_path from hits left join named on id = node_id")
def vector_hits_with_nodes(spark, d):
    rows = vector.scoped(A.vectors(spark, d), project="tpch", graph_generation=2)
    return vector.with_nodes(vector.search(rows, ASKED, 10), P.nodes(spark, d)).select("rank", "node_id", "qualified_name", "file_path")


_UNIT = "(list_max(list_transform(vector, lambda x: abs(x)))::double / 127.0)"


@query(V + f"select content_sha256, round({_UNIT}, 9) as i8_scale, array_to_string(list_transform(vector, lambda x: greatest(least(round(x::double / {_UNIT}), 127), -127)::int), ',') as vector_i8, round(sqrt({dot_sql('vector', 'vector')}), 6) as vector_norm from vectors")
def quantized_vectors(spark, d):
    unit = vector.scale(F.col("vector"))
    rows = A.vectors(spark, d).withColumn("unit", unit)
    return rows.select("content_sha256", F.round("unit", 9).alias("i8_scale"), F.array_join(vector.quantize(F.col("vector"), F.col("unit")), ",").alias("vector_i8"), F.round(vector.norm(F.col("vector")), 6).alias("vector_norm"))


@query(V + "select coalesce(case when len(vector) <> 64 then 'dimension' when graph_generation < 2 then 'zero' end, 'ok') as problem, count(*) as n from vectors group by 1")
def vector_problems(spark, d):
    rows = A.vectors(spark, d).withColumn("vector", F.when(F.col("graph_generation") < 2, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")))
    what = vector.problem(F.col("vector"), 64, F.col("content_sha256"), F.col("chunk_idx"))
    return rows.groupBy(F.coalesce(what, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query(V + ", both_ as (select content_sha256, chunk_idx, qualified_name, graph_generation from vectors union all select content_sha256, chunk_idx, qualified_name, 5 from vectors where node_id % 3 = 0) select qualified_name, chunk_idx, max(graph_generation) as generation from both_ group by qualified_name, chunk_idx, content_sha256")
def newest_vectors(spark, d):
    rows = A.vectors(spark, d)
    again = rows.filter("node_id % 3 = 0").withColumn("graph_generation", F.lit(5).cast("long"))
    return vector.newest(rows.unionByName(again)).select("qualified_name", "chunk_idx", F.col("graph_generation").alias("generation"))


@query(V + "select content_sha256 from vectors where node_id % 3 <> 0")
def vectors_to_embed(spark, d):
    rows = A.vectors(spark, d)
    return vector.to_embed(rows, rows.filter("node_id % 3 = 0")).select("content_sha256")


@query(V + "select content_sha256 from vectors where graph_generation >= 2")
def pruned_vectors(spark, d):
    return vector.pruned(A.vectors(spark, d), 2).select("content_sha256")


@query(f"with {A.NODES_SQL} select count(*) as n from nodes where label in ('Function', 'Method', 'Class', 'Interface', 'Type', 'Enum', 'Struct', 'Trait', 'TypeAlias')")
def embedding_candidates(spark, d):
    return vector.candidates(P.nodes(spark, d)).agg(F.count("*").alias("n"))


@query("select item_id, 'task: code retrieval | query: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) as prompt from benchmark")
def prompts(spark, d):
    from wicker.functions.text import normalize_query

    return A.read(spark, d, "benchmark").select("item_id", vector.prompt("code_retrieval_query", normalize_query(F.col("text"))).alias("prompt"))


@query()
def embedding_index(spark, d):
    """Chunks and stand-in vectors of the documents' lines."""
    docs = A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("qualified_name"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.concat(F.lit("source "), "source").alias("header"), F.col("text").alias("body"))
    made = vector.build(docs, vector.hash_embedding, 128)
    return made.select("node_id", "chunk_idx", "content_sha256", "vector_norm")
