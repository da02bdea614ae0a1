"""The index of a set of tables: written once an application, read by every query.

Each relation is a Parquet table in the shared checkpoint folder. Edges are there
by source and, a second time, by target; postings are ordered by token, so that a
query reads the row groups of its own tokens only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.operators import lexical, semantic
from wicker.operators.lexical import TextIndex
from wicker.session import checkpoint_folder
from wicker.sources import adapters as A



#: How each table is made, and by what its files are partitioned, dealt out and sorted.
TABLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None, list[str]]] = {
    "nodes": (A.nodes, None, []),
    "edges": (A.edges, "edge_type", ["source_id"]),
    "edges_in": (lambda spark, d: table(spark, d, "edges"), "edge_type", ["target_id"]),
    "words": (lambda spark, d: semantic.worded(table(spark, d, "nodes")), None, []),
    "symbol_postings": (lambda spark, d: lexical.symbol_postings(table(spark, d, "nodes")), None, ["token", "id"]),
    "symbol_size": (lambda spark, d: lexical.size(lexical.symbol_tokens(table(spark, d, "nodes"))), None, []),
    "content": (A.content, None, []),
    "content_postings": (lambda spark, d: lexical.content_postings(table(spark, d, "content")), None, ["token", "rel_path", "line"]),
    "content_size": (lambda spark, d: lexical.size(lexical.content_tokens(table(spark, d, "content"))), None, []),
}


def write(spark: SparkSession, sf_dir: str, name: str, path: str) -> None:
    """Write one table; a range by its sort key may split a key that holds many rows."""
    make, partition, order = TABLES[name]
    rows = make(spark, sf_dir)
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; made at its first use."""
    context = spark.sparkContext
    known = context.__dict__.setdefault("_wicker_tables", {})
    key = (sf_dir, name)
    if key not in known:
        path = f"{checkpoint_folder(spark)}/index-{context.applicationId}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}/{name}"
        write(spark, sf_dir, name, path)
        known[key] = path
    return spark.read.parquet(known[key])


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all tables anew: ``name, rows``."""
    context = spark.sparkContext
    known = context.__dict__.setdefault("_wicker_tables", {})
    for name in TABLES:
        known.pop((sf_dir, name), None)
    counts = [table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes")


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None, end: str = "source_id") -> DataFrame:
    """All edges, or those of some types; ``end`` tells by which end they will be looked up."""
    found = table(spark, sf_dir, "edges" if end == "source_id" else "edges_in")
    found = found if kinds is None else found.filter(F.col("edge_type").isin(list(kinds)))
    return found.select("id", "project", "source_id", "target_id", "edge_type", "properties")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their words and signature."""
    return table(spark, sf_dir, "words")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "content")


def symbol_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex(table(spark, sf_dir, "symbol_postings"), table(spark, sf_dir, "symbol_size"))


def content_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex(table(spark, sf_dir, "content_postings"), table(spark, sf_dir, "content_size"))
