"""Counts over the store, and rollups of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by label and by type, and both totals, as (kind, key, n)."""
    by_label = count_by(nodes, "label").select(F.lit("label").alias("kind"), F.col("label").alias("key"), "n")
    by_type = count_by(edges, "edge_type").select(F.lit("edge_type").alias("kind"), F.col("edge_type").alias("key"), "n")
    both = by_label.union(by_type)
    totals = both.groupBy("kind").agg(F.sum("n").alias("n")).select(F.lit("total").alias("kind"), F.col("kind").alias("key"), "n")
    return both.union(totals)


def canonical_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All counts as one line of text in a fixed order; there are as many as labels and types."""
    rows = graph_stats(nodes, edges).agg(F.array_sort(F.collect_list(F.struct("kind", "key", "n"))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: F.concat(r["kind"], F.lit(":"), r["key"], F.lit("="), r["n"].cast("string"))), ";").alias("stats"))


def document_frequency(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``token, df``: in how many documents each token is."""
    return docs.select(key, F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def latency(samples: DataFrame, order: str, value: str, failed: Column, group: str, ring: int = 4096) -> DataFrame:
    """Mean, largest, nearest-rank p50 and p95 and error rate over each group's last samples."""
    last = Window.partitionBy(group).orderBy(F.desc(order))
    kept = samples.withColumn("_failed", failed).withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= ring)
    return kept.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.max(value).alias("largest"),
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.avg(F.col("_failed").cast("double")).alias("error_rate"),
    )


def provider_counts(files: DataFrame, skips: DataFrame) -> DataFrame:
    """Seen, indexed and failed files per language; ``skips`` has rel_path and reason."""
    joined = files.join(skips, "rel_path", "left")
    return joined.groupBy("language").agg(F.count("*").alias("seen"), F.count_if(F.col("reason").isNull()).alias("indexed"), F.count_if(F.col("reason") == "failed").alias("failed"))


def same_definitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two sets of definitions are equal; compared by rows, not gathered."""
    columns = ["label", "name", "qualified_name", "file_path"]
    x, y = a.select(*columns).distinct(), b.select(*columns).distinct()
    odd = x.exceptAll(y).union(y.exceptAll(x))
    return odd.agg((F.count("*") == 0).alias("same"), F.count("*").alias("odd"))


def diagnostics(nodes: DataFrame, edges: DataFrame, files: DataFrame, skips: DataFrame, providers: DataFrame) -> DataFrame:
    """One line per figure of the store's health."""
    figure = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("figure"), "n")
    incomplete = providers.filter((F.col("status") != "accepted") | (F.size("unsupported") > 0))
    parts = [figure(df, name) for df, name in ((nodes, "nodes"), (edges, "edges"), (files, "files"), (skips, "skips"), (incomplete, "incomplete providers"))]
    reasons = count_by(skips, "reason").select(F.concat(F.lit("skip "), "reason").alias("figure"), "n")
    return reduce(DataFrame.union, [*parts, reasons])
