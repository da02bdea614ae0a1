"""Keyed writes, cascades, caches, snapshots and freshness of the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.text import short_id

PACK_SECONDS = 24 * 3600
CACHE_ROWS, CACHE_BYTES, KEEP_ROWS, KEEP_SHARE = 10_000, 64 << 20, 8_000, 0.8


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Old rows whose key is not in new, and the last new row of each key (by ``order``)."""
    if order is not None:
        last = Window.partitionBy(*key).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", order)
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """By (project, qualified name); a node that is there keeps its id."""
    key = ["project", "qualified_name"]
    ids = nodes.select(*key, F.col("id").alias("_old"))
    kept = new.join(ids, key, "left").withColumn("id", F.coalesce("_old", "id")).drop("_old")
    return upsert(nodes, kept, key)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """By (source, target, type); an edge that is there keeps its id and takes the new properties."""
    key = ["source_id", "target_id", "edge_type"]
    ids = edges.select(*key, F.col("id").alias("_old"))
    return upsert(edges, new.join(ids, key, "left").withColumn("id", F.coalesce("_old", "id")).drop("_old"), key)


def delete_files(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the nodes of those files, and without edges and vectors of nodes that are gone."""
    left = nodes.join(paths.select(F.col("rel_path").alias("file_path")).distinct(), "file_path", "left_anti")
    ids = left.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return left, edges, vectors.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi")


def replace_files(rows: DataFrame, new: DataFrame, path: str = "rel_path") -> DataFrame:
    """Rows of the files in new give way to new as a whole."""
    return rows.join(new.select(path).distinct(), path, "left_anti").unionByName(new.select(*rows.columns))


def stamped(rows: DataFrame, generation: int) -> DataFrame:
    return rows.withColumn("last_indexed_generation", F.lit(generation).cast("long"))


def next_generation(state: DataFrame) -> DataFrame:
    return state.withColumn("generation", F.coalesce(F.col("generation"), F.lit(0)) + 1)


def pack_id(*parts: Column) -> Column:
    return short_id(*parts)


def live_packs(packs: DataFrame, now: Column) -> DataFrame:
    """Packs that have not expired at that second."""
    return packs.filter(F.col("expires_at") > now)


def pruned_cache(cache: DataFrame) -> DataFrame:
    """The most recently used entries, once there are too many rows or bytes.

    Over CACHE_ROWS rows it keeps KEEP_ROWS; over CACHE_BYTES bytes it keeps as many
    as fit into KEEP_SHARE of that. Only the first rows are ever brought together.
    """
    order = [F.desc("last_accessed"), F.col("model_key"), F.col("query_text")]
    sums = cache.agg(F.count("*").alias("_rows"), F.sum("bytes").alias("_bytes")).first()  # one row
    rows, size = sums["_rows"], sums["_bytes"] or 0
    if rows > CACHE_ROWS:
        cache = cache.orderBy(*order).limit(KEEP_ROWS)  # a top-k, so only so many rows of each task meet
    if size > CACHE_BYTES:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        first = cache if rows > CACHE_ROWS else cache.orderBy(*order).limit(CACHE_ROWS)
        cache = first.withColumn("_upto", F.sum("bytes").over(upto)).filter(F.col("_upto") <= KEEP_SHARE * CACHE_BYTES).drop("_upto")
    return cache


def collected(entries: DataFrame, now: float, ttl: float, high: int, low: int) -> DataFrame:
    """Cache files with ``verdict``: expired, evicted (least recently used down to ``low`` once over ``high``) or kept.

    A running total over what has not expired, newest first, within each cache.
    """
    order = Window.partitionBy("cache").orderBy(F.desc("last_used"), "path").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("cache")
    fresh = F.when(F.col("last_used") >= now - ttl, F.col("bytes")).otherwise(0)
    rows = entries.withColumns({"_upto": F.sum(fresh).over(order), "_all": F.sum(fresh).over(whole)})
    verdict = F.when(F.col("last_used") < now - ttl, "expired").when((F.col("_all") > high) & (F.col("_upto") > low), "evicted").otherwise("kept")
    return rows.withColumn("verdict", verdict).drop("_upto", "_all")


# Freshness


def file_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rel_path, status``: added, deleted, modified or unchanged.

    Equal size, times and file number settle it; only otherwise do digests count.
    """
    stat = ["size", "mtime_ns", "ctime_ns", "file_id"]
    b = before.select(F.col("rel_path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in [*stat, "sha256"]))
    both = after.join(b, F.col("rel_path") == F.col("_path"), "full_outer")
    same = F.lit(True)
    for c in stat:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_path").isNull(), "added").when(F.col("rel_path").isNull(), "deleted").when(same, "unchanged").when(F.col("sha256").eqNullSafe(F.col("_sha256")), "unchanged").otherwise("modified")
    return both.select(F.coalesce("rel_path", "_path").alias("rel_path"), status.alias("status"), (~same & F.col("rel_path").isNotNull() & F.col("_path").isNotNull()).alias("hashed"))


def workspace_status(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Cold, unknown, root mismatch, fresh or stale with reasons; both frames have one row or none.

    Columns: root_path, branch, head, index_sha, scope_key.
    """
    fields = ["branch", "head", "index_sha", "scope_key"]
    s = stored.select(*(F.col(c).alias(f"s_{c}") for c in ["root_path", *fields]), F.lit(True).alias("known"))
    both = now.join(s, F.lit(True), "left")
    reasons = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    status = F.when(F.col("known").isNull(), "cold").when(F.col("root_path") != F.col("s_root_path"), "root mismatch").when(F.col("head").isNull(), "unknown").when(F.size(reasons) == 0, "fresh").otherwise("stale")
    return both.select(status.alias("status"), F.when(status == "stale", F.array_join(reasons, ",")).otherwise("").alias("reasons"))


def only_metadata(status: DataFrame, diff: DataFrame) -> DataFrame:
    """Whether nothing but branch, head or index moved and no file did."""
    moved = diff.agg((F.count_if(F.col("status") != "unchanged") > 0).alias("moved"))
    return status.crossJoin(F.broadcast(moved)).select(((F.col("status") == "stale") & ~F.col("reasons").contains("scope_key") & ~F.col("moved")).alias("metadata_only"))


def incremental(nodes: DataFrame, extracted: DataFrame, diff: DataFrame) -> DataFrame:
    """Nodes after an update: files that changed, came or went lose theirs, and what was extracted anew comes in."""
    touched = diff.filter("status <> 'unchanged'").select(F.col("rel_path").alias("file_path"))
    kept = nodes.join(touched, "file_path", "left_anti")
    return kept.unionByName(extracted.join(touched, "file_path", "left_semi").select(*kept.columns))


def skipped_by_limits(files: DataFrame, max_files: int, max_size: int) -> DataFrame:
    """Files with ``skip``: too large, or beyond the first so many by path; else null."""
    small = files.filter(F.col("size") <= max_size)
    first = small.orderBy("rel_path").limit(max_files).select(F.col("rel_path").alias("_path"))
    joined = files.join(first, F.col("rel_path") == F.col("_path"), "left")
    return joined.withColumn("skip", F.when(F.col("size") > max_size, "too large").when(F.col("_path").isNull(), "file limit")).drop("_path")


def provider_complete(providers: DataFrame) -> DataFrame:
    return providers.withColumn("complete", (F.col("status") == "accepted") & (F.size("unsupported") == 0))
