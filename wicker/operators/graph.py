"""One hop: edge scans, neighbours, references, callers, degrees, unused symbols, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker import schema
from wicker.operators.graphquery import ranked

OUT, IN = ("source_id", "target_id"), ("target_id", "source_id")
#: Lines of a file whose spans and places meet.
BLOCK_LINES = 512


def edge_scan(edges: DataFrame, node: int, ends: tuple[str, str], kind: str | None, limit: int) -> DataFrame:
    """A node's edges at one end, by id."""
    found = edges.filter(F.col(ends[0]) == node)
    if kind is not None:
        found = found.filter(F.col("edge_type") == kind)
    return found.orderBy("id").limit(limit)


def edges_of_type(edges: DataFrame, kind: str) -> DataFrame:
    return ranked(edges.filter(F.col("edge_type") == kind), [F.col("source_id"), F.col("target_id"), F.col("id")], schema.MAX_ROWS)


def edges_between(edges: DataFrame, source: int, target: int) -> DataFrame:
    return ranked(edges.filter((F.col("source_id") == source) & (F.col("target_id") == target)), [F.col("edge_type"), F.col("id")], schema.MAX_ROWS)


def neighbour_ids(edges: DataFrame, node: int, ends: tuple[str, str], kind: str | None, limit: int) -> DataFrame:
    found = edges.filter(F.col(ends[0]) == node)
    if kind is not None:
        found = found.filter(F.col("edge_type") == kind)
    return found.select(F.col(ends[1]).alias("id")).distinct().orderBy("id").limit(limit)


def neighbours(nodes: DataFrame, edges: DataFrame, node: int, ends: tuple[str, str], kind: str) -> DataFrame:
    """Nodes one hop away, but not the node itself, by (qualified name, id)."""
    ids = edges.filter((F.col(ends[0]) == node) & (F.col("edge_type") == kind) & (F.col(ends[1]) != node)).select(F.col(ends[1]).alias("id")).distinct()
    return ranked(nodes.join(ids, "id"), [F.col("qualified_name"), F.col("id")], schema.MAX_ROWS)


def references(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Who refers to any of the targets: one row per (source, type), without self-references."""
    goal = targets.select(F.col("id").alias("target_id"))
    found = edges.filter(F.col("edge_type").isin(schema.REFERENCES)).filter(F.col("source_id") != F.col("target_id")).join(goal, "target_id", "left_semi")
    return nodes.join(found.select(F.col("source_id").alias("id"), "edge_type").distinct(), "id")


def ordered_references(nodes: DataFrame, edges: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    return ranked(references(nodes, edges, targets), [F.col("qualified_name"), F.col("id"), F.col("edge_type")], limit)


def unused(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes of the labels that nothing refers to; a self-reference counts as use."""
    used = edges.filter(F.col("edge_type").isin(schema.REFERENCES)).select(F.col("target_id").alias("id"))
    return nodes.filter(F.col("label").isin(labels)).join(used, "id", "left_anti")


def first_neighbours(nodes: DataFrame, edges: DataFrame, node: int, ends: tuple[str, str]) -> DataFrame:
    """Callees (OUT) or callers (IN): each once, by the first edge that gives it; no self-call."""
    found = edges.filter((F.col(ends[0]) == node) & (F.col("edge_type") == "CALLS") & (F.col(ends[1]) != node))
    first = found.groupBy(F.col(ends[1]).alias("id")).agg(F.min("id").alias("edge_id"))
    return ranked(nodes.join(first, "id"), [F.col("edge_id")], schema.MAX_ROWS)


def enclosing(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """For each place (``file_path, line``) the innermost node whose span covers it.

    An equality on the file and a block of BLOCK_LINES lines carries the join, so
    that a long file's spans do not meet all its places; the span is checked on
    top. Latest start wins, then earliest end, qualified name and id. Places
    without a node are left out.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK_LINES)
    spans = nodes.filter("start_line <= end_line").select("id", "label", "qualified_name", "file_path", "start_line", "end_line", F.explode(F.sequence(block("start_line"), block("end_line"))).alias("block"))
    hits = places.withColumn("block", block("line")).join(spans, ["file_path", "block"]).filter((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")))
    best = F.min(F.struct((-F.col("start_line")).alias("a"), "end_line", "qualified_name", "id", "label"))
    inner = hits.groupBy(*places.columns).agg(best.alias("x"))
    return inner.select(*places.columns, "x.id", "x.label", "x.qualified_name", (-F.col("x.a")).alias("start_line"), "x.end_line")


def fan(nodes: DataFrame, edges: DataFrame, ends: tuple[str, str], kind: str, limit: int) -> DataFrame:
    """Nodes by the number of their edges at the first end; only positive ones."""
    degree = edges.filter(F.col("edge_type") == kind).groupBy(F.col(ends[0]).alias("id")).agg(F.count("*").alias("degree"))
    return ranked(nodes.join(degree, "id"), [F.desc("degree"), F.col("qualified_name"), F.col("id")], limit)


def fan_total(nodes: DataFrame, edges: DataFrame, ends: tuple[str, str], kind: str) -> DataFrame:
    """How many nodes have such an edge at all."""
    ends_of = edges.filter(F.col("edge_type") == kind).select(F.col(ends[0]).alias("id"))
    return nodes.join(ends_of, "id", "left_semi").agg(F.count("*").alias("n"))


def most_connected(nodes: DataFrame, edges: DataFrame, how: str, limit: int) -> DataFrame:
    """Nodes by out, in or total degree; zeros stay, and a self-loop counts twice in the total."""
    ends = {"out": ["source_id"], "in": ["target_id"], "total": ["source_id", "target_id"]}[how]
    ids = edges.select(F.explode(F.array(*ends)).alias("id"))
    degree = ids.groupBy("id").agg(F.count("*").alias("degree"))
    found = nodes.join(degree, "id", "left").fillna(0, ["degree"])
    return ranked(found, [F.desc("degree"), F.col("qualified_name"), F.col("id")], limit)


def co_change(nodes: DataFrame, edges: DataFrame, node: int, kind: str, limit: int) -> DataFrame:
    """Nodes that share a target with the node, by how many."""
    typed = edges.filter(F.col("edge_type") == kind)
    mine = typed.filter(F.col("source_id") == node).select("target_id").distinct()
    theirs = typed.filter(F.col("source_id") != node).select("target_id", F.col("source_id").alias("id"))
    shared = theirs.join(mine, "target_id").groupBy("id").agg(F.countDistinct("target_id").alias("shared"))
    return ranked(nodes.join(shared, "id"), [F.desc("shared"), F.col("qualified_name"), F.col("id")], limit)


def with_outgoing(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes of a name, each with its outgoing edges as an array by id; a name's nodes are few."""
    found = nodes.filter(F.col("name") == name)
    out = edges.join(found.select(F.col("id").alias("source_id")), "source_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("edge_id"), "target_id", "edge_type"))).alias("outgoing"))
    return found.join(out, "id", "left")


def capped(edges: DataFrame, ends: tuple[str, str], cap: int) -> DataFrame:
    """At most ``cap`` edges per node and type at the first end, by id.

    Only nodes that are over the cap are ranked; the others' edges pass as they
    are, so no window runs over them.
    """
    keys = [ends[0], "edge_type"]
    crowded = edges.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > cap).select(*keys)
    order = Window.partitionBy(*keys).orderBy("id")
    few = edges.join(crowded, keys, "left_semi").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).drop("n")
    return edges.join(crowded, keys, "left_anti").unionByName(few)


def is_in(values: list[str], column: str = "edge_type") -> Column:
    return F.col(column).isin(sorted({v.strip() for v in values}))
