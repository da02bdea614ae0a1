"""Structured node filters, orders and limits."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker import schema
from wicker.functions.text import contains_ci, starts_ci

DEGREE_CAP = 10_000
ORDERS = {
    "qualified_name": ["qualified_name", "id"],
    "name": ["name", "qualified_name", "id"],
    "file": ["file_path", "start_line", "qualified_name", "id"],
}


@dataclass(frozen=True)
class GraphQuery:
    """What to find: all filters that are set must hold; equality is case-sensitive, the rest is not."""

    project: str | None = None
    label: str | None = None
    name: str | None = None
    qname_contains: str | None = None
    qname: str | None = None
    file_contains: str | None = None
    file_prefix: str | None = None
    file: str | None = None
    name_contains: str | None = None
    name_prefix: str | None = None
    has_outgoing: str | None = None
    has_incoming: str | None = None
    order: str = "qualified_name"
    degree_type: str | None = None
    limit: int = schema.MAX_ROWS

    def where(self, **changes) -> GraphQuery:
        """The same query with other fields."""
        return replace(self, **changes)

    def _conditions(self) -> list[Column]:
        made = {
            "project": lambda v: F.col("project") == v,
            "label": lambda v: F.col("label") == v,
            "name": lambda v: F.col("name") == v,
            "qname": lambda v: F.col("qualified_name") == v,
            "file": lambda v: F.col("file_path") == v,
            "qname_contains": lambda v: contains_ci(F.col("qualified_name"), v),
            "file_contains": lambda v: contains_ci(F.col("file_path"), v),
            "file_prefix": lambda v: starts_ci(F.col("file_path"), v),
            "name_contains": lambda v: contains_ci(F.col("name"), v),
            "name_prefix": lambda v: starts_ci(F.col("name"), v),
        }
        return [make(getattr(self, k)) for k, make in made.items() if getattr(self, k) is not None]

    def filtered(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """All nodes that match, in no order and without a limit."""
        for condition in self._conditions():
            nodes = nodes.filter(condition)
        for kind, end in ((self.has_outgoing, "source_id"), (self.has_incoming, "target_id")):
            if kind is not None:
                nodes = nodes.join(edges.filter(F.col("edge_type") == kind).select(F.col(end).alias("id")), "id", "left_semi")
        return nodes

    def run(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """Matching nodes, ordered and limited, with their ``rank`` from 1."""
        found = self.filtered(nodes, edges)
        if self.order in ORDERS:
            keys = [F.col(c) for c in ORDERS[self.order]]
        else:
            end = {"out_degree": "source_id", "in_degree": "target_id"}[self.order]
            found = found.join(degrees(edges, end, self.degree_type), "id", "left").withColumn("degree", F.least(F.coalesce("degree", F.lit(0).cast("long")), F.lit(DEGREE_CAP)))
            keys = [F.desc("degree"), F.col("qualified_name"), F.col("id")]
        return ranked(found, keys, min(self.limit, schema.MAX_ROWS))

    def count(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """How many match, whatever the limit and order."""
        return self.filtered(nodes, edges).agg(F.count("*").alias("n"))


def ranked(df: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows by ``keys`` with their rank; only those are brought together."""
    top = df.orderBy(*keys).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def degrees(edges: DataFrame, end: str, kind: str | None = None) -> DataFrame:
    """``id, degree`` of the nodes with an edge at that end."""
    if kind is not None:
        edges = edges.filter(F.col("edge_type") == kind)
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))


def symbols_in_file(nodes: DataFrame, path: str) -> DataFrame:
    """A file's nodes in the order of their spans, outer before inner."""
    return ranked(nodes.filter(F.col("file_path") == path), [F.col("start_line"), F.desc("end_line"), F.col("qualified_name"), F.col("id")], schema.MAX_ROWS)


def labelled_in_file(nodes: DataFrame, label: str, path: str) -> DataFrame:
    return GraphQuery(label=label, file=path, order="file").run(nodes)


def similar_names(nodes: DataFrame, term: str, limit: int) -> DataFrame:
    """Distinct names that contain the term, the shortest first."""
    return ranked(nodes.filter(contains_ci(F.col("name"), term)).select("name").distinct(), [F.length("name"), F.col("name")], limit)


def page(nodes: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page in the total order of (qualified name, id)."""
    return nodes.orderBy("qualified_name", "id").offset(offset).limit(limit)


def without_pseudo(nodes: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Without call and import stand-ins, unless wanted, and without whole-file modules."""
    drop = [x for x in ("Call", "Import") if x not in wanted]
    return nodes.filter(~F.col("label").isin(drop) & ~F.col("qualified_name").endswith("::__file__"))
