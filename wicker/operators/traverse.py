"""Several hops: reachability, paths, traces, trees, components and cycles.

Every operator goes level by level. A level is one join of the frontier with the
edges, of which only the frontier's own leave the scan; what is known so far is
written out after each level, so a lost executor costs one level at most and
plans stay short. The driver only learns how many nodes a level has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker import schema
from wicker.operators.components import components, saved
from wicker.operators.graph import IN, OUT, capped, is_in
from wicker.operators.graphquery import ranked

#: Ids of a frontier that are broadcast, at most.
BROADCAST = 200_000


def _start(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def hop(edges: DataFrame, kinds: list[str], ends: tuple[str, str], cap: int | None, front: DataFrame) -> DataFrame:
    """``src, dst, edge_id, edge_type`` of the wanted types from the nodes of ``front`` (id) on, capped per node and type if there is a cap.

    Only the edges of the frontier leave the scan: up to ``BROADCAST`` ids go to
    the edges, beyond that both sides are shuffled. Nodes over the cap are ranked,
    the others' edges pass as they are.
    """
    ids = front.select(F.col("id").alias(ends[0])).distinct()
    ids = F.broadcast(ids) if front.count() <= BROADCAST else ids
    found = saved(edges.filter(is_in(kinds)).join(ids, ends[0], "left_semi").select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"), F.col("id").alias("edge_id"), "edge_type"))
    if cap is None:
        return found
    crowded = found.groupBy("src", "edge_type").agg(F.count("*").alias("n")).filter(F.col("n") > cap)
    return found if crowded.isEmpty() else capped(found.withColumnRenamed("edge_id", "id"), ("src", "dst"), cap).withColumnRenamed("id", "edge_id")


@dataclass(frozen=True)
class Links:
    """Edges of some types, followed from a frontier: one way or both ways; all of a node's or so many by id."""

    edges: DataFrame
    kinds: list[str]
    ends: tuple[tuple[str, str], ...]
    cap: int | None = None

    def of(self, front: DataFrame) -> DataFrame:
        """The steps that leave the frontier."""
        return reduce(DataFrame.unionByName, (hop(self.edges, self.kinds, e, self.cap, front) for e in self.ends))


def reach(links: Links, start: DataFrame, hops: int) -> DataFrame:
    """``id, hops``: every node within ``hops`` steps of the starts (id) and the fewest that lead there; starts at 0."""
    seen = front = saved(start.select("id").distinct().withColumn("hops", F.lit(0)))
    for h in range(1, hops + 1):
        found = links.of(front).select(F.col("dst").alias("id")).distinct()
        front = saved(found.join(seen, "id", "left_anti").withColumn("hops", F.lit(h)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reachable_from(nodes: DataFrame, edges: DataFrame, starts: DataFrame, kinds: list[str], hops: int, ends: tuple[str, str] = OUT, limit: int = schema.MAX_ROWS) -> DataFrame:
    """Nodes within some hops of any start (id) over all the types together, nearest first; never a start."""
    seen = reach(Links(edges, kinds, (ends,)), starts, min(hops, schema.MAX_HOPS)).filter("hops > 0")
    return ranked(nodes.join(seen, "id"), [F.col("hops"), F.col("qualified_name"), F.col("id")], limit)


def reachable_within(nodes: DataFrame, edges: DataFrame, start: int, kinds: list[str], hops: int, ends: tuple[str, str] = OUT, limit: int = schema.MAX_ROWS) -> DataFrame:
    """Nodes within some hops over all the types together, nearest first; never the start."""
    return reachable_from(nodes, edges, _start(nodes.sparkSession, [start]), kinds, hops, ends, limit)


def impact(nodes: DataFrame, edges: DataFrame, start: int, hops: int = 6, limit: int = schema.MAX_ROWS) -> DataFrame:
    """What depends on a node: reachability against all reference types."""
    return reachable_within(nodes, edges, start, schema.REFERENCES, hops, IN, limit)


def subgraph(edges: DataFrame, start: int, kinds: list[str], hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes around a node, whatever the direction, and the edges among them."""
    seen = reach(Links(edges, kinds, (OUT, IN)), _start(edges.sparkSession, [start]), min(hops, schema.MAX_HOPS))
    ids = seen.select("id")
    inner = edges.filter(is_in(kinds)).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return seen, inner


def cluster(edges: DataFrame, start: int, kind: str = "IMPORTS", limit: int = schema.MAX_ROWS) -> DataFrame:
    """The undirected component of a node, by id; ``truncated`` tells if the limit cut it.

    The components of all edges of the type are found by contraction, in a number
    of rounds that grows with the logarithm of the longest chain.
    """
    under = components(edges.filter(is_in([kind])).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    root = under.filter(F.col("node") == start).select("root")
    own = _start(edges.sparkSession, [start])
    seen = under.join(F.broadcast(root), "root", "left_semi").select(F.col("node").alias("id")).union(own).distinct()  # one root
    limit = max(1, limit)
    over = seen.agg((F.count("*") > limit).alias("truncated"))
    return ranked(seen, [F.col("id")], limit).crossJoin(F.broadcast(over))  # one row on the right


def discover(links: Links, start: DataFrame, hops: int) -> DataFrame:
    """Breadth-first order from one start (id): ``id, depth, key, parent, edge_id, edge_type``.

    A node belongs to its first discoverer: the parent that was itself found
    first, then the lowest edge id. ``key`` holds the edge ids that led there;
    keys of a level sort like the order of discovery, so no level is numbered.
    """
    none = F.lit(None)
    seen = front = saved(start.select("id", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("key"), none.cast("long").alias("parent"), none.cast("long").alias("edge_id"), none.cast("string").alias("edge_type")))
    for depth in range(1, hops + 1):
        found = links.of(front).join(front.select(F.col("id").alias("src"), "key"), "src")
        best = found.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.concat("key", F.array("edge_id")).alias("key"), "src", "edge_id", "edge_type")).alias("x"))
        fresh = best.join(seen.select("id"), "id", "left_anti")
        front = saved(fresh.select("id", F.lit(depth).alias("depth"), "x.key", F.col("x.src").alias("parent"), "x.edge_id", "x.edge_type"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trace(nodes: DataFrame, edges: DataFrame, start: int, kinds: list[str], hops: int = 4, ends: tuple[str, str] = OUT) -> DataFrame:
    """Breadth-first steps from a node, with the edge that first led to each."""
    links = Links(edges, kinds, (ends,), schema.TRACE_FANOUT)
    found = discover(links, _start(nodes.sparkSession, [start]), min(hops, schema.MAX_HOPS))
    return nodes.select("id", "name", "qualified_name").join(found, "id")


def shortest_path(edges: DataFrame, start: int, goal: int, kinds: list[str], hops: int = schema.MAX_HOPS) -> DataFrame:
    """``step, id, edge_id`` along one shortest path: the one breadth-first search finds first; empty if none."""
    found = discover(Links(edges, kinds, (OUT,), schema.FANOUT), _start(edges.sparkSession, [start]), min(hops, schema.MAX_HOPS))
    at = saved(found.filter(F.col("id") == goal))
    path = at.select(F.col("depth").alias("step"), "id", "edge_id", "parent")
    for _ in range(min(hops, schema.MAX_HOPS)):
        at = saved(found.join(at.select(F.col("parent").alias("id")), "id", "left_semi"))
        if at.isEmpty():
            break
        path = path.unionByName(at.select(F.col("depth").alias("step"), "id", "edge_id", "parent"))
    return path.select("step", "id", "edge_id")


def _called(nodes: DataFrame, start: int) -> DataFrame:
    """The start, if there is such a node."""
    return nodes.filter(F.col("id") == start).select("id").distinct()


def call_tree(nodes: DataFrame, edges: DataFrame, start: int, depth: int, ends: tuple[str, str] = OUT) -> DataFrame:
    """Each reached node once with its depth, and all it calls (or, with IN, is called by) as ``children`` by edge id.

    Self-calls are no children. The children of one node are bounded by the
    fan-out cap. A start that is no node has an empty tree.
    """
    links = Links(edges, ["CALLS"], (ends,), schema.TRACE_FANOUT)
    found = discover(links, _called(nodes, start), min(depth, schema.MAX_HOPS))
    inner = saved(found.filter(F.col("depth") < depth).select("id"))
    own = links.of(inner).filter("src <> dst")
    children = own.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "dst"))), lambda x: x["dst"]).alias("children"))
    none = F.array().cast("array<bigint>")
    return found.select("id", "depth", "parent").join(children, "id", "left").withColumn("children", F.coalesce("children", none))


def call_hierarchy(nodes: DataFrame, edges: DataFrame, start: int, depth: int, ends: tuple[str, str] = OUT) -> DataFrame:
    """All paths from a node along its calls (or, with IN, its callers): ``depth, id, path, cyclic, truncated``.

    A node is cyclic if it is among its own ancestors, and is not followed;
    self-calls are left out. Truncated is every node at the last level that is
    followed no more, even one without callees. A start that is no node has none.
    """
    depth = min(depth, schema.MAX_HOPS)
    links = Links(edges, ["CALLS"], (ends,), schema.TRACE_FANOUT)
    level = saved(_called(nodes, start).select("id", F.array("id").alias("path"), F.lit(False).alias("cyclic")))
    out = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        open_ends = level.filter(~F.col("cyclic"))
        steps = links.of(open_ends.select("id").distinct()).filter("src <> dst").select("src", "dst").distinct()
        grown = open_ends.select(F.col("id").alias("src"), "path").join(steps, "src")
        level = saved(grown.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cyclic")))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out.select("depth", "id", "path", "cyclic", (~F.col("cyclic") & (F.col("depth") == depth)).alias("truncated"))


def _between(links: DataFrame) -> DataFrame:
    """The links whose ends have both a way in and a way out, found in a few rounds: only those can be in a cycle."""
    n = links.count()
    for _ in range(schema.MAX_CYCLE):
        links = saved(links.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        if n == (n := links.count()):
            break
    return links


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """Simple cycles of CALLS up to a length, each from its smallest id on; a self-loop has length 1.

    Nodes without a way in or out are taken away first. Paths only grow over ids
    above their start, so each cycle is found once; at the middle of the length
    two paths of one start meet, so none grows longer than half of it.
    """
    length = min(length, schema.MAX_CYCLE)
    links = _between(saved(edges.filter("edge_type = 'CALLS'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()))
    found = [links.filter("src = dst").select(F.array("src").alias("cycle"))]
    if length < 2:
        return found[0].select(F.size("cycle").cast("long").alias("length"), "cycle")
    steps = links.filter("src <> dst")

    def grow(paths: DataFrame, at: str, to: str) -> DataFrame:
        """Paths (start, way, end) one step longer, over ids above the start that are not on the way."""
        on = paths.join(steps.select(F.col(at).alias("end"), F.col(to).alias("next")), "end")
        return saved(on.filter((F.col("next") > F.col("start")) & ~F.array_contains("way", F.col("next"))).select("start", F.concat("way", F.array("next")).alias("way"), F.col("next").alias("end")))

    first = lambda at, to: saved(steps.filter(F.col(to) > F.col(at)).select(F.col(at).alias("start"), F.array(at, to).alias("way"), F.col(to).alias("end")))
    ahead, back = [first("src", "dst")], [first("dst", "src")]
    for n in range(2, length + 1):
        there, home = n // 2, n - n // 2
        while len(ahead) < there:
            ahead.append(grow(ahead[-1], "src", "dst"))
        while len(back) < home:
            back.append(grow(back[-1], "dst", "src"))
        other = back[home - 1].select("start", "end", F.slice("way", 2, max(home - 1, 1)).alias("rest") if home > 1 else F.array().cast("array<bigint>").alias("rest"))
        met = ahead[there - 1].join(other, ["start", "end"]).filter(~F.arrays_overlap("way", "rest"))
        found.append(met.select(F.concat("way", F.reverse("rest")).alias("cycle")))
    return reduce(DataFrame.unionByName, found).select(F.size("cycle").cast("long").alias("length"), "cycle")


def path_summary(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """One line of text for a path; at most as long as the hop limit."""
    named = path.join(nodes.select("id", "name"), "id")
    whole = named.agg(F.array_sort(F.collect_list(F.struct("step", "name"))).alias("x"))
    return whole.select(F.array_join(F.transform("x", lambda s: s["name"]), " -> ").alias("path"), (F.size("x") - 1).alias("hops"))
