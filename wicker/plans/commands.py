"""What a user asks of the index, by name: thin plans over the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker import schema
from wicker.operators import graph, lexical, semantic, stats, store, traverse
from wicker.operators import vector as vectors
from wicker.operators.graph import IN, OUT
from wicker.operators.graphquery import GraphQuery, ranked

#: Symbols of a fused search whose neighbours count.
STRONG = 5


@dataclass
class Index:
    """The tables of one published index; whichever a command does not need may be missing."""

    nodes: DataFrame
    edges: DataFrame
    content: DataFrame | None = None
    vectors: DataFrame | None = None
    status: str = "fresh"
    cap: int = 40
    #: Weights of the fused search: literal lines, symbols, words, vectors, neighbours.
    fusion: dict[str, float] = field(default_factory=lambda: {"literal": 1.0, "symbol": 0.8, "semantic": 0.6, "vector": 0.6, "near": 0.3})

    def _fresh(self) -> None:
        if self.status not in ("fresh", "unknown"):
            raise RuntimeError(f"index is {self.status}")

    def _ids(self, name: str) -> DataFrame:
        """All nodes of a name; by qualified name if there are none."""
        self._fresh()
        found = self.nodes.filter(F.col("name") == name)
        return found if not found.isEmpty() else self.nodes.filter(F.col("qualified_name") == name)

    def _one(self, name: str) -> int:
        row = self._ids(name).select("id", "qualified_name").orderBy("qualified_name", "id").first()
        if row is None:
            raise LookupError(f"no symbol {name}")
        return row["id"]

    def shown(self, rows: DataFrame) -> dict:
        """The first rows with exact totals."""
        total = rows.count()
        kept = rows.limit(self.cap)
        return {"rows": kept, "total_exact": total, "shown": min(total, self.cap), "omitted": max(0, total - self.cap), "truncated": total > self.cap}

    def who_calls(self, name: str) -> DataFrame:
        return graph.first_neighbours(self.nodes, self.edges, self._one(name), IN)

    def callees(self, name: str) -> DataFrame:
        return graph.first_neighbours(self.nodes, self.edges, self._one(name), OUT)

    def references(self, name: str) -> DataFrame:
        return graph.ordered_references(self.nodes, self.edges, self._ids(name), schema.MAX_ROWS)

    def impact(self, name: str, hops: int = 6) -> DataFrame:
        return traverse.impact(self.nodes, self.edges, self._one(name), hops)

    def impact_since(self, hunks: DataFrame, hops: int = 6) -> DataFrame:
        """What depends on the symbols that changed lines (file_path, line) lie in."""
        self._fresh()
        starts = graph.enclosing(self.nodes, hunks).select("id")
        return traverse.reachable_from(self.nodes, self.edges, starts, schema.REFERENCES, hops, IN)

    def brief(self, name: str) -> dict[str, DataFrame]:
        return {"symbol": self._ids(name), "callers": self.who_calls(name), "callees": self.callees(name)}

    def path(self, source: str, target: str, hops: int = schema.MAX_HOPS) -> DataFrame:
        return traverse.shortest_path(self.edges, self._one(source), self._one(target), ["CALLS"], hops)

    def locate(self, path: str, line: int) -> DataFrame:
        places = self.nodes.sparkSession.createDataFrame([(path, line)], "file_path string, line long")
        return graph.enclosing(self.nodes, places)

    def fan_in(self, limit: int = 40) -> DataFrame:
        return graph.fan(self.nodes, self.edges, IN, "CALLS", limit)

    def fan_out(self, limit: int = 40) -> DataFrame:
        return graph.fan(self.nodes, self.edges, OUT, "CALLS", limit)

    def trace(self, name: str, hops: int = 4) -> DataFrame:
        return traverse.trace(self.nodes, self.edges, self._one(name), ["CALLS"], hops)

    def search_graph(self, query: GraphQuery) -> DataFrame:
        self._fresh()
        return query.run(self.nodes, self.edges)

    def search_symbols(self, query: str, limit: int = 20) -> DataFrame:
        self._fresh()
        return lexical.search_symbols(self.nodes, query, limit)

    def search_code(self, query: str, limit: int = 20) -> DataFrame:
        self._fresh()
        return lexical.search_code(self.content, query, limit)

    def vector_search(self, query: list[float], k: int = 10) -> DataFrame:
        self._fresh()
        return vectors.with_nodes(vectors.search(vectors.guarded(self.vectors), query, k), self.nodes)

    def semantic_search(self, query: str, limit: int = 20) -> DataFrame:
        self._fresh()
        return semantic.semantic_query(self.nodes, self.edges, query, limit)

    def fused_search(self, query: str, limit: int = 20, vector: list[float] | None = None) -> DataFrame:
        """Symbols by reciprocal ranks in symbol search, word search, the lines that match and the vectors near ``vector``, weighted by ``fusion``.

        The neighbours of the STRONG best ones get a little too.
        """
        self._fresh()
        share = lambda df, kind: df.select("id", (F.lit(self.fusion[kind]) / (F.col("rank") + 60)).alias("part"))
        parts = share(lexical.search_symbols(self.nodes, query, 200), "symbol").union(share(semantic.semantic_query(self.nodes, self.edges, query, 200), "semantic"))
        if self.content is not None:
            lines = lexical.search_code(self.content, query, 200).select(F.col("rel_path").alias("file_path"), "line", "rank")
            hits = graph.enclosing(self.nodes, lines).select("id", "rank")
            parts = parts.union(share(hits, "literal"))
        if vector is not None and self.vectors is not None:
            parts = parts.union(share(vectors.search(self.vectors, vector, 200).withColumnRenamed("node_id", "id"), "vector"))
        own = parts.groupBy("id").agg(F.sum("part").alias("part"))
        strong = own.orderBy(F.desc(F.round("part", 9)), "id").limit(STRONG).select("id")
        beside = semantic.near(self.edges, strong).select("id", (F.lit(self.fusion["near"]) / 60).alias("part"))
        total = own.union(beside).groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"))
        return ranked(self.nodes.join(total, "id"), [F.desc("score"), F.col("qualified_name"), F.col("id")], limit)

    def context(self, query: str, lines: int = 60) -> DataFrame:
        """The lines of the symbol of that name, or of the best by words; at most so many."""
        exact = self._ids(query).orderBy("qualified_name", "id").limit(1)
        found = exact if not exact.isEmpty() else semantic.semantic_query(self.nodes, self.edges, query, 1)
        span = F.broadcast(found.select(F.col("file_path").alias("rel_path"), "start_line", "end_line"))  # one symbol
        return self.content.join(span, "rel_path").filter(F.col("line").between(F.col("start_line"), F.least(F.col("end_line"), F.col("start_line") + lines - 1))).orderBy("line")

    def stats(self) -> DataFrame:
        return stats.graph_stats(self.nodes, self.edges)

    def diagnostics(self, files: DataFrame, skips: DataFrame, providers: DataFrame) -> DataFrame:
        return stats.diagnostics(self.nodes, self.edges, files, skips, providers)

    def status_figures(self) -> DataFrame:
        """``figure, n``: how large the index is, and its status."""
        count = lambda figure, rows: rows.agg(F.lit(figure).alias("figure"), F.count("*").alias("n"))
        status = self.nodes.sparkSession.createDataFrame([(f"status {self.status}", 1)], "figure string, n long")
        return count("nodes", self.nodes).union(count("edges", self.edges)).union(count("files", self.nodes.select("file_path").distinct())).union(status)

    def expand(self, packs: DataFrame, pack: str, now: int) -> DataFrame:
        return store.live_packs(packs, F.lit(now)).filter(F.col("id") == pack)
