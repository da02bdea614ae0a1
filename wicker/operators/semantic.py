"""Explainable ranking of symbols by their words: weighted overlap plus bonuses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions import minhash
from wicker.functions.text import camel_tokens, dir_name, path_segments
from wicker.operators.components import saved
from wicker.operators.graphquery import ranked, without_pseudo
from wicker.operators.lexical import query_terms

#: The bonuses, and the agreement from which the signature counts.
LABEL, FILE, SIGNATURE, PATH, EDGE = 0.15, 0.10, 0.10, 0.12, 0.14
LEAST_AGREEMENT, RELATED = 0.30, 0.5
#: Anchors that are broadcast to the edges, at most.
ANCHORS = 100_000
MOST = 1 + LABEL + FILE + SIGNATURE + PATH + EDGE
#: Edge types whose neighbours are near, and the labels that a query can name.
NEAR_TYPES = ["CALLS", "USES", "IMPORTS"]
LABEL_WORDS = ["function", "method", "struct", "class", "trait", "enum", "module", "import", "impl", "call", "typealias"]


def label_words(query: str) -> list[str]:
    """Labels that a query names as a whole word; a plural names none."""
    padded = f" {query.lower()} "
    return [w for w in LABEL_WORDS if f" {w} " in padded]


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def with_tokens(nodes: DataFrame, text: Column | None = None) -> DataFrame:
    """Nodes with ``tokens``, the distinct words of name and qualified name or of another text."""
    return nodes.withColumn("tokens", camel_tokens(F.concat_ws(" ", "name", "qualified_name") if text is None else text))


def worded(nodes: DataFrame) -> DataFrame:
    """Nodes with ``tokens`` and their ``signature``, to be stored with them."""
    return with_tokens(nodes).withColumn("signature", minhash.signature(F.col("tokens")))


def weights(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``token, df`` and one row with the number of documents that have any word."""
    df = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df, rows.filter(F.size("tokens") > 0).agg(F.count("*").alias("docs"))


def _weight(df: Column, docs: Column) -> Column:
    return F.log((docs + 1.0) / (df + 1.0)) + 1.0


def overlap(rows: DataFrame, terms: list[str], own: str = "tokens", stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id, jaccard``: the weighted words shared with the query over those of either.

    Sums go over the exploded words, so no row's words are ever looked up one by
    one; the query's own weights are one row.
    """
    df, docs = stats or weights(rows)
    asked = rows.sparkSession.createDataFrame([(t,) for t in terms], "token string")
    asked = asked.join(df, "token", "left").crossJoin(docs).select("token", _weight(F.coalesce("df", F.lit(0)), F.col("docs")).alias("w"))
    whole = asked.agg(F.sum("w").alias("query_w"))
    words = rows.select("id", F.explode(own).alias("token")).join(df, "token").crossJoin(F.broadcast(docs))
    words = words.withColumn("w", _weight(F.col("df"), F.col("docs")))
    shared = F.when(F.col("token").isin(terms), F.col("w")).otherwise(0.0)
    sums = words.groupBy("id").agg(F.sum("w").alias("node_w"), F.sum(shared).alias("inter_w"))
    return sums.crossJoin(F.broadcast(whole)).select("id", (F.col("inter_w") / (F.col("node_w") + F.col("query_w") - F.col("inter_w"))).alias("jaccard"), (F.col("inter_w") > 0).alias("meets"))


def resolve_anchor(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The node whose name has no word besides the query's; the lowest (qualified name, id). One row or none."""
    own = camel_tokens(F.col("name"))
    found = rows.filter((F.size(own) > 0) & (F.size(F.array_except(own, _array(terms))) == 0))
    return found.agg(F.min(F.struct("qualified_name", "id")).alias("x")).select(F.col("x.id").alias("id")).filter("id is not null")


def near(edges: DataFrame, anchors: DataFrame, kinds: list[str] = NEAR_TYPES) -> DataFrame:
    """``id, anchors``: nodes one hop from any anchor, either way, and from how many; not the anchors."""
    typed = edges.filter(F.col("edge_type").isin(kinds)).filter("source_id <> target_id")
    ids = saved(anchors.select(F.col("id").alias("anchor")).distinct())
    ids = F.broadcast(ids) if ids.count() <= ANCHORS else ids
    out = typed.join(ids, F.col("source_id") == F.col("anchor")).select("anchor", F.col("target_id").alias("id"))
    back = typed.join(ids, F.col("target_id") == F.col("anchor")).select("anchor", F.col("source_id").alias("id"))
    found = out.union(back).distinct().groupBy("id").agg(F.count("*").alias("anchors"))
    return found.join(ids, F.col("id") == F.col("anchor"), "left_anti")


def score(rows: DataFrame, terms: list[str], query: str, near_file: str | None, neighbours: DataFrame, per_extra: float = 0.0) -> DataFrame:
    """All candidates with their parts and ``score``; those that neither share a word nor are near go.

    Rows that come from ``worded`` bring words and signature along; for others
    they are made.
    """
    rows = (rows if "signature" in rows.columns else worded(rows)).filter(F.size("tokens") > 0)
    parts = rows.join(overlap(rows, terms), "id").join(neighbours, "id", "left").filter(F.col("meets") | F.col("anchors").isNotNull())
    segments = path_segments(F.col("qualified_name"))
    matched = F.size(F.array_intersect(segments, _array(terms)))
    asked = _array(terms)
    one = rows.sparkSession.range(1).select(minhash.signature(asked).alias("_query"))
    parts = parts.crossJoin(F.broadcast(one))  # one row on the right
    agree = minhash.agreement(F.col("signature"), F.col("_query"))
    wanted = dir_name(F.lit(near_file or ""))
    edge = F.when(F.col("anchors").isNotNull(), EDGE + per_extra * (F.col("anchors") - 1)).otherwise(0.0)
    bonus = {
        "token_overlap": F.col("jaccard"),
        "label_affinity": F.when(F.lower("label").isin(label_words(query)) & F.lower("label").isin(LABEL_WORDS), LABEL).otherwise(0.0),
        "file_proximity": F.when((wanted != "") & (dir_name(F.col("file_path")) == wanted), FILE).otherwise(0.0),
        "simhash": F.when(agree > LEAST_AGREEMENT, (agree - LEAST_AGREEMENT) / (1 - LEAST_AGREEMENT) * SIGNATURE).otherwise(0.0),
        "qname_path": F.when(F.size(segments) > 0, matched / F.size(segments) * PATH).otherwise(0.0),
        "edge_proximity": edge,
    }
    parts = parts.withColumns({k: v.cast("double") for k, v in bonus.items()})
    total = sum((F.col(k) for k in list(bonus)[1:]), F.col("token_overlap"))
    return parts.withColumn("score", F.round(total, 9)).drop("tokens", "signature", "_query", "jaccard", "meets", "anchors")


def in_order(scored: DataFrame, limit: int) -> DataFrame:
    """Best first; then by qualified name, the newest id first."""
    return ranked(scored, [F.desc("score"), F.col("qualified_name"), F.desc("id")], limit)


def semantic_query(nodes: DataFrame, edges: DataFrame, query: str, limit: int, near_file: str | None = None, project: str | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    rows = without_pseudo(_scope(nodes, project), labels)
    return _plain(_labelled(rows, labels), edges, list(dict.fromkeys(query_terms(query))), query, limit, near_file)


def semantic_query_expanded(nodes: DataFrame, edges: DataFrame, query: str, limit: int, near_file: str | None = None, project: str | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """The words of each word of the query by itself; stand-ins are not excluded."""
    terms = list(dict.fromkeys(t for w in query.split() for t in query_terms(w)))
    return _plain(_labelled(_scope(nodes, project), labels), edges, terms, query, limit, near_file)


def semantic_query_multi_anchor(nodes: DataFrame, edges: DataFrame, query: str, names: list[str], limit: int, near_file: str | None = None, project: str | None = None) -> DataFrame:
    """Nearness counts once per anchor that a node is next to."""
    rows, terms = _scope(nodes, project), list(dict.fromkeys(query_terms(query)))
    anchors = [resolve_anchor(rows, list(dict.fromkeys(query_terms(n)))) for n in names if query_terms(n)]
    found = anchors[0]
    for a in anchors[1:]:
        found = found.union(a)
    return in_order(score(rows, terms, query, near_file, near(edges, found), EDGE), limit)


def semantic_query_diversified(nodes: DataFrame, edges: DataFrame, query: str, limit: int, per_group: int) -> DataFrame:
    """At most so many of each (file, name) in the order of rank, with a confidence from 0 to 1."""
    found = semantic_query(nodes, edges, query, max(limit, min(8 * limit, 10_000), 1))
    place = Window.partitionBy("file_path", "name").orderBy("rank")
    kept = found.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= max(1, per_group)).drop("_n", "rank")
    return in_order(kept, limit).withColumn("confidence", F.least(F.greatest(F.col("score") / MOST, F.lit(0.0)), F.lit(1.0)))


def related_symbols(nodes: DataFrame, edges: DataFrame, name: str, limit: int, project: str | None = None) -> DataFrame:
    """Symbols that share words with the anchor's own name or are next to it; never the anchor."""
    rows = _scope(nodes, project)
    anchor = resolve_anchor(rows, list(dict.fromkeys(query_terms(name))))
    row = rows.join(F.broadcast(anchor), "id").select("name").limit(1).collect()  # one name
    if not row:
        return rows.limit(0).withColumns({"score": F.lit(0.0), "edge_adjacent": F.lit(False), "rank": F.lit(0)})
    terms = list(dict.fromkeys(query_terms(row[0]["name"])))
    named = rows.join(F.broadcast(anchor.select(F.col("id").alias("anchor"))), F.col("id") == F.col("anchor"), "left_anti")
    named = named.withColumn("leaf", camel_tokens(F.col("name"))).filter(F.size("leaf") > 0)
    scored = named.join(overlap(named, terms, "leaf", weights(with_tokens(rows))), "id").join(near(edges, anchor), "id", "left")
    adjacent = F.col("anchors").isNotNull()
    scored = scored.filter(adjacent | F.col("meets")).withColumn("edge_adjacent", adjacent)
    return in_order(scored.withColumn("score", F.round(F.col("jaccard") + F.when(adjacent, RELATED).otherwise(0.0), 9)), limit)


def semantic_query_fielded(nodes: DataFrame, query: str, field: str, limit: int, project: str | None = None) -> DataFrame:
    """Overlap within one field: name, qualified_name or doc (of the properties)."""
    text = F.get_json_object("properties", "$.doc") if field == "doc" else F.col(field)
    rows = with_tokens(_scope(nodes, project), F.coalesce(text, F.lit(""))).filter(F.size("tokens") > 0)
    scored = rows.join(overlap(rows, list(dict.fromkeys(query_terms(query)))), "id").filter("meets")
    return in_order(scored.withColumn("score", F.round("jaccard", 9)), limit)


def _scope(nodes: DataFrame, project: str | None) -> DataFrame:
    return nodes if project is None else nodes.filter(F.col("project") == project)


def _labelled(nodes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return nodes.filter(F.col("label").isin(list(labels))) if labels else nodes


def _plain(rows: DataFrame, edges: DataFrame, terms: list[str], query: str, limit: int, near_file: str | None) -> DataFrame:
    return in_order(score(rows, terms, query, near_file, near(edges, resolve_anchor(rows, terms))), limit)


def normalized(query: str) -> str:
    """White space collapsed, case kept."""
    return re.sub(r"\s+", " ", query).strip()
