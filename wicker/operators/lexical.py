"""Full-text search over symbols and content lines, ranked by BM25."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.text import camel_split, fold_accents
from wicker.operators.graphquery import ranked, without_pseudo

#: Okapi's saturation and length weights, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, repeats included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def symbol_tokens(nodes: DataFrame) -> DataFrame:
    """``id, tokens``: a node's words in all indexed columns."""
    split = F.concat_ws(" ", camel_split(F.col("name")), camel_split(F.col("qualified_name")))
    return nodes.select("id", F.concat(tokens(split), *(tokens(F.col(c)) for c in ("qualified_name", "label", "file_path"))).alias("tokens"))


def content_tokens(content: DataFrame) -> DataFrame:
    """The lines with their words, accents removed."""
    return content.withColumn("tokens", tokens(fold_accents(F.col("snippet"))))


def postings(docs: DataFrame, *keys: str) -> DataFrame:
    """``*keys, token, tf, length, places``: an inverted index of documents with ``tokens``; places count from 0."""
    rows = docs.select(*keys, F.size("tokens").alias("length"), F.posexplode("tokens").alias("place", "token"))
    grouped = rows.groupBy(*keys, "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.array_sort(F.collect_list("place")).alias("places"))
    return grouped.select(*(F.col(k).alias(k.rpartition(".")[2]) for k in keys), "token", "tf", "length", "places")


def symbol_postings(nodes: DataFrame) -> DataFrame:
    return postings(symbol_tokens(nodes), "id").drop("places")


#: What names a line.
LINE = ["project", "rel_path", "line"]


def content_postings(content: DataFrame) -> DataFrame:
    return postings(content_tokens(content), *LINE)


@dataclass(frozen=True)
class TextIndex:
    """Postings, and one row with the number of documents and of their words."""

    postings: DataFrame
    size: DataFrame


def bm25(counts: DataFrame, terms: list[str], everything: DataFrame) -> DataFrame:
    """Add ``rank_score`` to documents with a count ``tf_i`` per term and their ``length``; smaller is better.

    ``everything`` is one row with ``n`` documents and ``total`` length. Document
    frequencies count the rows given, which must be all that have the term.
    """
    dfs = counts.agg(*(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))))
    rows = counts.crossJoin(F.broadcast(dfs.crossJoin(everything)))  # one row on the right
    norm = K1 * (1 - B + B * F.col("length") * F.col("n") / F.col("total"))

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)), F.lit(LEAST_IDF))
        return idf * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + norm)

    score = reduce(lambda a, b: a + b, (part(i) for i in range(len(terms))))
    return rows.withColumn("rank_score", F.round(-score, 9)).drop("n", "total", *(f"df_{i}" for i in range(len(terms))))


def size(docs: DataFrame) -> DataFrame:
    """One row with the number of documents and of their words."""
    return docs.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"))


def symbol_index(nodes: DataFrame) -> TextIndex:
    return TextIndex(symbol_postings(nodes), size(symbol_tokens(nodes)))


def content_index(content: DataFrame) -> TextIndex:
    return TextIndex(content_postings(content), size(content_tokens(content)))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def symbol_matches(nodes: DataFrame, terms: list[str], index: TextIndex | None = None) -> DataFrame:
    """Nodes in which every term is the beginning of some word, with their scores.

    Only the postings of words that begin with a term are read.
    """
    index = index or symbol_index(nodes)
    begins = [F.col("token").startswith(t) for t in terms]
    hits = index.postings.filter(_any(begins))
    counts = hits.groupBy("id").agg(F.first("length").alias("length"), *(F.sum(F.when(c, F.col("tf")).otherwise(0)).alias(f"tf_{i}") for i, c in enumerate(begins)))
    scored = bm25(counts, terms, index.size).filter(reduce(lambda a, b: a & b, (F.col(f"tf_{i}") > 0 for i in range(len(terms)))))
    return without_pseudo(nodes).join(scored.select("id", "rank_score"), "id")


def query_terms(query: str) -> list[str]:
    """The words of a query, as ``camel_split`` sees them."""
    s = re.sub("([a-z0-9])([A-Z])", r"\1 \2", query)
    s = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", s)
    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in s).split()
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]


def search_symbols(nodes: DataFrame, query: str, limit: int, project: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Symbols for a query, best first. The project restricts the result, not the statistics."""
    terms = query_terms(query)
    if not terms:
        return nodes.limit(0).withColumns({"rank_score": F.lit(0.0), "rank": F.lit(0)})
    found = symbol_matches(nodes, terms, index)
    if project is not None:
        found = found.filter(F.col("project") == project)
    return ranked(found, [F.col("rank_score"), F.col("id")], limit)


def count_symbols(nodes: DataFrame, query: str, index: TextIndex | None = None) -> DataFrame:
    return symbol_matches(nodes, query_terms(query), index).agg(F.count("*").alias("n"))


def phrases(query: str) -> list[list[str]]:
    """Each word of the query as the run of letters-and-digits words that it stands for, folded."""
    folded = "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c)).lower()
    return ["".join(c if c.isalpha() or c.isnumeric() else " " for c in w).split() for w in folded.split()]


def occurrences(places: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in a document, as consecutive words; ``places`` maps its words to their places."""
    if len(phrase) == 1:
        return F.coalesce(F.size(places[phrase[0]]), F.lit(0))
    follows = lambda x: reduce(lambda a, b: a & b, (F.array_contains(places[p], x + j) for j, p in enumerate(phrase[1:], 1)))
    whole = reduce(lambda a, b: a & b, (places[p].isNotNull() for p in phrase))
    return F.when(whole, F.size(F.filter(places[phrase[0]], follows))).otherwise(0)


def content_matches(content: DataFrame, query: str, index: TextIndex | None = None) -> DataFrame:
    """``project, rel_path, line, rank_score`` of lines that have every phrase of the query; none if a phrase is empty.

    Only the postings of the query's words are read; no text is.
    """
    terms = phrases(query)
    if not terms or not all(terms):
        return content.limit(0).select(*LINE, F.lit(0.0).alias("rank_score"))
    index = index or content_index(content)
    hits = index.postings.filter(F.col("token").isin(sorted({w for t in terms for w in t})))
    lines = hits.groupBy(*LINE).agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("places"))
    counts = lines.select(*LINE, "length", *(occurrences(F.col("places"), t).alias(f"tf_{i}") for i, t in enumerate(terms)))
    scored = bm25(counts.filter(_any(F.col(f"tf_{i}") > 0 for i in range(len(terms)))), [str(t) for t in terms], index.size)
    return scored.filter(reduce(lambda a, b: a & b, (F.col(f"tf_{i}") > 0 for i in range(len(terms))))).select(*LINE, "rank_score")


def search_code(content: DataFrame, query: str, limit: int, project: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Lines for a query. One that holds the quoted phrase as it stands comes first, then by BM25.

    Only a quoted query looks at the lines of all hits, any other at those shown.
    """
    quoted = len(query) > 1 and query[0] == query[-1] == '"'
    plain = query.strip('"') if quoted else query
    found = content_matches(content, plain, index)
    if project is not None:
        found = found.filter(F.col("project") == project)
    order = [F.desc("exact"), F.col("rank_score"), F.col("rel_path"), F.col("line")]
    if quoted:
        return ranked(content.join(found, LINE).withColumn("exact", F.lower("snippet").contains(plain.lower())), order, limit)
    shown = ranked(found.withColumn("exact", F.lit(False)), order, limit)
    return content.join(F.broadcast(shown) if limit <= 10_000 else shown, LINE)


def search_code_ranked(content: DataFrame, query: str, limit: int, index: TextIndex | None = None) -> DataFrame:
    """As ``search_code``, with a relevance from 0 to 1 over what is shown; 1 if all are equal."""
    found = search_code(content, query, limit, index=index)
    shown = Window.partitionBy(F.lit(0))  # at most the limit
    best, worst = F.min("rank_score").over(shown), F.max("rank_score").over(shown)
    return found.withColumn("relevance", F.when(worst == best, F.lit(1.0)).otherwise((worst - F.col("rank_score")) / (worst - best)))


def count_content(content: DataFrame, query: str, index: TextIndex | None = None) -> DataFrame:
    return content_matches(content, query, index).agg(F.count("*").alias("n"))


def search_changed(content: DataFrame, changed: DataFrame, pattern: str) -> DataFrame:
    """Lines of the changed files that a regular expression matches."""
    return content.join(changed.select("rel_path").distinct(), "rel_path", "left_semi").filter(F.col("snippet").rlike(pattern))


def content_rows(files: DataFrame) -> DataFrame:
    """``rel_path, line, snippet`` of files (rel_path, text): trimmed right, empty ones dropped."""
    rows = files.select("rel_path", F.posexplode(F.split("text", "\n")).alias("p", "raw"))
    return rows.select("rel_path", (F.col("p") + 1).alias("line"), F.regexp_replace("raw", r"\s+$", "").alias("snippet")).filter("snippet <> ''")

