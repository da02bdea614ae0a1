"""Vectors of code spans: validation, quantization, exact search, reuse, chunks and the index build."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker import schema
from wicker.operators.graphquery import ranked

#: A scope with more vectors is not scanned unless asked for.
GUARD = 300_000
#: Longest line that is embedded, share of a window that the next repeats, rows of a batch.
MAX_LINE, OVERLAP, MAX_BATCH = 2048, 0.15, 16
KEY = ["project", "model_id", "prompt_version", "task", "qualified_name", "chunk_idx", "content_sha256"]
#: The prompt of each embedding task.
PROMPTS = {
    "retrieval_query": "task: search result | query: {}",
    "retrieval_document": "title: none | text: {}",
    "code_retrieval_query": "task: code retrieval | query: {}",
    "question_answering": "task: question answering | query: {}",
    "fact_verification": "task: fact checking | query: {}",
    "classification": "task: classification | query: {}",
    "clustering": "task: clustering | query: {}",
    "sentence_similarity": "task: sentence similarity | query: {}",
}


def prompt(task: str, content: Column) -> Column:
    before, after = PROMPTS[task].split("{}")
    return F.concat(F.lit(before), content, F.lit(after))


def titled_document(title: Column, content: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("none")), F.lit(" | text: "), content)


def dot(a: Column, b: Column) -> Column:
    """In double precision, from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(v: Column) -> Column:
    return F.array_max(F.transform(v, F.abs)).cast("double") / 127.0


def quantize(v: Column, unit: Column) -> Column:
    """Whole numbers from -127 to 127 in steps of ``unit``; half steps go away from zero."""
    step = lambda x: F.greatest(F.least(F.round(x.cast("double") / unit), F.lit(127.0)), F.lit(-127.0)).cast("tinyint")
    return F.when(unit > 0, F.transform(v, step)).otherwise(F.transform(v, lambda x: F.lit(0).cast("tinyint")))


def problem(vector: Column, dims: int | None = None, sha: Column | None = None, chunk: Column | None = None) -> Column:
    """What is wrong with a vector's row, or null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.when(vector.isNull() | (F.size(vector) == 0), "empty").when(bad, "not finite").when(~F.exists(vector, lambda x: x != 0), "zero")
    if dims is not None:
        out = out.when(F.size(vector) != dims, "dimension")
    if sha is not None:
        out = out.when(~F.coalesce(sha.rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
    if chunk is not None:
        out = out.when(F.coalesce(chunk, F.lit(-1)) < 0, "chunk")
    return out


def validated(rows: DataFrame, dims: int) -> DataFrame:
    """The rows as they are; reading one that is not valid is an error."""
    what = problem(F.col("vector"), dims, F.col("content_sha256"), F.col("chunk_idx"))
    return rows.withColumn("_bad", what).filter(F.assert_true(F.col("_bad").isNull(), F.concat(F.lit("invalid vector: "), F.col("_bad"))).isNull()).drop("_bad")


def dedup_key() -> Column:
    return F.coalesce(F.concat(F.lit("node:"), F.col("node_id").cast("string")), F.concat(F.lit("name:"), F.col("qualified_name")))


def scoped(vectors: DataFrame, **fields) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column open."""
    for column, value in fields.items():
        if value is not None:
            vectors = vectors.filter(F.col(column) == value)
    return vectors


def guarded(vectors: DataFrame, most: int = GUARD) -> DataFrame:
    """The scope, unless it has too many rows to scan."""
    n = vectors.count()
    if n > most:
        raise ValueError(f"{n} vectors in scope, over the limit of {most}")
    return vectors


def search(vectors: DataFrame, query: list[float], k: int, min_score: float | None = None) -> DataFrame:
    """The k nodes with the best chunk for a query, by cosine.

    First a dot product of quantized vectors, pooled by node, picks 8k + 32
    nodes; then all chunks of those are compared exactly. Ties go by qualified
    name, chunk and id.
    """
    asked = F.array(*map(F.lit, map(float, query)))
    unit = max(map(abs, query)) / 127.0 or 1.0
    coarse = F.array(*(F.lit(float(max(-127, min(127, math.floor(abs(x) / unit + 0.5) * (1 if x >= 0 else -1))))) for x in query))
    rows = vectors.withColumn("key", dedup_key()).withColumn("_unit", scale(F.col("vector")))
    rough = rows.withColumn("_rough", dot(quantize(F.col("vector"), F.col("_unit")), coarse) * F.col("_unit") / norm(F.col("vector")))
    likely = rough.groupBy("key").agg(F.max("_rough").alias("_rough")).orderBy(F.desc("_rough"), "key").limit(8 * k + 32)
    exact = rows.join(F.broadcast(likely.select("key")), "key").withColumn("score", F.round(dot(F.col("vector"), asked) / norm(F.col("vector")) / norm(asked), 9))  # 8k + 32 rows
    if min_score is not None:
        exact = exact.filter(F.col("score") >= min_score)
    best = Window.partitionBy("key").orderBy(F.desc("score"), "qualified_name", "chunk_idx", "node_id")
    exact = exact.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_unit")
    return ranked(exact, [F.desc("score"), F.col("qualified_name"), F.col("chunk_idx"), F.col("node_id")], k)


def with_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node's present name and path instead of those stored with its vector."""
    now = nodes.select(F.col("id").alias("node_id"), F.col("qualified_name").alias("_q"), F.col("file_path").alias("_f"))
    joined = hits.join(now, "node_id", "left")
    return joined.withColumns({"qualified_name": F.coalesce("_q", "qualified_name"), "file_path": F.coalesce("_f", "file_path")}).drop("_q", "_f")


def newest(vectors: DataFrame) -> DataFrame:
    """Of each key the row of the latest generation."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("graph_generation"), "node_id")
    return vectors.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def to_embed(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates that no stored vector of the same key serves."""
    return candidates.join(vectors.select(*KEY).distinct(), KEY, "left_anti")


def pruned(vectors: DataFrame, generation: int) -> DataFrame:
    return vectors.filter(F.col("graph_generation") >= generation)


def candidates(nodes: DataFrame) -> DataFrame:
    """Nodes that get a vector: definitions."""
    return nodes.filter(F.col("label").isin(schema.DEFINITIONS))


def windows(header: str, lines: list[str], budget: int, cost: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """A header with each window of lines that fits a budget of tokens; windows overlap by OVERLAP.

    Lines over MAX_LINE bytes are left out. A line that is over the budget by
    itself makes a window of its own.
    """
    lines = [x for x in lines if len(x.encode()) <= MAX_LINE]
    room, out, start = max(1, budget - cost(header)), [], 0
    costs = [cost(x) for x in lines]
    while start < len(lines):
        end, used = start, 0
        while end < len(lines) and (end == start or used + costs[end] <= room):
            used += costs[end]
            end += 1
        out.append("\n".join([header, *lines[start:end]]))
        if end == len(lines):
            break
        back, kept = end, 0
        while back - 1 > start and kept + costs[back - 1] <= OVERLAP * room:
            back -= 1
            kept += costs[back]
        start = back
    return out


def batches(lengths: list[int]) -> Iterator[list[int]]:
    """Places of texts to embed together, in the order of their lengths.

    A batch has MAX_BATCH texts at most, its longest is no more than half again
    its shortest, and at most an eighth of it is padding.
    """
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        n = lengths[i]
        if held:
            total = sum(lengths[j] for j in held) + n
            padding = n * (len(held) + 1) - total
            if len(held) == MAX_BATCH or n > 1.5 * max(1, lengths[held[0]]) or padding > n * (len(held) + 1) / 8:
                yield held
                held = []
        held.append(i)
    if held:
        yield held


def build(spans: DataFrame, embed: Callable[[list[str]], list[list[float]]], budget: int = 256) -> DataFrame:
    """Vectors of spans (id, qualified_name, file_path, header, body) by an embedding function.

    Each span is cut into windows; windows of a batch of rows are embedded in
    groups of similar length.
    """

    def run(parts):
        for part in parts:
            rows = [(r, n, text) for r in part.itertuples(index=False) for n, text in enumerate(windows(r.header, r.body.split("\n"), budget))]
            found: dict[int, list[float]] = {}
            for group in batches([len(x[2]) for x in rows]):
                found |= zip(group, embed([rows[i][2] for i in group]), strict=True)
            yield pd.DataFrame([(r.id, n, r.qualified_name, r.file_path, text, found[i]) for i, (r, n, text) in enumerate(rows)], columns=["node_id", "chunk_idx", "qualified_name", "file_path", "text", "vector"])

    made = spans.select("id", "qualified_name", "file_path", "header", "body").mapInPandas(run, "node_id long, chunk_idx long, qualified_name string, file_path string, text string, vector array<float>")
    return made.withColumn("content_sha256", F.sha2("text", 256)).withColumn("vector_norm", norm(F.col("vector")).cast("float"))


def hash_embedding(texts: list[str], dims: int = 16) -> list[list[float]]:
    """A stand-in for a model: words hashed to signed places. For tests of the plumbing only."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * dims
        for word in text.split():
            h = zlib.crc32(word.encode())
            v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
        out.append(v if any(v) else [1.0] + [0.0] * (dims - 1))
    return out
