"""Approximate nearest neighbours: inverted lists scanned dimension by dimension."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.llm.common import materialize

#: Vectors on which the lists are fitted, at most; all vectors are indexed.
SAMPLE = 20_000
#: Sample vectors that stand for queries when the number of probes is chosen, and the recall that it must reach there.
TRIALS, RECALL = 200, 0.97
#: Lists a query looks at first, to learn how near its neighbours are at most.
FIRST = 2
#: Vectors of a list that are scanned together.
LIST_BLOCK = 4096
#: Dimensions of a column block.
COLUMNS = 16
#: How far a partial distance may stray, in standard deviations of the test.
EPSILON = 2.1


def usable(vector: Column) -> Column:
    """Not null, no component null or not finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else tiny or huge components leave the range when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation, and list centres of the rotated unit vectors by a few rounds of k-means."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
    x = _unit(sample) @ turn
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(8):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.linalg.norm(sums, axis=1) > 1e-9
        centres[filled] = sums[filled] / np.linalg.norm(sums[filled], axis=1, keepdims=True)
    return turn, centres


def enough_probes(sample: np.ndarray, turn: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The fewest lists that a query must probe so that TRIALS sample vectors find RECALL of their k nearest in the sample."""
    x = _unit(sample) @ turn
    own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    places = []
    for i in range(0, len(x), max(1, len(x) // TRIALS)):
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argsort(-near)[: min(k, len(x) - 1)]
        rank = np.empty(len(centres), np.int64)
        rank[np.argsort(-(centres @ x[i]))] = np.arange(len(centres))
        places += rank[own[best]].tolist()
    return int(np.quantile(places, RECALL, method="higher")) + 1 if places else len(centres)


def scan(queries: np.ndarray, rows: np.ndarray, k: int, asked: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each rotated unit query, the rows that may be among its k nearest of this block.

    Column block by column block the squared distances grow. After d of D
    dimensions a random rotation makes the partial distance times D / d an
    estimate of the whole, whose relative error is about 1 / sqrt(d). A row is
    abandoned as soon as its estimate is over the k-th distance known so far by
    EPSILON such errors: the hypothesis that it is nearer is then rejected. The
    k-th distance known is that of the lists before (``bounds``) or of the rows that
    look nearest after the first block, whose distances are taken whole, whichever
    is less. Rows of the query's own id don't count.
    """
    dims, out = rows.shape[1], []
    blocks = [(a, min(dims, a + COLUMNS)) for a in range(0, dims, COLUMNS)]
    columns = [np.ascontiguousarray(rows[:, a:b]) for a, b in blocks]
    norms = [(c * c).sum(axis=1) for c in columns]
    first = norms[0][None, :] + (queries[:, : blocks[0][1]] ** 2).sum(axis=1)[:, None] - 2 * queries[:, : blocks[0][1]] @ columns[0].T
    for i, q, partial, known in zip(asked, queries, first, bounds, strict=True):
        alive, bound = np.arange(len(rows)), known
        if len(rows) > 8 * k:
            seeds = np.argpartition(partial, 2 * k + 1)[: 2 * k + 2]
            whole = np.where(ids[seeds] == i, np.inf, ((rows[seeds] - q) ** 2).sum(axis=1))
            bound = min(known, np.partition(whole, k - 1)[k - 1] + 1e-12)
        if bound < np.inf:
            for n, (a, b) in enumerate(blocks):
                if n:
                    partial = partial + ((columns[n][alive] - q[a:b]) ** 2).sum(axis=1)
                slack = (1 + EPSILON / math.sqrt(b)) ** 2 if b < dims else 1 + 1e-9
                near = partial * (dims / b) <= bound * slack
                alive, partial = alive[near], partial[near]
        out.append(alive[ids[alive] != i])
    return out


def _even(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their components can be squared; no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in double precision on the original vectors."""
    query, rows = _even(query), _even(rows)
    return rows @ query / (np.linalg.norm(rows, axis=1) * np.linalg.norm(query))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest rows found of each query, by cosine.

    Lists are fitted on at most SAMPLE vectors, chosen by a hash of their id; all
    vectors are put in the list whose centre is nearest. Each query scans its
    ``probes`` nearest lists (see ``scan``) and scores what survives exactly, in
    double precision on the original vectors: first FIRST lists, then the others
    with the k-th distance found there. By default there are half as many lists as
    the root of the number of rows, and as many probes as the sample needs for a
    recall of RECALL: few where vectors form clusters, most where they are spread
    evenly. The rows of a list are dealt out once, in blocks of about LIST_BLOCK, so
    a list that holds most rows is scanned by many tasks; the queries go to the
    blocks and stream past them.

    A row is no candidate for a query of the same id. Ties go to the smaller id.
    Null, empty and zero vectors and those with null or non-finite components,
    null ids, and vectors of another length than the most frequent one take no
    part; repeated rows of an id are candidates each. A query without candidates
    has no rows. An empty table gives no rows.
    """
    kept = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = kept(vectors), kept(queries)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, id {kind}, score double"
    spark = vectors.sparkSession
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]
    rows, asked = rows.filter(F.size("v") == dims), asked.filter(F.size("v") == dims)
    lists = lists or max(1, math.isqrt(total) // 2)
    share = min(1.0, 1.2 * SAMPLE / total)
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    sample = _matrix(chosen["v"]) if len(chosen) else _matrix(rows.limit(1).toPandas()["v"])
    turn, centres = fit(sample, lists)
    probes = min(probes or enough_probes(sample, turn, centres, k), len(centres))
    fitted = spark.sparkContext.broadcast((turn, centres))  # dims x dims, and as many centres as the root of the rows, SAMPLE at most

    def assign(batches):
        turn, centres = fitted.value
        for batch in batches:
            if len(batch):
                near = (_unit(_matrix(batch["v"])) @ turn @ centres.T).argmax(axis=1)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "list": near})

    element = vectors.schema[vector_col].dataType.simpleString()
    listed = materialize(rows.mapInPandas(assign, f"id {kind}, v {element}, list int"))
    counts = listed.groupBy("list").agg(F.count("*").alias("n")).collect()  # a row per list
    blocks = {r["list"]: -(-r["n"] // LIST_BLOCK) for r in counts}
    many = F.element_at(F.create_map(*(F.lit(x) for p in blocks.items() for x in p)), F.col("list"))
    nothing = F.lit(None).cast("double")
    dealt = listed.select("list", F.pmod(F.xxhash64("id", "v"), many).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v", nothing.alias("bound"))

    def sent(asked: DataFrame, first: int, last: int) -> DataFrame:
        """The queries (id, v, bound) at each block of the lists that are first-nearest to last-nearest to them."""

        def probe(batches):
            turn, centres = fitted.value
            for batch in batches:
                if len(batch):
                    near = np.argsort(-(_unit(_matrix(batch["v"])) @ turn @ centres.T), axis=1)[:, first:last]
                    out = [(int(x), b, True, i, v, bound) for i, v, bound, own in zip(batch["id"], batch["v"], batch["bound"], near, strict=True) for x in own for b in range(blocks.get(int(x), 0))]
                    yield pd.DataFrame(out, columns=["list", "block", "asks", "id", "v", "bound"])

        return asked.select("id", "v", "bound").mapInPandas(probe, f"list int, block int, asks boolean, id {kind}, v {element}, bound double")

    def look(batches):
        """Rows of a block come first and are kept, its queries after them stream past."""
        turn, _ = fitted.value
        at, held, ready = None, [], None
        for batch in batches:
            found = []
            for (block, part, asks), own in batch.groupby(["list", "block", "asks"], sort=False):
                if at != (block, part):
                    at, held, ready = (block, part), [], None
                if not asks:
                    held.append(own)
                    continue
                if not held:
                    continue
                if ready is None:
                    every = pd.concat(held)
                    ids, original = every["id"].to_numpy(), _matrix(every["v"])
                    ready = ids, original, _unit(original) @ turn
                ids, original, turned = ready
                q, bounds = _matrix(own["v"]), own["bound"].fillna(np.inf).to_numpy()
                for i, one, alive in zip(own["id"], q, scan(_unit(q) @ turn, turned, k, own["id"].to_numpy(), ids, bounds), strict=True):
                    scores = _exact(one, original[alive])
                    best = np.lexsort((ids[alive], -scores))[:k]
                    found += zip([i] * len(best), ids[alive][best], scores[best], strict=True)
            yield pd.DataFrame(found, columns=["query_id", "id", "score"])

    def met(queries: DataFrame) -> DataFrame:
        """``query_id, id, score``: up to k rows of each block for each query that comes to it."""
        together = dealt.unionByName(queries).repartition("list", "block").sortWithinPartitions("list", "block", "asks")
        return materialize(together.mapInPandas(look, f"query_id {kind}, id {kind}, score double"))

    far = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("id")))), 1, k)  # k rows per probed block
    near = met(sent(asked.withColumn("bound", nothing), 0, min(FIRST, probes)))
    if probes > FIRST:
        # The distance of unit vectors with that cosine, a little more for rounding.
        reach = F.when(F.size("best") == k, 2 + 2 * F.element_at("best", k)["far"] + 1e-9).alias("bound")
        bounds = near.groupBy("query_id").agg(far.alias("best")).select(F.col("query_id").alias("id"), reach)
        near = near.unionByName(met(sent(asked.join(bounds, "id", "left"), FIRST, probes)))
    top = near.groupBy("query_id").agg(far.alias("best"))
    return top.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.id", (-F.col("col.far")).alias("score"))
