"""Substring dedup by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.llm.common import digest, materialize, small, small_batches
from wicker.llm.repeats import _merged, _rest

#: A cut may follow a byte where the top bits of the gear hash are zero: one byte in 2 ** CUT_BITS.
CUT_BITS = 5
#: Bytes of a chunk, at least (but for a whole text) and at most.
LEAST, MOST = 24, 512
#: Texts whose chunks are in memory together.
TEXTS = 200
#: Digests of texts that lose something, which are broadcast, at most.
TOUCHED = 2_000_000
#: Bytes of a text that are hashed together.
BLOCK = 1 << 22
#: The bytes that a 32-bit gear hash depends on.
REACH = 32
_GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + GEAR[data[i]] mod 2^32 for every byte, by doubling the span."""
    h, span = _GEAR[data], 1
    while span < REACH:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span) if span < len(h) else 0
        h, span = more, 2 * span
    return h


def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """The chunks of data as (from, to), the last of any length.

    Where a cut may fall depends on the last 32 bytes only, so an insertion
    moves the cuts around it and none after the next one that both texts take.
    """
    start = 0
    for at in range(0, len(data), BLOCK):
        before = min(at, REACH - 1)
        h = gear(np.frombuffer(data[at - before : at + BLOCK], np.uint8))[before:]
        for end in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + (at + 1)).tolist():
            while end - start > MOST:
                yield start, start + MOST
                start += MOST
            if end - start >= LEAST:
                yield start, end
                start = end
    while len(data) - start > MOST:
        yield start, start + MOST
        start += MOST
    if start < len(data):
        yield start, len(data)


def cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """The chunks of data as (from, to): a short last one goes with the one before it.

    So only a whole text is ever under LEAST bytes; if the two are over MOST
    together, the last LEAST bytes are a chunk.
    """
    held = None
    for a, b in _cuts(data):
        if held and b - a < LEAST:
            a = held[0]
            if b - a > MOST:
                yield a, b - LEAST
                a = b - LEAST
        elif held:
            yield held
        held = a, b
    if held:
        yield held


def chunked(docs: DataFrame) -> DataFrame:
    """``id, d1, d2, a, b, g1, g2``: all chunks of each row and their 128-bit digests."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                owner, a, b, digests = [], [], [], []
                for n, text in enumerate(part.column("text").to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    spans = list(cuts(data))
                    owner += [n] * len(spans)
                    a += [i for i, _ in spans]
                    b += [j for _, j in spans]
                    digests += [xxhash.xxh3_128_digest(data[i:j]) for i, j in spans]
                halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64)
                own = [part.column(c).take(pa.array(owner, pa.int64())) for c in ("id", "d1", "d2")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(halves[::2]), pa.array(halves[1::2])], ["id", "d1", "d2", "a", "b", "g1", "g2"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, d1 long, d2 long, a int, b int, g1 long, g2 long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, d1, d2, spans, first_ids``: for each text the chunks that an earlier text, or place, has.

    Earlier is by id, then text digest, then place; the first of equal chunks
    stays. ``first_ids`` are the ids, but for null, that hold those firsts. Rows of the same id
    and text are one document. Digests are counted before any group is formed,
    so the hot ones are no larger than the rest.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *digest(F.col(text_col)))
    every = chunked(small_batches(rows))
    often = materialize(every.groupBy("g1").agg(F.count("*").alias("n")).filter("n > 1").select("g1"))  # on its own, so that a join with it can split a hot digest
    likely = materialize(every.join(often, "g1", "left_semi"))
    where = F.struct("id", "d1", "d2", "a")
    firsts = materialize(likely.groupBy("g1", "g2").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter("n > 1").select("g1", "g2", "first"))
    later = likely.join(firsts, ["g1", "g2"]).filter(~where.eqNullSafe(F.col("first")))
    return later.groupBy("id", "d1", "d2").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.collect_set("first.id").alias("first_ids"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with ``n_bytes, n_removed, n_spans, first_ids, kept_text``, which take the place of columns of those names.

    A null text is empty; an empty table gives no rows; a character that is cut
    apart goes with the chunk that cuts it. ``first_ids`` (sorted) is empty where
    nothing was removed.
    """
    row, text = F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    keyed = docs.select(row, F.col(id_col).alias("id"), text, *digest(F.col(text_col)))
    none = F.array().cast(f"array<{docs.schema[id_col].dataType.simpleString()}>")
    found = materialize(repeated(docs, id_col, text_col).withColumnRenamed("id", "_id"))
    # Only texts that lose something somewhere are dealt out to their spans.
    texts = small(found.select("d1", "d2").distinct(), TOUCHED)
    whole = keyed.join(texts, ["d1", "d2"], "left_anti").withColumns({"found": F.struct(F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept_text")), "first_ids": none})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    joined = keyed.join(texts, ["d1", "d2"], "left_semi").join(found.withColumnsRenamed({"d1": "e1", "d2": "e2"}), same, "left")

    @F.pandas_udf("struct<n_removed: long, n_spans: long, kept_text: string>")
    def rest(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, spans, strict=True):
            runs = [] if s is None else _merged((x["a"], x["b"]) for x in s)
            kept = t if not runs else b"".join(_rest(t.encode("utf-8", "surrogatepass"), runs)).decode("utf-8", "ignore")
            out.append((sum(b - a for a, b in runs), len(runs), kept))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_text"])

    cut = joined.withColumns({"found": rest("text", "spans"), "first_ids": F.coalesce(F.array_sort("first_ids"), none)})
    every = cut.select("row", "text", "found", "first_ids").unionAll(whole.select("row", "text", "found", "first_ids"))
    new = {"n_bytes": F.octet_length("text").cast("long"), "n_removed": F.col("found.n_removed"), "n_spans": F.col("found.n_spans"), "first_ids": F.col("first_ids"), "kept_text": F.col("found.kept_text")}
    return every.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), *(c.alias(k) for k, c in new.items()))
