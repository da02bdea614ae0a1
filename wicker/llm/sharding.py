"""Contiguous shards of near equal size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.llm.common import running_totals


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents, in the order of their ids, into contiguous shards of near equal bytes.

    Each document counts its UTF-8 bytes plus one. Its start in the whole
    corpus is the total of all earlier pieces plus its start within its own
    piece; the shard is where the document's middle falls among equal cuts.
    So two shards differ by at most the two documents at their ends.

    Returns ``id_col, size, text_crc32, shard, slot``; slots count from 0 in
    each shard without gaps. Only these narrow rows are shuffled, never texts.

    Null text: size 1 and the checksum of no bytes. Null ids come first. Equal
    ids are ordered by size and checksum, so repeated rows each get a slot of
    their own. An empty table gives no rows. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit(1).cast("long").alias("_one"))
    placed = running_totals(rows, id_col, ["size", "text_crc32"], {"size": "_byte", "_one": "_row"})
    whole = placed.agg(F.max(F.col("_byte") + F.col("size")).alias("_whole"))
    middle = 2 * F.col("_byte") + F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("_whole")))).cast("int")
    cut = placed.crossJoin(F.broadcast(whole)).withColumn("shard", shard)  # one row on the right
    firsts = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
