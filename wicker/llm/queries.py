"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm import ann, bpe, chunks, mixing, oracles, perplexity, preference, quality, repeats, sharding, simhash
from wicker.llm.common import read


def tokenizer_path() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and component."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vector whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    out = ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
    return out.select(F.col("query_id").cast("long"), "rank", F.col("id").cast("long").alias("vec_id"), "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near equal bytes."""
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    out = mixing.plan(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against one with another's last reply, as prompt and masked completions."""
    out = preference.format_pairs(preference.mismatched_pairs(read(spark, sf_dir, "conversations")))
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["from"], x["to"])), ",").alias(c)
    return out.select(F.col("pair_id").alias("conv_id"), F.col("n_prompt_turns").cast("long"), "prompt", "chosen", "rejected", mask("chosen_mask"), mask("rejected_mask"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's perplexity under its language's model of trusted text, and the verdict."""
    out = perplexity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated strings of 400 bytes, and how much of it shorter repeated passages cover."""
    out = repeats.remove(read(spark, sf_dir, "documents"), passage=repeats.PASSAGE)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes", "n_passages")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    out = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept")


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to chunks that an earlier one has, and where those are."""
    out = chunks.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "first_ids", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_ann": op2_ann,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_preference": op5_preference,
    "op6_perplexity": op6_perplexity,
    "op7_suffix_array": op7_suffix_array,
    "op8_quality_rules": op8_quality_rules,
    "op9_chunks": op9_chunks,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = oracles.ORACLES
