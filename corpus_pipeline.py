"""From documents to tokens: five stages, each written and read again before the next."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from wicker.llm import bpe, mixing, quality, repeats, simhash
from wicker.llm.common import made, read
from wicker.llm.queries import tokenizer_path
from wicker.session import checkpoint_folder, dropped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs of their language; all others go."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8."""
    return simhash.deduplicated(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that occur elsewhere too, from the length of a passage of 50 words on."""
    return repeats.cleaned(docs, length=repeats.PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each source, as often as it takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, lossless``: the tokens of each text, and whether they decode to it."""
    return bpe.encode_checked(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: The mix and the near copies cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between them the rows go through Parquet in the shared folder, each file until the next is there."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage: tuple[int, tuple]) -> DataFrame:
        n, (_, function) = stage
        before = len(made(spark))
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        for path in [*made(spark)[before:], *([f"{folder}/{n - 1}"] if n else [])]:  # the result is there: what led to it may go
            dropped(spark, path)
        return spark.read.parquet(f"{folder}/{n}")

    return functools.reduce(step, enumerate(STAGES), read(spark, sf_dir, "documents"))
