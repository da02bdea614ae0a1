"""Quality rules whose cutoffs carry a guarantee on wrongly rejected documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.llm.common import materialize, small, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Reject where ``score`` is at least a cutoff; ``cutoffs`` go from lenient to strict."""

    name: str
    score: str
    cutoffs: tuple[float, ...]


#: The grids are fixed before any label is seen; that is what makes testing them in sequence valid.
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0)),
)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of BASE and ``n_lines`` (lines with a word) to the rows of docs.

    ``n_repeat_words`` counts the words in any three-word window that occurs
    twice or more in the same text, the first occurrence included. Windows are
    compared by a 64-bit hash of their words. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_words", words(F.col(text_col)))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    n = F.size("_words")
    out = out.withColumn("_windows", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)))
    out = out.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows")).alias("_windows"),
    )
    out = out.withColumn("_sorted", F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    near = lambda j: F.get("_sorted", j)["h"]
    found = F.filter("_sorted", lambda x, j: x["h"].eqNullSafe(near(j - 1)) | x["h"].eqNullSafe(near(j + 1)))
    out = out.withColumn("_found", F.array_sort(F.transform(found, lambda x: x["i"])))
    reach = F.transform("_found", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_found", j + 1) - x, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_windows", "_sorted", "_found")


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ln_gamma(x: Column) -> Column:
    """Stirling's series after eight steps up; good to about 1e-13 for x of 1 or more."""
    y = x + 8
    steps = F.log(x)
    for i in range(1, 8):
        steps = steps + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable of n trials, where k is below n * p; else 1.

    Below the mean the terms fall as they go down from k, at the pace of a
    Gaussian at least, so 12 standard deviations below hold every digit of a
    double: the length of the sum grows with the root of n only.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    deep = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p)) + 50)).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(acc: Column, j: Column) -> Column:
        i = k - j + 1  # from the term of i to the term of i - 1
        term = acc["term"] * i / (n - i + 1) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.when(deep >= 1, F.sequence(F.lit(1).cast("long"), deep)).otherwise(F.array().cast("array<long>")), start, down, lambda a: a["total"])
    return F.when(n * p > k, F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def choose_cutoffs(scored: DataFrame, stratum: str, good: Column, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per stratum and rule: the strictest cutoff that the labels vouch for, or null.

    ``good`` marks holdout rows that must not be rejected. For each cutoff the
    hypothesis "this cutoff rejects more than risk / len(rules) of the good
    documents" is tested by the exact binomial tail at level
    ``error / (strata * rules)`` (Bonferroni); within a rule the cutoffs are
    tested from lenient to strict and the first failure ends the sequence, which
    needs no further correction. So with probability 1 - error no stratum loses
    more than ``risk`` of its good documents. All labelled rows count; what
    leaves the aggregation is one row per stratum.
    """
    counts = [F.count_if(F.expr(r.score) >= c).alias(f"k_{r.name}_{i}") for r in rules for i, c in enumerate(r.cutoffs)]
    held = scored.filter(good).groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *counts)
    tests = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"k_{r.name}_{i}").alias("k")) for r in rules for i, c in enumerate(r.cutoffs)))
    rows = held.select("stratum", "n", F.inline(tests))
    strata = held.agg(F.count("*").alias("strata"))
    tail = binomial_tail(F.col("k"), F.col("n"), risk / len(rules))
    tested = rows.crossJoin(F.broadcast(strata)).withColumn("passed", tail <= error / (F.col("strata") * len(rules)))  # one row on the right
    upto = Window.partitionBy("stratum", "rule").orderBy("step")
    clean = tested.withColumn("clean", F.min(F.col("passed").cast("int")).over(upto) == 1)
    return clean.groupBy("stratum", "rule").agg(F.max("n").alias("n"), F.min(F.when(F.col("clean"), F.col("cutoff"))).alias("cutoff"))


def _wide(cutoffs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row per stratum with its cutoffs side by side, to be joined on ``_stratum``."""
    return small(cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*(F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_cut_{r.name}") for r in rules)))


def _failed(rules: tuple[Rule, ...]) -> Column:
    return F.filter(F.array(*(F.when(F.expr(r.score) >= F.col(f"_cut_{r.name}"), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())


def _marks(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").alias("_quality"))


def judge(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Features and verdicts of every document, from cutoffs that its language's labels vouch for.

    Returns ``id_col, stratum, BASE, n_lines, base_failed, failed_rules, kept``
    (``failed_rules`` the names in the order of ``rules``). A stratum without
    enough labels keeps what the base rules keep. Labels with quality 1 are the
    good ones; repeated labels of an id count once, and once bad is bad. Null
    language is a stratum of its own (""); null ids get a verdict but no label.
    Repeated rows are judged one by one; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("_text"))
    facts = materialize(features(own, "_text").drop("_text").withColumn("base_failed", base_failed()))
    holdout = facts.join(_marks(labels), F.col("_id") == F.col("_labelled")).filter(~F.col("base_failed"))
    cutoffs = choose_cutoffs(holdout, "stratum", F.col("_quality") == 1, rules, risk, error)
    judged = facts.join(_wide(cutoffs, rules), F.col("stratum") == F.col("_stratum"), "left").withColumn("failed_rules", _failed(rules))
    return judged.select(F.col("_id").alias(id_col), "stratum", *BASE, "n_lines", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that ``judge`` keeps, in the columns of docs.

    The cutoffs come from one pass over the texts, of which only counts remain;
    the verdicts from a second one, so no text is ever dealt out to its verdict.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("_text"))
    labelled = own.join(small(_marks(labels), 2_000_000), F.col("_id") == F.col("_labelled"))
    holdout = materialize(features(labelled, "_text").drop("_text")).filter(~base_failed())
    cutoffs = choose_cutoffs(holdout, "stratum", F.col("_quality") == 1, rules, risk, error)
    rows = features(docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("_text")), "_text")
    # A column that depends on the partition keeps the counts where they are: the
    # optimizer would else write them out again in every condition below.
    rows = rows.withColumn("_here", F.monotonically_increasing_id())
    judged = rows.join(_wide(cutoffs, rules), F.col("stratum") == F.col("_stratum"), "left")
    return judged.filter((F.col("_here") >= 0) & ~base_failed() & (F.size(_failed(rules)) == 0)).select("_row.*")
