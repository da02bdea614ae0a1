"""Comparison of two arms over the same tasks, and grading of answers."""

from __future__ import annotations

from math import comb, exp, log, log1p, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.text import canonical

COST_TOLERANCE = 1.10
#: Pairs up to which the sign test is in whole numbers.
EXACT = 1000


def paired(rows: DataFrame, task: str, arm: str, value: str, base: str, candidate: str) -> DataFrame:
    """``task, b, c``: the two arms of a task side by side; null where one is missing."""
    pick = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    return rows.groupBy(task).agg(pick(base).alias("b"), pick(candidate).alias("c"))


def exact_sum(value: str) -> Column:
    """The sum of numbers as they are written in decimals, the same in whatever order they come; a double.

    As soon as one has more than 12 places or 26 digits before the point, or is
    no number, doubles are added.
    """
    x = F.col(value).cast("double")
    decimal = x.try_cast("decimal(38,12)")
    return F.coalesce(F.when(F.bool_and(F.coalesce(decimal.cast("double") == x, F.lit(False)) | x.isNull()), F.try_sum(decimal)).cast("double"), F.sum(x))


def settled_sum(value: str) -> Column:
    """The sum of doubles where it is the same in whatever order they come, that is up to two of them; beyond, the exact one."""
    return F.when(F.count(value) <= 2, F.sum(F.col(value).cast("double"))).otherwise(exact_sum(value))


def rounded(value: str, places: int) -> Column:
    """A double to so many places as DuckDB does it: the double times the power of ten, its halves away from zero.

    Spark's own takes the halves of the number as it is written in decimals,
    which can be one in the last place off for the same double.
    """
    x, unit = F.col(value), F.lit(float(10**places))
    size = F.abs(x) * unit
    return F.when(size < float("inf"), F.signum(x) * F.round(size) / unit).otherwise(x)


def over_nothing(value: str) -> Column:
    """What doubles give for a number over zero: an infinity by its sign, no number for none."""
    x = F.col(value).cast("double")
    return F.when(F.isnan(x) | (x == 0.0), float("nan")).otherwise(F.signum(x) * float("inf"))


def outcomes(pairs: DataFrame) -> DataFrame:
    """Wins, losses and ties of complete pairs; larger is better."""
    return pairs.agg(*(F.count_if(x).alias(n) for n, x in (("wins", F.col("c") > F.col("b")), ("losses", F.col("c") < F.col("b")), ("ties", F.col("c") == F.col("b")))))


def _stirling(n: int) -> float:
    """The logarithm of n! over its approximation by Stirling, for large n."""
    return 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)


def _chance(n: int, k: int) -> float:
    """How likely exactly k of n are, for n over EXACT and k from n / 2 on; by differences from n / 2, which do not cancel out."""
    if n - k <= 15:  # the series does not hold there
        return exp(log(comb(n, k)) - n * log(2))
    d = (2 * k - n) / n
    off = n / 2 * ((1 + d) * log1p(d) + (1 - d) * log1p(-d))
    return sqrt(n / (2 * pi * k * (n - k))) * exp(_stirling(n) - _stirling(k) - _stirling(n - k) - off)


def _tail(n: int, k: int) -> float:
    """How likely k or more of n are, for k over n / 2: from there on terms only fall, and those that add nothing are left out."""
    term, total = _chance(n, k) if k <= n else 0.0, 0.0
    while k <= n and total + term > total:
        total, term, k = total + term, term * (n - k) / (k + 1), k + 1
    return total


def sign_test(wins: int, losses: int) -> float:
    """One-sided: how likely at least so many wins are if either is as likely.

    Exact up to EXACT pairs; beyond that as doubles, in a number of steps that
    grows with the root of the pairs.
    """
    n = wins + losses
    if n <= EXACT:
        return sum(comb(n, k) for k in range(wins, n + 1)) / 2**n if n else 1.0
    return _tail(n, wins) if 2 * wins > n else 1.0 - _tail(n, losses + 1)


def ratio_of_totals(pairs: DataFrame) -> DataFrame:
    """The candidate's total over the base's, over complete pairs; null for a base of nothing."""
    whole = pairs.filter("b is not null and c is not null")
    return whole.agg(F.count("*").alias("pairs"), F.try_divide(F.sum("c"), F.sum("b")).cast("double").alias("ratio"))


def median_factor(pairs: DataFrame) -> DataFrame:
    """Median, least and largest of base over candidate per task."""
    factor = pairs.withColumn("f", F.try_divide(F.col("b").cast("double"), F.col("c").cast("double")))
    return factor.agg(F.median("f").alias("median"), F.min("f").alias("least"), F.max("f").alias("largest"))


def factor_distribution(pairs: DataFrame) -> DataFrame:
    """Median, mean, the 90th and 95th of a hundred by nearest rank, and how many are ten or more."""
    factor = pairs.withColumn("f", F.try_divide(F.col("b").cast("double"), F.col("c").cast("double"))).filter("f is not null")
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by f)")
    return factor.agg(F.median("f").alias("median"), F.avg("f").alias("mean"), at(0.9).alias("p90"), at(0.95).alias("p95"), F.count_if(F.col("f") >= 10).alias("tenfold"))


def win_rate(rows: DataFrame) -> DataFrame:
    """Over pairs with quality and cost (qb, qc, cb, cc): better, or as good at no more than a tenth above the cost."""
    win = (F.col("qc") > F.col("qb")) | ((F.col("qc") == F.col("qb")) & (F.col("cc") <= COST_TOLERANCE * F.col("cb")))
    return rows.agg(F.avg(F.when(win, 1.0).otherwise(0.0)).alias("win_rate"))


def graded(answers: DataFrame, required: list[str], forbidden: list[str], ordered: list[str], least: int) -> DataFrame:
    """Add ``found, wrong, in_order, passed`` by the canonical text of ``answer``."""
    text = canonical(F.coalesce(F.col("answer"), F.lit("")))
    plain = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    has = lambda s: F.contains(text, F.lit(plain(s)))
    count = lambda xs: sum((has(x).cast("int") for x in xs), F.lit(0))
    places = [F.instr(text, plain(x)) for x in ordered]
    path = F.lit(True)
    for a, b in zip(places, places[1:], strict=False):
        path = path & (a > 0) & (b > a)
    out = answers.withColumns({"found": count(required), "wrong": count(forbidden), "in_order": path})
    return out.withColumn("passed", (F.col("found") >= least) & (F.col("wrong") == 0) & F.col("in_order"))


def weighted_cost(fresh: Column, cached: Column, output: Column, weights: tuple[float, float, float] = (1.0, 0.1, 5.0)) -> Column:
    return fresh * weights[0] + cached * weights[1] + output * weights[2]


def flagged(pairs: DataFrame, strong: float = 2.0) -> DataFrame:
    """``flag`` per pair of costs (b, c): strong win, win, regression or even."""
    flag = F.when(F.col("c") * strong <= F.col("b"), "strong win").when(F.col("c") < F.col("b"), "win").when(F.col("c") > F.col("b"), "regression").otherwise("even")
    return pairs.filter("b is not null and c is not null").withColumn("flag", flag)


def compared(pairs: DataFrame) -> DataFrame:
    """``delta, ratio`` per pair; no ratio over nothing."""
    return pairs.withColumns({"delta": F.col("c") - F.col("b"), "ratio": F.try_divide(F.col("c").cast("double"), F.nullif(F.col("b").cast("double"), F.lit(0.0)))})


def recall_audit(expected: DataFrame, found: DataFrame, category: str) -> DataFrame:
    """Per category how many expected (task, member) were found and how many not."""
    hits = expected.join(found.select("task", "member").distinct().withColumn("hit", F.lit(1)), ["task", "member"], "left")
    return hits.groupBy(category).agg(F.count("*").alias("expected"), F.count("hit").alias("found"), (F.count("*") - F.count("hit")).alias("missed"))


def series(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("largest"))
