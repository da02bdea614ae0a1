"""Comparison of two arms, out of the documents' labels and the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import evaluation
from wicker.queries.registry import query
from wicker.sources import adapters as A

P = "with pairs as (select user_id as task, sum(value) filter (event_type = 'view') as b, sum(value) filter (event_type = 'click') as c from events group by 1) "


def pairs(spark, d):
    e = A.read(spark, d, "events").groupBy(F.col("user_id").alias("task"), "event_type").agg(evaluation.settled_sum("value").alias("value"))
    return evaluation.paired(e, "task", "event_type", "value", "view", "click")


@query(P + "select task, round(b, 6) as b, round(c, 6) as c from pairs")
def paired_arms(spark, d):
    return pairs(spark, d).select("task", F.round("b", 6).alias("b"), F.round("c", 6).alias("c"))


@query(P + "select count(*) filter (c > b) as wins, count(*) filter (c < b) as losses, count(*) filter (c = b) as ties from pairs")
def arm_outcomes(spark, d):
    return evaluation.outcomes(pairs(spark, d))


@query(P + ", counts as (select count(*) filter (c > b) as wins, count(*) filter (c <> b) as n from pairs where b is not null and c is not null) select round(case when max(n) = 0 then 1.0 else sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) end, 9) as p from (select n, unnest(range(wins, n + 1)) as k from counts)")
def arm_sign_test(spark, d):
    row = evaluation.outcomes(pairs(spark, d)).first()  # two counts
    return spark.createDataFrame([(round(evaluation.sign_test(row["wins"], row["losses"]), 9),)], "p double")


@query(P + "select count(*) as pairs, round(sum(c) / sum(b), 6) as ratio from pairs where b is not null and c is not null")
def ratio_of_totals(spark, d):
    return evaluation.ratio_of_totals(pairs(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(P + "select round(median(b / c), 6) as median, round(min(b / c), 6) as least, round(max(b / c), 6) as largest from pairs where c <> 0")
def median_factor(spark, d):
    return evaluation.median_factor(pairs(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("median", "least", "largest")))


@query(P + "select round(median(f), 6) as median, round(avg(f), 6) as mean, round(quantile_disc(f, 0.9), 6) as p90, round(quantile_disc(f, 0.95), 6) as p95, count(*) filter (f >= 10) as tenfold from (select b / c as f from pairs where c <> 0 and b is not null)")
def factor_distribution(spark, d):
    out = evaluation.factor_distribution(pairs(spark, d))
    return out.select(*(F.round(c, 6).alias(c) for c in ("median", "mean", "p90", "p95")), "tenfold")


@query("select round(avg(case when l.quality > l.toxic or (l.quality = l.toxic and d.n_chars <= 1.1 * (1000 + d.doc_id)) then 1.0 else 0.0 end), 6) as win_rate from labels l join documents d using (doc_id)")
def win_rate(spark, d):
    rows = A.read(spark, d, "labels").join(A.read(spark, d, "documents"), "doc_id").select(F.col("quality").alias("qc"), F.col("toxic").alias("qb"), F.col("n_chars").alias("cc"), (1000 + F.col("doc_id")).alias("cb"))
    return evaluation.win_rate(rows).withColumn("win_rate", F.round("win_rate", 6))


_TEXT = "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')"


@query(f"select item_id, cast(contains({_TEXT}, 'the') as int) + cast(contains({_TEXT}, 'tion') as int) as found, cast(contains({_TEXT}, 'ough') as int) as wrong, instr({_TEXT}, 'th') > 0 and instr({_TEXT}, 'er') > instr({_TEXT}, 'th') as in_order from benchmark")
def graded_answers(spark, d):
    rows = A.read(spark, d, "benchmark").withColumnRenamed("text", "answer")
    return evaluation.graded(rows, ["The", "tion"], ["ough"], ["th", "er"], 1).select("item_id", "found", "wrong", "in_order")


@query(P + "select task, case when c * 2 <= b then 'strong win' when c < b then 'win' when c > b then 'regression' else 'even' end as flag, round(c - b, 6) as delta, round(c / b, 6) as ratio from pairs where b is not null and c is not null")
def flagged_pairs(spark, d):
    out = evaluation.compared(evaluation.flagged(pairs(spark, d)))
    out = out.withColumn("ratio", F.coalesce("ratio", evaluation.over_nothing("c")))  # its SQL has no null there
    return out.select("task", "flag", *(evaluation.rounded(c, 6).alias(c) for c in ("delta", "ratio")))


@query("select d.source as category, count(*) as expected, count(l.doc_id) as found, count(*) - count(l.doc_id) as missed from documents d left join (select distinct doc_id from labels) l using (doc_id) group by 1")
def recall_audit(spark, d):
    expected = A.read(spark, d, "documents").select(F.col("doc_id").alias("task"), F.lit("m").alias("member"), F.col("source").alias("category"))
    found = A.read(spark, d, "labels").select(F.col("doc_id").alias("task"), F.lit("m").alias("member"))
    return evaluation.recall_audit(expected, found, "category")


@query("select event_type, min(value) as least, median(value) as median, max(value) as largest, round(sum(value + 0.1 * event_id + 5 * user_id), 4) as cost from events group by 1")
def timing_series(spark, d):
    e = A.read(spark, d, "events")
    cost = e.groupBy("event_type").agg(F.round(F.sum(evaluation.weighted_cost(F.col("value"), F.col("event_id"), F.col("user_id"))), 4).alias("cost"))
    return evaluation.series(e, "event_type", "value").join(cost, "event_type")
