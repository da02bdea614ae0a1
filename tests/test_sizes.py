"""Queries as a cluster and larger tables need them."""

import math
import os
import time

import pytest
from pyspark.sql import functions as F

from wicker import schema
from wicker.operators import evaluation, traverse
from wicker.plans.commands import Index
from wicker.queries import evaluation_queries, source_queries
from wicker.session import checkpoint_folder
from wicker.sources import files

SF = "/root/testdata/sf0.001"


def test_walked_files_lie_in_the_shared_folder(spark, monkeypatch):
    seen, walk = [], files.walk
    monkeypatch.setattr(files, "walk", lambda spark, root: seen.append(root) or walk(spark, root))
    assert source_queries.walked_files(spark, SF).count() > 0
    assert os.path.dirname(seen[0]) == files.mounted(checkpoint_folder(spark))


def test_mounted():
    assert files.mounted("file:///a/b:c") == files.mounted("file:/a/b:c") == files.mounted("/a/b:c") == "/a/b:c"
    with pytest.raises(RuntimeError):
        files.mounted("hdfs://host/a")


def test_sign_test_of_many_pairs():
    n, tail = 20_000, 0
    term = 1
    for k in range(n, 10_039, -1):
        tail, term = tail + term, term * k // (n - k + 1)
    exact = tail * 10**15 // 2**n / 10**15
    started = time.monotonic()
    assert abs(evaluation.sign_test(10_040, 9_960) - exact) < 1e-12 and abs(evaluation.sign_test(9_960, 10_040) - (1 - exact)) < 0.01
    assert evaluation.sign_test(0, n) == 1.0 and 0 <= evaluation.sign_test(n, 0) < 1e-300
    assert abs(evaluation.sign_test(5 * 10**7, 5 * 10**7) - 0.5) < 1e-4
    assert time.monotonic() - started < 10


def arms(spark, folder, values):
    """Events of one user each; a list for either arm."""
    rows = [(user, kind, x) for user, both in enumerate(values) for kind, own in zip(("view", "click"), both, strict=True) for x in own]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").repartition(3).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_equal_arms_tie_in_whatever_order_they_are_added(spark, tmp_path):
    d = arms(spark, tmp_path, [([0.1, 0.2, 0.3], [0.6]), ([0.7, 0.1, 0.2], [1.0]), ([0.1] * 10, [0.5]), ([1.0], [2.0]), ([None], [2.0])])
    assert tuple(evaluation_queries.arm_outcomes(spark, d).first()) == (1, 1, 2)


def test_flags_of_equal_arms(spark, tmp_path):
    d = arms(spark, tmp_path, [([0.1, 0.2, 0.3], [0.6]), ([0.7, 0.1, 0.2], [1.0]), ([0.1] * 10, [0.5])])
    assert {r["task"]: (r["flag"], r["delta"]) for r in evaluation_queries.flagged_pairs(spark, d).collect()} == {0: ("even", 0.0), 1: ("even", 0.0), 2: ("strong win", -0.5)}


def test_sums_of_any_doubles(spark):
    total = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(evaluation.exact_sum("x").alias("s")).first()["s"]
    assert total(1e300, 1.0) == 1e300 and total(1e-300, None) == 1e-300 and total(None) is None and total() is None
    assert math.isnan(total(float("nan"), 1.0)) and total(float("inf"), 1.0) == math.inf and total(9e25, 9e25) == 1.8e26
    assert total(0.1, 0.2, None) == 0.3


def hub(spark, n=10_050):
    """A node on which n others depend, and one more on the last of them."""
    ids = spark.range(n + 2)
    name = F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0"))
    nodes = ids.select("id", F.lit("p").alias("project"), F.lit("Function").alias("label"), name.alias("name"), name.alias("qualified_name"), F.lit("f.rs").alias("file_path"), (F.col("id") * 10 + 1).alias("start_line"), (F.col("id") * 10 + 9).alias("end_line"), F.lit("{}").alias("properties"))
    target = F.when(F.col("id") == n + 1, n).otherwise(0).cast("long")
    edges = ids.filter("id > 0").select("id", F.lit("p").alias("project"), F.col("id").alias("source_id"), target.alias("target_id"), F.lit("IMPORTS").alias("edge_type"), F.lit("{}").alias("properties"))
    return nodes, edges


def test_impact_follows_all_edges_of_a_node(spark):
    nodes, edges = hub(spark)
    assert traverse.impact(nodes, edges, 0, 2, 20_000).groupBy("hops").count().orderBy("hops").collect() == [(1, 10_050), (2, 1)]


def test_impact_commands_follow_all_edges_of_a_node(spark):
    nodes, edges = hub(spark, 4_200)
    index = Index(nodes, edges)
    hunks = spark.createDataFrame([("f.rs", 5)], "file_path string, line long")
    assert index.impact("n000000", 2).count() == index.impact_since(hunks, 2).count() == 4_201 < schema.MAX_ROWS


def test_subgraph_has_all_edges_of_a_node(spark):
    seen, inner = traverse.subgraph(hub(spark)[1], 0, ["IMPORTS"], 2)
    assert seen.count() == 10_052 and inner.count() == 10_051
