"""Queries against their SQL on tables with more neighbours of one node, or closer sums, than the test tables have."""

import math
import os

import duckdb
import pytest

from wicker.queries import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()


def compared(spark, folder, name, **views):
    """Rows of the query, and of its SQL on the same tables; other views may stand in for some of them."""
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        at, table = f"{folder}/{file}", file.removesuffix(".parquet")
        con.execute(f"create view {table} as {views.get(table, 'select * from {}').format('read_parquet(' + repr(at + '/*.parquet' if os.path.isdir(at) else at) + ')')}")
    found = QUERIES[name](spark, str(folder))
    asked = con.execute(ORACLES[name])
    place = [[x[0] for x in asked.description].index(c) for c in found.columns]
    return sorted(map(tuple, found.collect()), key=str), sorted((tuple(row[i] for i in place) for row in asked.fetchall()), key=str)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """12,000 customers of nation 3 and 5,000 of nation 4; both nations lie in region 1."""
    folder = tmp_path_factory.mktemp("crowded")
    for file in os.listdir(SF):
        if file not in ("customer.parquet", "nation.parquet"):
            os.symlink(f"{SF}/{file}", f"{folder}/{file}")
    spark.read.parquet(f"{SF}/nation.parquet").selectExpr("n_nationkey", "n_name", "cast(if(n_nationkey in (3, 4), 1, n_regionkey) as int) as n_regionkey").write.parquet(f"{folder}/nation.parquet")
    spark.range(17_000).selectExpr("id as c_custkey", "'C' || lpad(cast(id * 7919 % 17000 as string), 6, '0') as c_name", "cast(if(id < 12000, 3, 4) as int) as c_nationkey", "0.0D as c_acctbal", "'M' || id % 3 as c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    return folder


def test_command_impact_since_of_a_crowded_nation(spark, crowded):
    found, wanted = compared(spark, crowded, "command_impact_since")
    assert found == wanted and len(found) == 5_000


def test_impact_of_a_crowded_region(spark, crowded):
    found, wanted = compared(spark, crowded, "impact")
    assert found == wanted and len(found) == 10_000


def test_subgraph_nodes_of_a_crowded_nation(spark, crowded):
    found, wanted = compared(spark, crowded, "subgraph_nodes")
    assert found == wanted and len(found) > 12_000


def test_flags_at_equal_sums_and_halves(spark, tmp_path):
    arms = [([0.7, 0.1, 0.2], [0.5]), ([0.1] * 10, [0.5]), ([0.1, 0.2, 0.3], [0.6]), ([0.6], [0.3, 0.2, 0.1]), ([1.1, 2.2], [3.4]), ([2.0], [None])]
    rows = [(user, kind, x) for user, both in enumerate(arms) for kind, own in zip(("view", "click"), both, strict=True) for x in own]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found, wanted = compared(spark, tmp_path, "flagged_pairs", events="select * replace (cast(value as decimal(18, 2)) as value) from {}")
    assert [(*row[:2], *map(float, row[2:])) for row in wanted] == found and [row[1] for row in found] == ["strong win", "strong win", "even", "even", "regression"]


def test_flags_round_and_divide_as_their_sql(spark, tmp_path):
    arms = [([832.0], [304.46]), ([960.0], [244.26]), ([1472.0], [2350.14]), ([0.0], [1.5]), ([0.0, 0.0], [0.0]), ([0.0], [-1.5]), ([2e-7], [1e-7]), ([1e-300], [1e300]), ([math.inf], [1.0]), ([0.1, 0.2], [0.3]), ([0.7, 0.2], [0.45, None])]
    rows = [(user, kind, x) for user, both in enumerate(arms) for kind, own in zip(("view", "click"), both, strict=True) for x in own]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found, wanted = compared(spark, tmp_path, "flagged_pairs")
    assert list(map(repr, found)) == list(map(repr, wanted))
    assert [row[1] for row in found if row[0] in (9, 10)] == ["win", "win"]
    assert [row[3] for row in found if row[0] < 4] == [0.365938, 0.254437, 1.596563, math.inf]
