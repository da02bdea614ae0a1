"""Queries that take all nodes."""

from wicker.queries import text_queries
from wicker.sources import adapters


def test_every_node_has_a_signature(spark):
    d = "/root/testdata/sf0.001"
    ids = {r["id"] for r in adapters.nodes(spark, d).select("id").collect()}
    assert {r["id"] for r in text_queries.minhash_signatures(spark, d).collect()} == ids
