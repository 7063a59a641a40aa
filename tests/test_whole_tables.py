"""Queries do their whole tables."""

from tidemark.plans import adapters, content_queries

SF = "/root/testdata/sf0.001"


def test_each_vector_gets_its_neighbours(spark):
    ids = {r.vec_id for r in adapters.table(spark, SF, "embeddings").select("vec_id").collect()}
    found = content_queries.dense_neighbours(spark, SF).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in found} == dict.fromkeys(ids, min(10, len(ids) - 1))
