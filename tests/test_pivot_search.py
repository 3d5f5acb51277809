"""Pivot search against the comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.operators import pivot_search, retrieval

SF = "/root/testdata/sf0.001"


def clustered(n, clusters, size=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size)) * 4
    return [(i, (centres[i % clusters] + rng.normal(size=size) * 0.3).tolist()) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("limit", "pivots", "block"), [(1, 1, 2048), (5, 16, 50), (10, 64, 7)])
def test_same_results_as_all_pairs(spark, monkeypatch, limit, pivots, block):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    monkeypatch.setattr(pivot_search, "GROUP", 5)
    stored = clustered(400, 8) + [(1000, [0.0] * 16), (1001, None), (1002, [1.0] + [0.0] * 15), (1003, [2.0] + [0.0] * 15)]
    vectors = spark.createDataFrame(stored, "id long, vector array<float>")
    asked = [(i, v) for i, v in clustered(40, 10, seed=2)] + [(100, [0.0] * 16), (101, [1.0] + [0.0] * 15), (102, [-1.0] + [0.0] * 15)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    index = pivot_search.build_pivots(vectors, pivots=pivots)
    assert rows(pivot_search.pivot_top_k(queries, index, limit)) == rows(retrieval.vector_top_k(queries, vectors, limit))


def test_fewer_than_a_third_of_the_pairs_are_compared(spark):
    vectors = spark.createDataFrame(clustered(6000, 40), "id long, vector array<float>")
    queries = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    index = pivot_search.build_pivots(vectors)
    found = pivot_search.compared_pairs(queries, index, 10).first()
    assert found["pairs"] == 6000 * 120 and found["compared"] * 3 < found["pairs"]


def test_least_score_and_empty_tables(spark):
    vectors = spark.createDataFrame(clustered(60, 3), "id long, vector array<float>")
    queries = vectors.where("id < 5").select(F.col("id").alias("query_id"), "vector")
    index = pivot_search.build_pivots(vectors)
    assert rows(pivot_search.pivot_top_k(queries, index, 30, 0.9)) == rows(retrieval.vector_top_k(queries, vectors, 30, min_score=0.9))
    assert pivot_search.pivot_top_k(queries.limit(0), index).count() == 0
    none = pivot_search.build_pivots(vectors.limit(0))
    assert pivot_search.pivot_top_k(queries, none).count() == 0
