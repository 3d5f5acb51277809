import itertools
import math
from collections import Counter

import numpy as np
import pytest

from codicil.llm import embedding_index, max_score
from tests.llm.conftest import SF
from tests.llm.helpers import cosine, grouped

ODD = [
    (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]),
    (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, []), (10, [0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (11, [0.0, 1.0]),
]


@pytest.fixture(scope="session")
def odd_vectors(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "node", "cell", "unit", "rank", "score")})


def clustered(seed, groups, each, width=16, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for center in rng.normal(size=(groups, width)):
        rows += [(center + noise * rng.normal(size=width) * rng.choice([0.5, 1, 3, 6])).astype(float) for _ in range(each)]
    return [(i, [float(v) for v in row]) for i, row in enumerate(rows)]


def check_links(frame, rows, least_recall):
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if cosine(x, y) >= 0.95]
    degree = Counter(itertools.chain(*links))
    got = embedding_index.near_duplicate_vectors(frame).collect()
    assert len(got) == len(rows)
    assert all(r["n_links"] <= degree[r["id"]] for r in got)
    found = sum(r["n_links"] for r in got)
    assert found >= least_recall * 2 * len(links)
    if found == 2 * len(links):
        assert {r["id"]: r["component_id"] for r in got} == grouped([i for i, _ in rows], links)
    return got


def test_links_against_brute_force(spark):
    rows = clustered(1, 30, 25)
    check_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows, 0.95)


def test_a_crowded_cell_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_index, "BLOCK", 16)
    rows = clustered(2, 2, 150, noise=0.02)
    check_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows, 0.95)


def test_driver_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    units = np.array([v for _, v in rows])
    units = units / np.linalg.norm(units, axis=1, keepdims=True)
    near = [(a, b) for a, b in zip(*np.nonzero(units @ units.T >= 0.95), strict=True) if a < b]
    got = embedding_index.near_duplicate_vectors(frame).collect()
    assert sum(r["n_links"] for r in got) == 2 * len(near)


def test_odd_vectors(odd_vectors):
    got = embedding_index.near_duplicate_vectors(odd_vectors).collect()
    by_id = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(ODD)
    assert by_id[1] == (2, 1, True) and by_id[2] == by_id[3] == (2, 1, False)
    assert all(by_id[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9))
    assert by_id[10] == (2, 10, True) and by_id[11] == (2, 10, False) and by_id[None][0] == 0
    assert embedding_index.near_duplicate_vectors(odd_vectors.where("false")).count() == 0
    assert embedding_index.near_duplicate_vectors(odd_vectors.where("vec_id = 5")).collect()[0]["n_links"] == 0


def brute_top(rows, queries, k):
    weights = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(weights[q], weights[i], strict=True)), i) for i in weights if i != q)
        yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1))


@pytest.mark.parametrize("shard_rows,query_rows", [(2048, 1024), (40, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard_rows, query_rows):
    monkeypatch.setattr(max_score, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(max_score, "QUERY_ROWS", query_rows)
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    queries = [i for i, _ in rows if i % 25 == 0]
    got = max_score.top_k(frame, frame.where("vec_id % 25 = 0"), 10).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(rows, queries, 10))


def test_top_k_ties_few_rows_and_large_values(spark):
    rows = [(i, [1.0, float(i % 2), -1.0]) for i in range(30)] + [(100, [3e9, -3e9, 1.0]), (101, [3e9, 3e9, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = max_score.top_k(frame, frame.where("vec_id in (0, 7, 100)"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(rows, [0, 7, 100], 4))
    few = frame.where("vec_id < 3")
    assert max_score.top_k(few, few, 10).count() == 6


def test_top_k_odd_vectors(odd_vectors):
    got = max_score.top_k(odd_vectors, odd_vectors.where("vec_id in (1, 4, 6)"), 3).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 2, 2 * 1024 * 1024), (1, 2, 3, 1024 * 1024), (1, 3, 5, 0)]
    assert max_score.top_k(odd_vectors.where("false"), odd_vectors, 3).count() == 0
