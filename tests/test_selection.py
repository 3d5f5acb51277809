"""Exact quantiles against sorting."""

import random

import numpy as np
import pytest

from codicil.operators import selection


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("bins", [2, 1024])
def test_equal_to_sorting(spark, share, bins):
    draw = random.Random(bins)
    groups = {"one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, None: [draw.random() for _ in range(31)]}
    groups["far"] = [draw.choice([-1e300, 1e300, 1e-300, 0.0, draw.gauss(0, 1)]) for _ in range(200)]
    groups["close"] = [1.0 + i * 2**-52 for i in range(40)]
    rows = [(g, v) for g, own in groups.items() for v in own] + [("one", None), ("none", None), ("two", float("nan"))]
    found = {r[0]: r[1] for r in selection.exact_quantile(spark.createDataFrame(rows, "g string, v double"), "g", "v", share, bins).collect()}
    assert set(found) == set(groups)
    for g, own in groups.items():
        assert found[g] == pytest.approx(np.quantile(own, share), rel=1e-12), g


def test_two_groups_that_hold_all_rows(spark):
    df = spark.range(200_000).selectExpr("id % 2 as g", "sin(id) as v")
    found = {r[0]: r[1] for r in selection.exact_quantile(df, "g", "v").collect()}
    for g in (0, 1):
        own = np.sin(np.arange(g, 200_000, 2))
        assert found[g] == pytest.approx(np.median(own), abs=1e-12)


def test_ranked_search_moves_only_its_best_rows(spark, monkeypatch):
    """Documents are ranked in their tasks (F11), in the order of the joined form; rows of one key are one document."""
    from codicil.operators import retrieval

    docs = spark.createDataFrame([(i % 300 if i % 300 else None, f"brass nickel w{i % 7}" if i < 300 else "polished", f"coper {i % 11}") for i in range(310)], "id long, title string, content string")
    asked = spark.createDataFrame([(1, "bras polished copper"), (2, "w3 nickle"), (3, ""), (4, "absent")], "query_id long, text string")

    def found():
        return sorted(map(str, retrieval.ranked_search(asked, docs, 5, "id", ("title", "content")).collect()))

    moved, top = [], retrieval.top_per_query
    monkeypatch.setattr(retrieval, "top_per_query", lambda rows, *a: moved.append(rows.count()) or top(rows, *a))
    in_tasks = found()
    assert moved[0] < 100
    monkeypatch.setattr(retrieval, "is_small", lambda rows: False)
    assert in_tasks == found() and moved[1] > 300
