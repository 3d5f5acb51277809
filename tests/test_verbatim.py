"""Verbatim needles by an automaton against plain containment."""

import pytest

from codicil.operators import verbatim


def plain(needles, texts):
    return sorted((n, k) for n in set(needles) for k, t in texts if n and t and n in t)


@pytest.mark.parametrize("lot", [1, 200, verbatim.PASS_BYTES])
def test_needles_that_begin_alike_overlap_and_repeat(spark, monkeypatch, lot):
    monkeypatch.setattr(verbatim, "PASS_BYTES", lot)
    needles = [f"same{i}" for i in range(60 if lot == verbatim.PASS_BYTES else 12)] + ["a", "ab", "bab", "é𝒳", "", "absent"]
    texts = [(1, "same1 same11 same59"), (2, "babab"), (3, None), (4, ""), (5, "xé𝒳y"), (6, "same1" * 5000)]
    df = spark.createDataFrame([(n,) for n in needles], "needle string")
    found = verbatim.bearers(df, spark.createDataFrame(texts, "id long, body string"), "needle", "body", ["id"])
    assert sorted(map(tuple, found.select("needle", "id").collect())) == plain(needles, texts)


def test_a_thousand_needles_with_equal_beginnings_cost_one_scan(spark):
    needles = spark.createDataFrame([(f"prefix-{i:04d}", i) for i in range(1000)], "needle string, n long")
    texts = spark.createDataFrame([(i, " ".join(f"prefix-{(i * k) % 2000:04d}" for k in range(200))) for i in range(50)], "id long, body string")
    found = verbatim.bearers(needles, texts, "needle", "body", ["id"])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {(n, i) for i, t in map(tuple, texts.collect()) for n in range(1000) if f"prefix-{n:04d}" in t}
    assert {(r["n"], r["id"]) for r in found.collect()} == want


def test_no_needles(spark):
    none = spark.createDataFrame([], "needle string")
    assert verbatim.bearers(none, spark.createDataFrame([(1, "x")], "id long, body string"), "needle", "body", ["id"]).count() == 0


def test_phrases_are_checked_where_their_inner_words_meet(spark, tmp_path):
    """Texts are read once and pairs that share only inner words go nowhere (F3, F4)."""
    texts = [
        (1, "xone two three four fivex"), (2, "one  two three four five"), (3, "One\ttwo three four five"), (4, "one two three four fiv"), (5, None), (6, ""),
        (7, "zero one two three four five six\none two three four fix"), (8, "two three four"), (9, "a\xa0one two three four five"), (10, "é one two three four five."),
    ] + [(100 + i, f"w{i} two three four v{i}") for i in range(300)]
    spark.createDataFrame(texts, "id long, body string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    asks = [(1, "ONE two  three four five"), (2, "say: one two three four fi"), (3, "two three four"), (4, None), (5, "w7 two three four v7")]
    found = verbatim.phrase_pairs(spark.createDataFrame(asks, "query_id long, text string"), docs, 5, "id", "body")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1

    def held(ask, text):
        words = (ask or "").lower().split()
        return any(" ".join(words[i : i + 5]) in (text or "").lower() for i in range(len(words) - 4))

    assert sorted(map(tuple, found.collect())) == sorted((q, k) for q, a in asks for k, t in texts if held(a, t))


def test_more_phrases_than_can_be_broadcast(spark, monkeypatch):
    """Beyond the hashes' limit a table of marks keeps runs that no query has from being moved (F5, F6)."""
    docs = spark.range(400).selectExpr("id AS path", "concat_ws(' ', transform(sequence(0, 60), i -> concat('w', pmod(id * 61 + i, 9973)))) AS content")
    queries = spark.range(0, 400, 9).selectExpr("id AS query_id", "concat_ws(' ', transform(sequence(3, 20), i -> concat('w', pmod(id * 61 + i, 9973)))) AS text")
    pairs = lambda: sorted(map(tuple, verbatim.phrase_pairs(queries, docs, 6, "path", "content").collect()))
    want, kept, marked = pairs(), [], verbatim._marked
    monkeypatch.setattr(verbatim, "HASHES", 10)
    monkeypatch.setattr(verbatim, "_marked", lambda spans, wanted: kept.append((spans.count(), marked(spans, wanted).count())) or marked(spans, wanted))
    assert want and pairs() == want
    assert kept[0][1] < kept[0][0] / 4
