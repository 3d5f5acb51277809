"""Sources meet the sentences of their answer as one list: no row for a number or for a sentence that is not asked about."""

import random

from pyspark.sql import functions as F

from codicil.operators import audit, retrieval


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _case(spark):
    rng = random.Random(5)
    word = lambda: str(rng.choice([7, 12, 120, 34, 2024]))
    contexts = [(a, i, f"/d/{rng.randrange(4)}.md", "t", f"has {word()} and {word()}") for a in range(60) for i in range(rng.randrange(1, 5))]
    roles = [
        (a, s, f"says {word()}, {word()} now", rng.choice(["citation", "citation", "affirmation"]), [f"/d/{rng.randrange(4)}.md"])
        for a in range(60) for s in range(3)
    ]
    return (
        spark.createDataFrame(roles, "answer_id long, sentence_no int, sentence string, role string, cited array<string>"),
        spark.createDataFrame(contexts, "answer_id long, rank int, path string, title string, content string"),
    )


def test_digits_of_sources_are_no_rows_and_equal_the_joins(spark, monkeypatch):
    roles, contexts = _case(spark)
    fabricated = roles.select("answer_id", F.lit("says").alias("candidate")).distinct()
    runs = {
        "attribute": lambda: audit.attribute_digits(roles, contexts), "stale": lambda: audit.stale_citations(roles, fabricated, contexts),
        "unsupported": lambda: audit.unsupported_digits(roles, contexts),
    }
    listed = {name: run() for name, run in runs.items()}
    for name in ("attribute", "stale"):
        assert "Generate" not in _plan(listed[name])
    got = {name: sorted(map(tuple, df.collect())) for name, df in listed.items()}
    assert all(got.values())
    monkeypatch.setattr(audit, "GROUP_ROWS", 0)  # every answer is a crowded one
    assert got == {name: sorted(map(tuple, run().collect())) for name, run in runs.items()}


def test_vectors_of_few_rows_with_the_rarity_of_all(spark):
    texts = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "red red dog")], "id long, t string")
    whole = {r["id"]: list(r["vector"]) for r in retrieval.embed_hashed(texts, "t", size=16).collect()}
    one = retrieval.embed_hashed(texts.where("id = 2"), "t", size=16, fitted_on=texts).collect()
    assert [list(r["vector"]) for r in one] == [whole[2]]


def test_similarity_of_sparse_vectors_is_the_cosine(spark):
    rng = random.Random(3)
    vectors = lambda n: [[0.0] * 8] + [[rng.choice([0.0, rng.random()]) for _ in range(8)] for _ in range(n)]
    sentences = spark.createDataFrame([(1, i, v) for i, v in enumerate(vectors(9))], "answer_id long, sentence_no int, vector array<float>")
    sources = spark.createDataFrame([(1, v) for v in vectors(5)], "answer_id long, vector array<float>")
    pairs = sentences.withColumnRenamed("vector", "a").join(sources.withColumnRenamed("vector", "b"), "answer_id")
    plain = pairs.groupBy("answer_id", "sentence_no").agg(F.max(audit.cosine(F.col("a"), F.col("b"))).alias("score"))
    assert sorted(map(tuple, audit.best_similarity(sentences, sources).collect())) == sorted(map(tuple, plain.collect()))
