"""Toxicity: probabilities and the number of labels."""

import numpy as np
from pyspark.sql import functions as F

from codicil.llm import toxicity


def test_probabilities_do_not_move_with_the_number_of_labels(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        toxic = int(i % 10 == 0)
        words = ["calm", "plain", "usual"] + (["vile"] if rng.random() < (0.6 if toxic else 0.1) else [])
        rows.append((i, " ".join(words), 1, toxic))
    once = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    tenfold = once.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("copy"))
    probes = spark.createDataFrame([(1, "calm plain usual vile"), (2, "calm plain usual")], "doc_id long, text string")

    def probabilities(table):
        chain = toxicity.fit(table, table, toxicity.label_categories(), max_labelled=800)
        return {r["doc_id"]: r["p_toxic"] for r in toxicity.score(probes, chain, keep=["doc_id"]).collect()}

    small, large = probabilities(once), probabilities(tenfold)
    assert all(abs(small[i] - large[i]) < 0.1 for i in small), (small, large)
