"""Crops round the best match, and packing when one question holds all rows."""

import random

import pytest
from pyspark.sql import functions as F

from codicil.functions import text as ft
from codicil.operators import context


def plain_crop(text, terms, words):
    found = [(w.lower(), i) for i, w in enumerate(text.split())]
    hits = [(i, w) for w, i in found if w in terms]
    best = max(((len({w for j, w in hits if i - words < j <= i}), -i) for i, _ in hits), default=(0, 0))
    if not best[0]:
        return 0, min(words, len(found)), 0
    last = -best[1]
    first = min(j for j, _ in hits if last - words < j <= last)
    start = max(0, first - (words - (last - first + 1)) // 2)
    return start, min(len(found), start + words) - start, best[0]


@pytest.mark.parametrize("words", [1, 3, 10])
def test_crop_equals_all_windows(spark, words):
    draw = random.Random(words)
    texts = [" ".join(draw.choices(["a", "B", "c", "x", "y", "zz"], k=draw.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = df.select("t", ft.best_crop(F.col("t"), F.array(*map(F.lit, ("a", "b", "c"))), words).alias("c")).select("t", "c.*").collect()
    for r in got:
        assert (r["first_word"], r["n_words"], r["matched"]) == plain_crop(r["t"], {"a", "b", "c"}, words)
        start, n, own = r["first_word"], r["n_words"], r["t"].split()
        assert r["crop"] == ("…" if start else "") + " ".join(own[start : start + n]) + ("…" if start + n < len(own) else "")


def test_crop_of_null_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " .. ")], "id long, t string")
    rows = {r["id"]: r["c"] for r in df.select("id", ft.best_crop(F.col("t"), F.array(F.lit("a"))).alias("c")).collect()}
    assert rows[1]["crop"] is None and (rows[2]["crop"], rows[3]["crop"]) == ("", " .. ") and rows[3]["n_words"] == 0


@pytest.mark.parametrize("budget", [200, 1000, 10**7])
def test_packing_when_one_question_holds_all_rows(spark, budget):
    draw = random.Random(budget)
    rows = [("hot", i, "w" * draw.randint(0, 900)) for i in range(3000)] + [("cold", 1, "x" * 300), (None, 1, "y" * 30)]
    df = spark.createDataFrame(rows, "query_id string, rank long, text string").repartition(7)
    got = {(r["query_id"], r["rank"]): (r["text"], r["truncated"]) for r in context.pack_context(df, budget, header_tokens=10).collect()}
    want, spent, over = {}, {}, set()
    for q, rank, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        before = spent.get(q, 10)
        spent[q] = before + len(text) // 4
        if spent[q] <= budget:
            want[q, rank] = (text, False)
        elif q not in over:
            over.add(q)
            room = budget - before - 50
            if room > 100:
                want[q, rank] = (text[: room * 4] + "..." if len(text) > room * 4 else text, True)
    assert got == want
