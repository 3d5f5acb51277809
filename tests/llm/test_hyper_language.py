"""Language profiles: the encoding against plain loops, accuracy on texts held out, special rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.llm import hyper_language
from codicil.llm.queries import QUERIES
from tests.llm.conftest import SF


def plain_vector(text, encoder):
    signs = [0]
    for c in text.lower():
        own = ord(c) if c.isalpha() else 0
        if own or signs[-1]:
            signs.append(own)
    signs += [0] if signs[-1] else []
    out = np.zeros(encoder.dimensions)
    for i in range(len(signs) - encoder.letters + 1):
        bound = np.ones(encoder.dimensions)
        for k, p in enumerate(signs[i : i + encoder.letters]):
            own = np.random.default_rng([encoder.seed, p + 1 if p else 0]).integers(0, 2, encoder.dimensions, np.int8) * 2.0 - 1
            bound *= np.roll(own, encoder.letters - 1 - k)
        out += bound
    return out


@pytest.mark.parametrize("size", [2, 5, 1 << 17])
def test_vectors_equal_plain_loops_in_slices_of_any_size(monkeypatch, size):
    monkeypatch.setattr(hyper_language, "SLICE", size)
    texts = ["One two, three.", "", "  ...  ", "É", "ΟΔΟΣ 漢字 and 12 3x", "a  b", "x" * 9, "word " * 7]
    encoder = hyper_language.Encoder(64)
    got = encoder.vectors(texts)
    for text, own in zip(texts, got, strict=True):
        assert np.array_equal(own, plain_vector(text, encoder)), text


def test_held_out_texts(spark):
    rows = QUERIES["op13_hyper_language"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_nothing_is_learned_from_texts_held_out(spark, documents):
    held = hyper_language.held_out()
    spoilt = documents.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    one, two = (hyper_language.fit(d, ~held) for d in (documents, spoilt))
    assert one.languages == two.languages and np.array_equal(one.prototypes, two.prototypes)


def test_odd_and_empty_tables(spark, odd, nothing, documents):
    profiles = hyper_language.fit(documents, F.lit(True))
    rows = hyper_language.identify(odd, profiles, keep=["doc_id", "text", "id", "_text", "c0"]).collect()
    assert len(rows) == odd.count() and all(r["id"] == r["c0"] == "mine" for r in rows)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und" and r["score"] == 0) if not lettered else r["lang_pred"] in profiles.languages
    assert hyper_language.identify(nothing, profiles, keep=["doc_id"]).count() == 0
    none = hyper_language.fit(nothing, F.lit(True))
    assert none.languages == []
    assert {(r["lang_pred"], r["score"]) for r in hyper_language.identify(odd, none, keep=["doc_id"]).collect()} == {("und", 0.0)}


def test_equal_cosines_give_the_first_language(spark):
    rows = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    profiles = hyper_language.fit(rows, F.lit(True))
    assert {r["lang_pred"] for r in hyper_language.identify(rows, profiles, keep=["doc_id"]).collect()} == {"a"}


def test_more_tasks_learn_the_same(spark, documents):
    one, two = (hyper_language.fit(documents.repartition(n), F.lit(True)) for n in (1, 7))
    assert one.languages == two.languages and np.allclose(one.prototypes, two.prototypes, atol=1e-6)
