"""The pipeline's stages against plain versions, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codicil.llm import toxicity
from codicil.llm.queries import ORACLES, QUERIES
from tests import oracle
from tests.llm.conftest import ODD_TEXTS, SF
from tests.llm.helpers import grouped, text_links
from tests.llm.test_text_operators import plain_personal_data


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, message, _ = oracle.compare(spark, SF, con, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_one_query_for_each_operator():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


def test_toxic_documents_go_and_others_stay_as_they_are(spark, documents):
    kept = corpus_pipeline.drop_toxic(spark, documents, SF)
    assert kept.columns == documents.columns and kept.exceptAll(documents).count() == 0
    chain = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.label_categories())
    rejected = toxicity.score(documents, chain, keep=["doc_id"]).where("p_toxic >= 0.5")
    assert kept.count() + rejected.count() == documents.count()


def test_one_of_each_near_duplicate_group_stays(spark, documents, texts):
    want = {k for k, least in grouped(texts, text_links(texts, 5, 80)).items() if k == least}
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, SF)
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == documents.columns
    assert kept.exceptAll(documents).count() == 0


def test_personal_data_is_masked_and_nothing_else_changes(spark, documents, texts):
    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_personal_data(spark, documents, SF).collect()}
    assert set(masked) == set(texts)
    for key, text in texts.items():
        spans = sorted((a, b, k) for k, own in plain_personal_data(text or "").items() for a, b in own)
        assert "[CONTEXT]" in masked[key]["text"] or masked[key]["text"] == replaced(text, spans)
        assert masked[key]["n_chars"] == len(masked[key]["text"])


def replaced(text, spans):
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_run_applies_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sums.where("n > 4096 or n != end").count() == 0


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    for source, rows in ((odd.withColumn("p_toxic", F.lit("mine")), ODD_TEXTS), (nothing, [])):
        docs = source
        for _, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, SF)
            assert out.columns == source.columns
            docs = out
        ids = [r["doc_id"] for r in docs.collect()]
        assert sorted(i for i in ids if i is not None) == ([1, 3, 4, 5, 6, 8, 9, 10, 11] if rows else [])
        assert len(ids) == (10 if rows else 0)
        assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= len(ids)


def test_one_row_stays_of_a_group_without_ids_and_of_several_texts_of_one_id(spark):
    copy, other = "one two three four five six seven eight nine ten", "quite another text of more than five words"
    rows = [(None, copy)] * 3 + [(None, copy.upper())] + [(5, copy + " eleven"), (5, other), (5, other), (7, other), (8, None), (8, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(5, copy + " eleven"), (5, other), (8, None), (None, None), (None, "")]))
    nameless = docs.where("doc_id is null and text is not null")
    assert corpus_pipeline.drop_near_duplicates(spark, nameless, SF).count() == 2
