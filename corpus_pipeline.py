"""Corpus pipeline: the stages that turn the documents table into packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of documents.  Null texts pass every stage (they are packed as empty ones), an
empty table gives an empty result, and columns besides those of documents are carried
along untouched up to the last stage, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm import near_text, packing, pii, toxicity
from codicil.llm.shared import stage, table, tokenizer
from codicil.session import configure

TOXIC = 0.5
CAPACITY = 4096


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _configured(function: Stage) -> Stage:
    """A stage under the settings that its operators rely on, whoever calls it."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(configure(spark), docs, sf_dir)

    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns ``c0, c1 ...``, so that no name of its own can clash; those of the id and the text."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"]


@_configured
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the category ``toxic`` is below ``TOXIC``; trained on the labels table."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    own, _, text = _numbered(docs)
    scored = toxicity.score(own, chain, keep=own.columns, text_column=text)
    return scored.where(F.col("p_toxic") < TOXIC).select(*own.columns).toDF(*docs.columns)


@_configured
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id.

    A row is known by its id and text.  Of several texts with the smallest id, and in a
    group without any id, the one with the smallest hash stays; rows equal in id and text
    count as one.  Texts without words are alike to nothing.
    """
    found = near_text.near_duplicate_classes(docs.select("doc_id", "text"), width=5, similarity=80)
    rows = stage(found.groupBy("component", "id", "text_hash").agg((F.count("*") > 1).alias("several")), "decided")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "text_hash"))
    winners = rows.where("component is not null").groupBy("component").agg(first.alias("w")).select(F.col("component").alias("of"), F.col("w.id").alias("first_id"), F.col("w.text_hash").alias("first_hash"))
    judged = rows.join(winners, F.col("component") == F.col("of"), "left")
    stays = F.col("of").isNull() | (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
    judged = stage(judged.select(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"), stays.alias("stays"), "several"), "judged")
    own, key, text = _numbered(docs)
    same = F.col(key).cast("long").eqNullSafe(F.col("of_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("of_hash"))
    kept = own.join(judged.where("not stays").select("of_id", "of_hash"), same, "left_anti")
    several = judged.where("stays and several").select("of_id", "of_hash")
    if several.limit(1).count():
        once = kept.join(several, same, "left_anti")
        kept = once.unionByName(kept.join(several, same, "left_semi").dropDuplicates([key, text]))
    return kept.toDF(*docs.columns)


@_configured
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by ``[KIND]`` in the texts; ``n_chars`` is counted anew where something was."""
    found = pii.find_personal_data(docs.select("doc_id", "text")).select("id", "text_hash", pii.all_spans().alias("spans"))
    found = found.where(F.size("spans") > 0).dropDuplicates(["id", "text_hash"])
    own, key, text = _numbered(docs)
    same = F.col(key).eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_hash"))
    hit = F.col("spans").isNotNull()
    joined = own.join(found, same, "left").withColumn("masked", F.when(hit, pii.masked(F.col(text), F.col("spans"))).otherwise(F.col(text)))
    count = own.columns[docs.columns.index("n_chars")]
    changed = {text: F.col("masked"), count: F.when(hit, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(count))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in own.columns]).toDF(*docs.columns)


@_configured
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``CAPACITY`` tokens."""
    found = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, capacity=CAPACITY)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained model and a tokenizer; tests/llm compares with plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


PIPELINE = {"pipeline": run}
