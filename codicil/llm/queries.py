"""The registered queries of this package and their SQL twins.

Each ``opN_`` query runs its operator over a whole table and derives the columns
of its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm import bpe, embedding_index, hyper_language, max_score, near_text, packing, phrases, pii, secret_scan, sharding, sql, toxicity, turn_trie, warc
from codicil.llm.shared import table, tokenizer
from codicil.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20  # of text


def query(name: str, oracle: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


@query("op1_near_duplicate_vectors", sql.NEAR_VECTORS)
def op1_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_index.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), similarity=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query("op2_extendible_sharding", sql.SHARDS.format(limit=SHARD_BYTES))
def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "shard_id", "depth")


@query("op3_near_duplicate_text", sql.NEAR_TEXT)
def op3_near_duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_text.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3, similarity=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chain = toxicity.fit(documents, table(spark, sf_dir, "labels"), toxicity.label_categories())
    found = toxicity.score(documents, chain, keep=["doc_id"])
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)
    return found.withColumnRenamed("id", "doc_id")


@query("op6_trie_bpe")
def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digests=True)
    return found.withColumnRenamed("id", "doc_id")


@query("op7_max_score", sql.TOP_K)
def op7_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return max_score.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op8_dictionary_warc", sql.WARC)
def op8_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(pii.KINDS), 256).alias("base_sha256"), pii.listed((*pii.KINDS, pii.CONTEXT)).alias("spans"),
    )


@query("op10_entropy_secrets")
def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.ENTROPY)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secret_scan.KINDS)
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op11_collocations", sql.COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=30, longest=4, top=2000)


@query("op12_turn_trie", sql.TURN_TRIE)
def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    taken = F.crc32(conv.cast("string").cast("binary")) % 9
    return turn_trie.prefix_nodes(turn_trie.with_borrowed_heads(turns, lender=conv - conv % 5, taken=taken, most=8))


@query("op13_hyper_language")
def op13_hyper_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", hyper_language.held_out())
    profiles = hyper_language.fit(documents, training=~F.col("held_out"))
    return hyper_language.identify(documents, profiles, keep=["doc_id", "held_out"])
