"""From questions to a packed context, as one batch of joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import paths, text
from codicil.functions.queries import anchor_terms, reduce_meta_question
from codicil.operators import context as ctx
from codicil.operators import pins, retrieval
from codicil.session import materialise


@dataclass(frozen=True)
class Settings:
    max_docs: int = 5
    max_tokens: int = fv.CONTEXT_MAX_TOKENS
    token_pins: int = fv.MAX_TOKEN_PINS


def rewrite(queries: DataFrame, docs: DataFrame, content: str = "content") -> DataFrame:
    """Questions reduced to their subject and their rare words."""
    reduced = queries.withColumn("text", reduce_meta_question(F.col("text"))["subject"])
    total = docs.agg(F.count("*")).scalar()
    return retrieval.distill(reduced, retrieval.document_frequency(docs, content), total)


def all_pins(queries: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, path, source, _s, _r): every pinned document once per question."""
    def named(df: DataFrame, source: str, rank: str) -> DataFrame:
        return df.select("query_id", "path", F.lit(source).alias("source"), F.col(rank).cast("long").alias("rank"))

    stems = named(pins.stem_match(queries, docs), "stem", "pos")
    titles = named(pins.title_coverage(queries, docs), "title", "rank")
    hits = pins.exact_token_pins(queries, docs, settings.token_pins, "path")
    tokens = named(hits, "token", "rank")
    phrases = named(pins.phrase_match(queries, docs, key="path").withColumn("rank", F.lit(1)), "phrase", "rank")
    return pins.rank_pins(stems.unionByName(titles).unionByName(tokens).unionByName(phrases))


def ranked_context(queries: DataFrame, rewritten: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Best documents per question with a score of 1 if grounded in its words, else 0."""
    best = retrieval.keyword_search(rewritten, docs, settings.max_docs, "path")
    hits = best.select("query_id", "rank", "path", "score").join(docs.select("path", "title", "content"), "path")
    probe = queries.select("query_id", F.array_join(anchor_terms(F.col("text")), " ").alias("text"))
    # The probe is tested on the hits themselves: whether a hit is grounded depends on no other document.
    words = probe.select("query_id", F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    held = best.select("query_id", "path").join(docs.select("path", F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("word")), "path")
    found = held.join(words, ["query_id", "word"], "left_semi").select("query_id", "path").distinct()
    return ctx.anchor_chunks(hits, queries, found)


def retrieve(
    queries: DataFrame, docs: DataFrame, history: DataFrame | None = None, settings: Settings = Settings()
) -> DataFrame:
    """(query_id, position, path, pinned, text): the context of every question.

    ``docs`` holds path, title and content; ``history`` optionally a widened
    text per question.  Questions whose first pass finds nothing usable are
    searched again with the widened text; both passes run on the same
    materialised corpus columns.
    """
    rewritten = materialise(rewrite(queries, docs), "rewritten")
    first = materialise(ranked_context(queries, rewritten, docs, settings), "first-pass")
    found = first
    if history is not None:
        usable = ctx.all_weak(first).where("not weak").select("query_id")
        weak = queries.join(usable, "query_id", "left_anti").select("query_id")
        retry = history.join(weak, "query_id", "left_semi")
        second = ranked_context(retry, rewrite(retry, docs), docs, settings)
        better = ctx.all_weak(second).where("not weak").select("query_id")
        second = second.join(better, "query_id", "left_semi")
        found = first.join(better, "query_id", "left_anti").unionByName(second)
    pinned = all_pins(queries, docs, settings)
    merged = pins.union_pins(pinned, found.select("query_id", "path", "rank"))
    body = merged.join(docs.select("path", "title", "content"), "path").withColumn("rank", F.struct("_o", "path"))
    unique = ctx.dedup_by_content(body)
    order = Window.partitionBy("query_id").orderBy("_rank")
    placed = unique.withColumnRenamed("rank", "_rank").withColumn("rank", F.row_number().over(order))
    # Whole contents; the token budget of the packing is the only bound.
    block = ctx.context_line(F.col("rank"), F.col("title"), F.col("path"), F.col("content"), max_chars=None)
    lines = placed.select("query_id", "rank", "path", "pinned", block.alias("text"))
    return ctx.pack_context(lines, settings.max_tokens).select(
        "query_id", F.col("rank").alias("position"), "path", paths.name(F.col("path")).alias("name"), "pinned", "truncated", "text"
    )
