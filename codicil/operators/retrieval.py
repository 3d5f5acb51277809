"""Lexical, vector and hybrid ranking of documents and chunks.

Queries come as a table ``(query_id, text)`` and are answered as one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codicil import fixed_values as fv
from codicil.functions.text import tokens
from codicil.operators import scoring
from codicil.scale import is_small, small_or_shuffled, spread
from codicil.session import materialise


def top_per_query(scored: DataFrame, limit: int, order: list[Column], key: str = "query_id") -> DataFrame:
    """Rank and keep the first ``limit`` rows of each query.

    Spark trims each partition to ``limit`` rows per query before the shuffle,
    so a popular query costs no more than a rare one.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def document_frequency(docs: DataFrame, content: str = "content") -> DataFrame:
    """term, df: number of documents holding each term."""
    return (
        docs.select(F.explode(F.array_distinct(tokens(F.col(content)))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def keyword_search(
    queries: DataFrame, docs: DataFrame, limit: int = 10, key: str = "id", content: str = "content"
) -> DataFrame:
    """Best documents per query: (query_id, rank, key, score, matched).

    A query without words is answered by the first ``limit`` documents in the order of
    their keys, with score 0.
    """
    scored = scoring.lexical_scores(queries, docs, key, content, limit).unionByName(_first_documents(queries, docs, limit, key))
    return top_per_query(scored, limit, [F.desc("score"), F.asc(key)]).select("query_id", "rank", key, "score", "matched")


def _first_documents(queries: DataFrame, docs: DataFrame, limit: int, key: str) -> DataFrame:
    first = docs.select(key).orderBy(key).limit(limit).agg(F.sort_array(F.collect_list(key))).scalar()  # `limit` keys
    blank = queries.where(F.size(tokens(F.coalesce("text", F.lit("")))) == 0)
    return blank.select("query_id", F.explode(first).alias(key), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"))


def count_matches(queries: DataFrame, docs: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(query_id, n): documents sharing a term with the query; all of them for an empty query."""
    wanted = query_terms(queries)
    hits = (
        docs.select(key, F.explode(F.array_distinct(tokens(F.col(content)))).alias("term"))
        .join(small_or_shuffled(wanted), "term")
        .select("query_id", key)
        .distinct()
        .groupBy("query_id")
        .agg(F.count("*").alias("n"))
    )
    everything = docs.agg(F.count("*")).scalar()
    blank = F.size(tokens(F.col("text"))) == 0
    return queries.join(hits, "query_id", "left").select(
        "query_id", F.when(blank, everything).otherwise(F.coalesce("n", F.lit(0))).alias("n")
    )


# --- typo-tolerant lexicographic ranking ---------------------------------------------


def _allowed_typos(term: Column) -> Column:
    return F.when(F.length(term) >= 8, 2).when(F.length(term) >= 4, 1).otherwise(0)


def _deletions(term: Column, depth: int) -> Column:
    """The term and everything left after deleting up to ``depth`` characters."""
    found = F.array(term)
    layer = found
    for _ in range(depth):
        layer = F.array_distinct(
            F.flatten(
                F.transform(
                    layer,
                    lambda t: F.transform(
                        F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
                        lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))),
                    ),
                )
            )
        )
        found = F.array_union(found, layer)
    return found


def similar_terms(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, found, typos): corpus terms within the typo allowance of a query term.

    Two words within distance d share a form with at most d deletions on each
    side, so candidates come from an equality join on those forms and are then
    checked with the exact distance.
    """
    terms = wanted.select("term").distinct().withColumn("allowed", _allowed_typos(F.col("term")))
    # Longer words are out of reach of every query word, so their forms are never built.
    longest = terms.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).scalar()
    pairs = []
    for depth in (0, 1, 2):
        left = terms.where(F.col("allowed") == depth).select(
            "term", "allowed", F.explode(_deletions(F.col("term"), depth)).alias("form")
        )
        least = {0: 1, 1: 3, 2: 6}[depth]
        right = vocabulary.where((F.length("found") >= least) & (F.length("found") <= longest + depth)).select(
            "found", F.explode(_deletions(F.col("found"), depth)).alias("form")
        )
        pairs.append(right.join(small_or_shuffled(left), "form").select("term", "found", "allowed"))
    candidates = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()
    return candidates.withColumn("typos", F.levenshtein("term", "found")).where("typos <= allowed").select(
        "term", "found", "typos"
    )


def _ranked_in_tasks(query_side: DataFrame, docs: DataFrame, limit: int, key: str, attributes: tuple[str, ...]) -> DataFrame:
    """``query_id, key, matched, typos, attribute``: the best ``limit`` documents of each query and task."""
    names = [f"_a{n}" for n in range(len(attributes))]
    words = spread(docs.select(key, *attributes)).select(key, *[F.array_distinct(tokens(F.coalesce(F.col(a), F.lit("")))).alias(n) for a, n in zip(attributes, names)])
    # Rows of one key are one document.
    repeated = materialise(words.groupBy(key).agg(F.count("*").alias("_c")).where("_c > 1").select(F.col(key).alias("_k")), "repeated-keys")
    if not repeated.isEmpty():
        own = F.col(key).eqNullSafe(F.col("_k"))
        united = words.join(repeated, own, "left_semi").groupBy(key).agg(*[F.array_distinct(F.flatten(F.collect_list(n))).alias(n) for n in names])
        words = words.join(repeated, own, "left_anti").unionByName(united)
    asked: dict[str, list[tuple]] = {}
    ids = [r[0] for r in query_side.select("query_id").distinct().collect()]  # no more than the rows that ``is_small`` allows
    place = {query: i for i, query in enumerate(ids)}
    for r in query_side.collect():
        asked.setdefault(r["found"], []).append((place[r["query_id"]], r["term"], r["typos"]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                hits: dict[tuple, tuple] = {}
                for attribute, found in enumerate(row[1:]):
                    for word in found:
                        for query, term, typos in asked.get(word, ()):
                            least = hits.get((query, term), (typos, attribute))
                            hits[query, term] = min(least[0], typos), min(least[1], attribute)
                scores: dict[int, list[int]] = {}
                for (query, _), (typos, attribute) in hits.items():
                    score = scores.setdefault(query, [0, 0, attribute])
                    score[:] = score[0] - 1, score[1] + typos, min(score[2], attribute)
                for query, score in scores.items():
                    kept = best.setdefault(query, [])
                    kept.append((*score, row[0] is not None, row[0]))
                    if len(kept) >= 4 * limit + 64:
                        kept.sort()
                        del kept[limit:]
        if best:
            rows = [(query, *r) for query, kept in best.items() for r in sorted(kept)[:limit]]
            query, matched, typos, attribute, _, keys = zip(*rows)
            columns = [pa.array([ids[q] for q in query], id_type), pa.array(keys, kind), pa.array([-m for m in matched], pa.int64()), pa.array(typos, pa.int64()), pa.array(attribute, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", key, "matched", "typos", "attribute"])

    id_type = to_arrow_type(query_side.schema["query_id"].dataType)
    kinds = f"query_id {query_side.schema['query_id'].dataType.simpleString()}, `{key}` {docs.schema[key].dataType.simpleString()}"
    return words.mapInArrow(rank, f"{kinds}, matched long, typos long, attribute int")


def ranked_search(
    queries: DataFrame,
    docs: DataFrame,
    limit: int = 10,
    key: str = "id",
    attributes: tuple[str, ...] = ("title", "content", "path"),
) -> DataFrame:
    """Rule order of a typo-tolerant engine: words matched, typos, attribute, id.

    ``attributes`` are searched in order of importance.  The words that the queries ask for, if they are few,
    go to the documents; each task then keeps its best ``limit`` documents of a query.
    """
    order = [F.desc("matched"), F.asc("typos"), F.asc("attribute"), F.asc(key)]
    columns = F.array(*[
        F.struct(F.lit(n).alias("attr"), F.array_distinct(tokens(F.coalesce(F.col(a), F.lit("")))).alias("terms"))
        for n, a in enumerate(attributes)
    ])
    by_attr = docs.select(key, F.explode(columns).alias("_a")).select(
        key, F.col("_a.attr").alias("attr"), F.explode("_a.terms").alias("found")
    )
    wanted = query_terms(queries)
    similar = similar_terms(wanted, by_attr.select("found").distinct())
    query_side = materialise(wanted.join(similar, "term").select("query_id", "term", "found", "typos"), "asked-words")
    if is_small(query_side):
        best = _ranked_in_tasks(query_side, docs, limit, key, attributes)
        return top_per_query(best, limit, order).select("query_id", "rank", key, "matched", "typos", "attribute")
    best = (
        by_attr.join(small_or_shuffled(query_side), "found")
        .groupBy("query_id", key, "term")
        .agg(F.min("typos").alias("typos"), F.min("attr").alias("attr"))
        .groupBy("query_id", key)
        .agg(
            F.count("*").alias("matched"),
            F.sum("typos").cast("long").alias("typos"),
            F.min("attr").alias("attribute"),
        )
    )
    return top_per_query(best, limit, order).select("query_id", "rank", key, "matched", "typos", "attribute")


def title_search(queries: DataFrame, docs: DataFrame, limit: int = 10, key: str = "id", title: str = "title") -> DataFrame:
    """Titles only, tolerant of words that occur in no title: rare terms count most."""
    return keyword_search(queries, docs, limit, key, title)


# --- vectors ---------------------------------------------------------------------------


def vector_top_k(
    queries: DataFrame, vectors: DataFrame, limit: int = 10, key: str = "id", vector: str = "vector",
    min_score: float | None = None,
) -> DataFrame:
    """Nearest vectors per query: (query_id, rank, key, score); a zero vector scores 0."""
    scored = scoring.vector_scores(queries, vectors, key, vector, limit)
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return top_per_query(scored, limit, [F.desc("score"), F.asc(key)]).select("query_id", "rank", key, "score")


def _hashed_counts(df: DataFrame, text: str, size: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF

    return HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=size).transform(
        df.withColumn("_tok", tokens(F.coalesce(F.col(text), F.lit(""))))
    )


def embed_hashed(df: DataFrame, text: str, output: str = "vector", size: int = 256, fitted_on: DataFrame | None = None) -> DataFrame:
    """Default embedding: hashed TF-IDF of the tokens, unit length.

    ``fitted_on`` holds the texts that the rarity of words is counted on, if these are not those of ``df`` alone.
    """
    from pyspark.ml.feature import IDF, Normalizer
    from pyspark.ml.functions import vector_to_array

    rarity = IDF(inputCol="_tf", outputCol="_idf").fit(_hashed_counts(df if fitted_on is None else fitted_on, text, size).select("_tf"))
    weighted = rarity.transform(_hashed_counts(df, text, size))
    unit = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighted)
    return unit.withColumn(output, vector_to_array("_unit", "float32")).drop("_tok", "_tf", "_idf", "_unit")


def embed_with(df: DataFrame, text: str, make_encoder: Callable, output: str = "vector") -> DataFrame:
    """Embedding by any encoder; ``make_encoder()`` runs once per task, blank text gives null."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            vectors = encoder(texts.fillna("").tolist())
            yield pd.Series([list(map(float, v)) if t and t.strip() else None for t, v in zip(texts, vectors)])

    return df.withColumn(output, encode(F.col(text)))


# --- hybrid -----------------------------------------------------------------------------


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    limit: int = 10,
    ratio: float = 0.5,
    mode: str = "hybrid",
    key: str = "id",
    content: str = "content",
    vector: str = "vector",
    min_score: float | None = None,
) -> DataFrame:
    """One blended ranking: ``ratio`` of the semantic and the rest of the lexical score.

    ``mode`` semantic or fulltext is a ratio of 1 or 0.  Every document with
    either signal takes part; ``queries`` carries a ``vector`` column.
    """
    ratio = {"semantic": 1.0, "fulltext": 0.0}.get(mode, ratio)
    scored = scoring.blended_scores(queries, docs, key, content, vector, ratio, limit, min_score)
    return top_per_query(scored, limit, [F.desc("score"), F.asc(key)]).select("query_id", "rank", key, "score")


def chunk_search(
    queries: DataFrame, chunks: DataFrame, limit: int = 5, min_score: float = fv.MIN_RELEVANCE_SCORE,
    ratio: float = 0.5, doc_id=None, key: str = "chunk_id", vector: str = "vector", mode: str = "hybrid",
) -> DataFrame:
    """Best chunks per query above a score, optionally within one document."""
    if doc_id is not None:
        chunks = chunks.where(F.col("doc_id") == doc_id)
    return hybrid_search(queries, chunks, limit, ratio, mode, key, "content", vector, min_score)


def top_chunks(scored: DataFrame, limit: int = 5, min_score: float = fv.MIN_RELEVANCE_SCORE, key: str = "chunk_id") -> DataFrame:
    """Threshold first, then the best ``limit`` chunks per query."""
    return top_per_query(scored.where(F.col("score") >= min_score), limit, [F.desc("score"), F.asc(key)])


def unique_docs(hits: DataFrame) -> DataFrame:
    """(query_id, chunks, unique_docs) of kept chunks."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("unique_docs")
    )


def distill(queries: DataFrame, frequencies: DataFrame, total_docs: Column, ratio: float = fv.DISTILL_MAX_DOC_RATIO) -> DataFrame:
    """(query_id, text): distinctive tokens and rare Latin words of each query.

    A word counts as rare below ``max(1, floor(ratio * total))`` documents; an
    empty result falls back to the (glued) question.
    """
    from codicil.functions.queries import glue_query, split_structured

    glued = queries.select("query_id", glue_query(F.col("text")).alias("text"))
    structured, rest = split_structured(F.col("text"))
    parts = glued.select("query_id", "text", F.array_distinct(structured).alias("_kept"), rest.alias("_rest"))
    words = F.regexp_extract_all(F.col("_rest"), F.lit(fv.LATIN_WORD), 0)
    rows = parts.select("query_id", F.posexplode(words).alias("_pos", "_word"))
    firsts = rows.groupBy("query_id", F.lower("_word").alias("term")).agg(F.min(F.struct("_pos", "_word")).alias("_w"))
    limit = F.greatest(F.lit(1), F.floor(F.lit(ratio) * total_docs))
    rare = (
        firsts.join(frequencies, "term", "left")
        .where(F.coalesce("df", F.lit(0)) < limit)
        .groupBy("query_id")
        # A question's own words: as many as the question text holds.
        .agg(F.array_sort(F.collect_list("_w")).alias("_rare"))
    )
    joined = F.array_distinct(F.concat("_kept", F.coalesce(F.col("_rare._word"), F.array().cast("array<string>"))))
    text = F.trim(F.array_join(joined, " "))
    return parts.join(rare, "query_id", "left").select(
        "query_id", F.when(text == "", F.col("text")).otherwise(text).alias("text")
    )


def query_variants(queries: DataFrame) -> DataFrame:
    """Each query and, when it differs, its expansion."""
    from codicil.functions.queries import expanded_query

    widened = queries.select("query_id", expanded_query(F.col("text")).alias("text"))
    return queries.select("query_id", "text").unionByName(widened).distinct()
