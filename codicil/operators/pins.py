"""Documents pinned to a question by exact signals: names, tokens, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import paths
from codicil.functions import unicode as uc
from codicil.functions.queries import is_distinctive, query_tokens, salient_terms, structured_tokens, title_tokens
from codicil.functions.text import content_fingerprint, excerpt_around
from codicil.operators.retrieval import top_per_query
from codicil.operators.verbatim import bearers, phrase_pairs
from codicil.scale import small_or_shuffled


def query_tokens_table(queries: DataFrame) -> DataFrame:
    """(query_id, pos, token, needle): distinctive tokens with their search form."""
    return queries.select(
        "query_id", F.posexplode(structured_tokens(F.col("text"), min_nonlatin=2)).alias("pos", "token")
    ).withColumn("needle", F.lower(uc.nfkc(F.col("token"))))


def _folded(docs: DataFrame, key: str, content: str) -> DataFrame:
    return docs.select(key, F.lower(uc.nfkc(F.coalesce(F.col(content), F.lit("")))).alias("_body"))


def token_hits(queries: DataFrame, docs: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(query_id, pos, token, key): every document holding a distinctive token."""
    wanted = query_tokens_table(queries)
    hits = bearers(wanted.select("needle").distinct(), _folded(docs, key, content), "needle", "_body", [key], least=2)
    return hits.join(small_or_shuffled(wanted), "needle").select("query_id", "pos", "token", key)


def exact_token_pins(
    queries: DataFrame, docs: DataFrame, cap: int = fv.MAX_TOKEN_PINS, key: str = "id", content: str = "content"
) -> DataFrame:
    """The first ``cap`` bearers per question with an excerpt centred on the token."""
    firsts = (
        token_hits(queries, docs, key, content)
        .groupBy("query_id", key)
        .agg(F.min(F.struct("pos", "token")).alias("_t"))
        .select("query_id", key, "_t.pos", "_t.token")
    )
    top = top_per_query(firsts, cap, [F.asc("pos"), F.asc(key)])
    return top.join(docs.select(key, content), key).select(
        "query_id", "rank", key, "token", excerpt_around(F.col(content), F.col("token")).alias("excerpt")
    )


def token_bearers(queries: DataFrame, docs: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(token, documents, bearers): documents and distinct contents holding each token."""
    hits = token_hits(queries, docs, key, content).select("token", key).distinct()
    prints = docs.select(key, content_fingerprint(F.col(content)).alias("_fp"))
    return hits.join(prints, key).groupBy("token").agg(
        F.count("*").alias("documents"), F.count_distinct("_fp").alias("bearers")
    )


def title_coverage(
    queries: DataFrame, docs: DataFrame, threshold: float = fv.TITLE_COVERAGE, limit: int = fv.TITLE_MAX_DOCS,
    path: str = "path", title: str = "title",
) -> DataFrame:
    """(query_id, rank, path, coverage): documents whose title the question spells out."""
    asked = queries.select("query_id", F.array_distinct(query_tokens(F.col("text"))).alias("_q"))
    words = asked.select("query_id", F.explode("_q").alias("token"))
    found = docs.select(path, title_tokens(F.col(title)).alias("_t"))
    named = found.where(F.size("_t") > 0).where(F.exists("_t", is_distinctive))
    # Titles holding each asked word: the rarest words of a title find its questions.
    vocabulary = words.select("token").distinct()
    rows = named.select(path, "_t", F.explode(F.array_distinct("_t")).alias("token"))
    common = (
        rows.select("token").join(small_or_shuffled(vocabulary), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("_df"))
    )
    # At most this many words may be missing, so a match holds one of the
    # first ``missing + 1`` words in any fixed order; rare words come first.
    missing = F.size("_t") - F.ceil(F.size("_t") * F.lit(threshold) - F.lit(1e-9))
    ordered = (
        rows.join(small_or_shuffled(common), "token", "left")
        .groupBy(path).agg(
            F.first("_t").alias("_t"),
            # the words of one title
            F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "token"))).alias("_w"),
        )
    )
    keys = ordered.select(path, "_t", F.explode(F.slice("_w", F.lit(1), (missing + 1).cast("int"))).alias("_k")).where("_k.df > 0")
    candidates = keys.select(path, "_t", F.col("_k.token").alias("token")).join(small_or_shuffled(words), "token")
    held = F.size(F.filter("_t", lambda t: F.array_contains("_q", t)))
    covered = (
        candidates.join(small_or_shuffled(asked), "query_id")
        .select("query_id", path, (held / F.size("_t")).alias("coverage"))
        .where(F.col("coverage") >= threshold)
        .distinct()
    )
    return top_per_query(covered, limit, [F.desc("coverage"), F.asc(path)]).select("query_id", "rank", path, "coverage")


def stem_match(queries: DataFrame, docs: DataFrame, path: str = "path") -> DataFrame:
    """(query_id, pos, path): files whose stem is one of the question's terms."""
    terms = (
        queries.select("query_id", F.posexplode(salient_terms(F.col("text"))).alias("pos", "_w"))
        .groupBy("query_id", F.lower("_w").alias("_stem"))
        .agg(F.min("pos").alias("pos"))
    )
    files = docs.select(path, F.lower(paths.stem(F.col(path))).alias("_stem"))
    return files.join(small_or_shuffled(terms), "_stem").select("query_id", "pos", path)


def phrase_match(
    queries: DataFrame, docs: DataFrame, size: int = fv.PHRASE_WORDS, key: str = "id", content: str = "content"
) -> DataFrame:
    return phrase_pairs(queries, docs, size, key, content)


PIN_SOURCES = ("stem", "title", "token", "phrase")


def rank_pins(pins: DataFrame) -> DataFrame:
    """One pin per question and path; stem beats title beats token beats phrase.

    ``pins`` holds query_id, path, source and the rank within its source.
    """
    order = F.create_map(*[x for i, s in enumerate(PIN_SOURCES) for x in (F.lit(s), F.lit(i))])
    best = pins.groupBy("query_id", "path").agg(
        F.min(F.struct(order[F.col("source")].alias("_s"), "rank", "source")).alias("_b")
    )
    return best.select("query_id", "path", F.col("_b.source").alias("source"), F.col("_b._s").alias("_s"), F.col("_b.rank").alias("_r"))


def _order(group: Column, source: Column, rank: Column) -> Column:
    return F.struct(group.alias("group"), source.alias("source"), rank.cast("long").alias("rank"))


def union_pins(pinned: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Pinned documents first, then retrieved ones, each path once per question."""
    lead = pinned.select("query_id", "path", _order(F.lit(0), F.col("_s"), F.col("_r")).alias("_o"), F.lit(True).alias("pinned"))
    rest = retrieved.select(
        "query_id", "path", _order(F.lit(1), F.lit(0), F.col("rank")).alias("_o"), F.lit(False).alias("pinned")
    )
    return (
        lead.unionByName(rest)
        .groupBy("query_id", "path")
        .agg(F.min("_o").alias("_o"), F.max("pinned").alias("pinned"))
    )


def chunk_with_parent(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their parent document's path and title."""
    return chunks.join(docs.select("doc_id", "path", "title"), "doc_id")


def orphan_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("doc_id"), "doc_id", "left_anti")
