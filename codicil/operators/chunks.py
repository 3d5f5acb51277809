"""Chunking documents into overlapping, sentence-aware pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions.text import is_blank, normalize_text, strip
from codicil.sources.sinks import replace_chunks

PIECES = "array<struct<content: string, offset_start: int, offset_end: int>>"


def _cut_before(text: str, start: int, end: int, window: int) -> int:
    """Best end for a chunk: the last strong break in the tail of the window."""
    low = max(end - window, start)
    tail = text[low:end]
    tiers = (("\n\n",), *((s,) for s in fv.SENTENCE_BREAKS), ("\n",), *((c,) for c in fv.CLAUSE_BREAKS), (" ",))
    for (mark,) in tiers:
        at = tail.rfind(mark)
        if at > 0:
            return low + at + len(mark)
    return end


def _pieces(text: str, size: int, overlap: int, least: int, most: int) -> list[tuple[str, int, int]]:
    if len(text) <= size:
        return [(text, 0, len(text))]
    out: list[tuple[str, int, int]] = []
    at = 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            end = _cut_before(text, at, end, int(size * 0.2))
        body = text[at:end].strip()
        if body:
            joined = f"{out[-1][0]} {body}" if out and len(body) < least else ""
            if joined and len(joined) <= most:
                out[-1] = (joined, out[-1][1], end)
            else:
                out.append((body, at, end))
        if end >= len(text):
            return out
        # Step back by the overlap unless that would not move past the last chunk.
        previous = out[-1][1] if out else 0
        at = end - overlap if end - overlap > previous else end


def chunk_pieces(
    chunk_tokens: int = fv.CHUNK_TOKENS,
    overlap_tokens: int = fv.CHUNK_OVERLAP_TOKENS,
    min_tokens: int = fv.CHUNK_MIN_TOKENS,
    max_tokens: int = fv.CHUNK_MAX_TOKENS,
):
    """Arrow UDF: normalised text -> its chunks with offsets."""
    k = fv.CHUNK_CHARS_PER_TOKEN
    limits = (chunk_tokens * k, overlap_tokens * k, min_tokens * k, max_tokens * k)

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("content", "offset_start", "offset_end")
        for texts in batches:
            yield texts.map(lambda t: [dict(zip(names, p)) for p in _pieces(t, *limits)], na_action="ignore")

    return cut


def chunk_documents(docs: DataFrame, key: str = "doc_id", content: str = "content", keep: tuple[str, ...] = (), **sizes) -> DataFrame:
    """One row per chunk: chunk_id, key, content, position, total and offsets.

    Documents are independent, so no shuffle is needed; texts that fit one
    chunk never leave the JVM.  Offsets index the normalised text.
    """
    size = sizes.get("chunk_tokens", fv.CHUNK_TOKENS) * fv.CHUNK_CHARS_PER_TOKEN
    text = docs.where(~is_blank(F.col(content))).select(key, *keep, normalize_text(F.col(content)).alias("_text"))
    fits = F.length("_text") <= size
    whole = F.array(
        F.struct(F.col("_text").alias("content"), F.lit(0).alias("offset_start"), F.length("_text").alias("offset_end"))
    )
    pieces = F.coalesce(chunk_pieces(**sizes)(F.when(~fits, F.col("_text"))), whole)
    rows = text.select(key, *keep, pieces.alias("_pieces")).select(
        key, *keep, F.size("_pieces").alias("total_chunks"), F.posexplode("_pieces").alias("chunk_index", "_p")
    )
    return with_chunk_ids(
        rows.select(key, *keep, "chunk_index", "total_chunks", "_p.content", "_p.offset_start", "_p.offset_end"), key
    )


def with_chunk_ids(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.withColumn(
        "chunk_id", F.concat_ws("_", F.col(key).cast("string"), F.lpad(F.col("chunk_index").cast("string"), 5, "0"))
    )


def fixed_windows(docs: DataFrame, key: str = "doc_id", content: str = "content",
                  chunk_tokens: int = fv.CHUNK_TOKENS, overlap_tokens: int = fv.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """Plain overlapping windows of the normalised text, in JVM expressions only."""
    size, overlap = chunk_tokens * fv.CHUNK_CHARS_PER_TOKEN, overlap_tokens * fv.CHUNK_CHARS_PER_TOKEN
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("_text") - overlap) / F.lit(step))).cast("int")
    text = docs.where(~is_blank(F.col(content))).select(key, normalize_text(F.col(content)).alias("_text"))
    rows = text.select(key, "_text", n.alias("total_chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return with_chunk_ids(
        rows.select(
            key, "chunk_index", "total_chunks",
            F.substring("_text", start + 1, F.lit(size)).alias("content"),
            start.alias("offset_start"),
            F.least(start + size, F.length("_text")).alias("offset_end"),
        ),
        key,
    )


def chunk_counts(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))


def rechunk(docs: DataFrame, chunks: DataFrame, min_chars: int = 100) -> DataFrame:
    """Chunks after re-cutting every stored document of at least ``min_chars``."""
    wanted = docs.where(F.length(strip(F.coalesce("content", F.lit("")))) >= min_chars)
    fresh = chunk_documents(wanted).select(*chunks.columns)
    return replace_chunks(chunks, wanted.select("doc_id"), fresh)
