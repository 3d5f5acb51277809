"""Scores of a block of queries against every document, one Arrow batch at a time.

A batch of documents is tokenised and scored inside its map task, which keeps its best
rows per query while it runs and passes them on at its end.  So ranking shuffles no
text, no postings and no query-document pairs: just ``limit`` rows per query and task.
Both sides are lower-cased by the same JVM function before they are split into words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codicil.functions.text import tokens
from codicil.scale import is_small

K1, B = 1.2, 0.75
SCORE_DIGITS = 6
TOKEN_BREAK = r"[^\p{L}\p{N}_]+"
# Queries taken to the tasks at once, and matrix cells worked on at once.
BLOCK_QUERIES = 20_000
GROUP_QUERIES = 256
CELLS = 4_000_000


@dataclass
class Block:
    """A bounded set of queries: their ids, terms, vectors, and corpus statistics."""

    ids: pa.Array
    terms: list[list[str]]
    vectors: np.ndarray | None = None
    vocabulary: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    mean_length: float = 1.0

    def groups(self):
        """(first, last, term columns, membership) of a few hundred queries each."""
        position = {t: i for i, t in enumerate(self.vocabulary)}
        for first in range(0, len(self.ids), GROUP_QUERIES):
            last = min(first + GROUP_QUERIES, len(self.ids))
            used = sorted({position[t] for ts in self.terms[first:last] for t in ts if t in position})
            local = {p: i for i, p in enumerate(used)}
            member = np.zeros((len(used), last - first))
            for q, ts in enumerate(self.terms[first:last]):
                for t in ts:
                    if t in position:
                        member[local[position[t]], q] = 1.0
            column = np.full(len(self.vocabulary), -1)
            column[used] = np.arange(len(used))
            yield first, last, column, member


def query_blocks(queries: DataFrame, lexical: bool, vector: str | None) -> Iterator[Block]:
    """The queries in blocks of bounded size, split by hash when there are many."""
    n_blocks = 1 if is_small(queries, BLOCK_QUERIES) else -(-2 * queries.count() // BLOCK_QUERIES)
    wanted = queries.select(
        "query_id",
        F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("terms") if lexical else F.array().cast("array<string>").alias("terms"),
        *([F.col(vector).alias("vector")] if vector else []),
    )
    for i in range(n_blocks):
        rows = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).collect()
        if rows:
            yield Block(
                ids=pa.array([r["query_id"] for r in rows], to_arrow_type(queries.schema["query_id"].dataType)), terms=[list(r["terms"]) for r in rows],
                vectors=unit(np.array([r["vector"] for r in rows], dtype=float)) if vector else None,
                vocabulary=sorted({t for r in rows for t in r["terms"]}),
            )


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return rows / norms


def _term_counts(texts: pa.Array, vocabulary: pa.Array):
    """(document lengths, document numbers, term numbers, counts) of a batch of lower-cased texts."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), pattern=TOKEN_BREAK)
    flat = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    lengths = np.bincount(rows[real], minlength=len(texts))
    found = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    hit = found >= 0
    size = max(len(vocabulary), 1)
    codes, counts = np.unique(rows[hit] * size + found[hit], return_counts=True)
    return lengths, codes // size, codes % size, counts


def add_statistics(block: Block, docs: DataFrame, content: str) -> None:
    """Fill in rarity and mean length: one scan that returns a row per query term."""
    vocabulary = block.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        total = np.zeros(len(vocabulary) + 2, dtype=np.int64)
        for batch in batches:
            lengths, _, terms, _ = _term_counts(batch.column(0), known)
            total[:-2] += np.bincount(terms, minlength=len(vocabulary))
            total[-2:] += (len(lengths), lengths.sum())
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["term", "n"])

    rows = docs.select(F.lower(content).alias(content)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(vocabulary) + 2)
    for row in rows:
        found[row["term"]] = row["n"]
    n_docs, length = found[-2:]
    block.idf = np.log(1 + (n_docs - found[:-2] + 0.5) / (found[:-2] + 0.5))
    block.mean_length = length / n_docs if n_docs else 1.0


def _lexical(block: Block, column, member, counted, n: int):
    """(scores, matched) of a group of queries; matched is 0 where no term is shared."""
    lengths, rows, terms, counts = counted
    weight = np.zeros((n, member.shape[0]))
    local = column[terms]
    use = local >= 0
    r, t, tf = rows[use], terms[use], counts[use]
    norm = K1 * (1 - B + B * lengths[r] / block.mean_length)
    weight[r, local[use]] = block.idf[t] * tf * (K1 + 1) / (tf + norm)
    present = np.zeros_like(weight)
    present[r, local[use]] = 1.0
    return np.round(weight @ member, SCORE_DIGITS), present @ member


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, present) of a batch; a missing vector is a zero row."""
    present = pc.is_valid(column).to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), size))
    out[present] = unit(flat.reshape(-1, size))
    return out, present


def _pieces(batch: pa.RecordBatch, block: Block) -> Iterator[pa.RecordBatch]:
    widest = max(GROUP_QUERIES, min(len(block.vocabulary), 40 * GROUP_QUERIES))
    step = max(1, CELLS // widest)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _scored(batches: Iterator[pa.RecordBatch], block: Block, content: bool, vector: bool):
    """(keys, first query, lexical, matched, semantic, present) of each piece and query group."""
    groups = list(block.groups())
    known = pa.array(block.vocabulary, pa.string())
    for batch in batches:
        for piece in _pieces(batch, block):
            n = piece.num_rows
            counted = _term_counts(piece.column(1), known) if content else None
            held, present = _vectors(piece.column(piece.num_columns - 1), block.vectors.shape[1]) if vector else (None, None)
            for first, last, column, member in groups:
                lex = matched = sem = None
                if content:
                    lex, matched = _lexical(block, column, member, counted, n)
                if vector:
                    sem = np.round(held @ block.vectors[first:last].T, SCORE_DIGITS) + 0.0
                yield piece.column(0), first, lex, matched, sem, present


def _best(score: np.ndarray, valid: np.ndarray, limit: int | None):
    """(document, query) cells worth passing on: valid, and not below the batch's ``limit``-th."""
    if limit is not None and limit < score.shape[0]:
        shown = np.where(valid, score, -np.inf)
        # Ties at the cut stay in, so the final ranking sees every contender.
        cut = -np.partition(-shown, limit - 1, axis=0)[limit - 1]
        valid = valid & (shown >= cut)
    return np.nonzero(valid)


class _Best:
    """The best ``limit`` rows per query of one task, ties in the order of their keys."""

    KEPT = 200_000

    def __init__(self, names: list[str], limit: int | None) -> None:
        self.names, self.limit, self.parts, self.rows = names, limit, [], 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.limit is None:
            yield _renamed(batch, self.names)
            return
        self.parts.append(_renamed(batch, self.names))
        self.rows += batch.num_rows
        if self.rows > self.KEPT:
            self._cut()
            if self.rows > self.KEPT // 2:  # many queries: cut again only when that pays
                self.KEPT = 2 * self.rows

    def _cut(self) -> None:
        table = pa.Table.from_batches(self.parts)
        query, key = self.names[0], self.names[1]
        order = pc.sort_indices(table, sort_keys=[(query, "ascending"), ("score", "descending"), (key, "ascending")], null_placement="at_start")
        table = table.take(order).combine_chunks()
        ids = table[query].combine_chunks()
        heads = np.append(0, 1 + np.flatnonzero(pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))), False).to_numpy(zero_copy_only=False)))
        place = np.arange(len(ids)) - np.repeat(heads, np.diff(np.append(heads, len(ids))))
        taken = np.flatnonzero(place < self.limit)
        self.parts = table.take(pa.array(taken)).combine_chunks().to_batches()
        self.rows = len(taken)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._cut()
            yield from self.parts


def _types(queries: DataFrame, docs: DataFrame, key: str) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(docs.dtypes)[key]}"


def _rows(keys: pa.Array, ids: pa.Array, first: int, docs, queries, *values) -> pa.RecordBatch:
    columns = [ids.take(pa.array(queries + first)), keys.take(pa.array(docs)), *map(pa.array, values)]
    return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def _renamed(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns, names)


def _union(parts: list[DataFrame], docs: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lexical_scores(queries: DataFrame, docs: DataFrame, key: str, content: str, limit: int | None = None) -> DataFrame:
    """(query_id, key, score, matched): BM25 of documents sharing a term with a query."""
    names = ["query_id", key, "score", "matched"]
    schema = _types(queries, docs, key) + ", score double, matched long"
    parts = []
    for block in query_blocks(queries, True, None):
        add_statistics(block, docs, content)

        def score(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            best = _Best(names, limit)
            for keys, first, lex, matched, _, _ in _scored(batches, block, True, False):
                d, q = _best(lex, matched > 0, limit)
                yield from best.add(_rows(keys, block.ids, first, d, q, lex[d, q], matched[d, q].astype(np.int64)))
            yield from best.rest()

        parts.append(docs.select(key, F.lower(content).alias(content)).mapInArrow(score, schema))
    return _union(parts, docs, schema)


def vector_scores(queries: DataFrame, docs: DataFrame, key: str, vector: str, limit: int | None = None) -> DataFrame:
    """(query_id, key, score): cosine of each query vector with each stored vector."""
    names = ["query_id", key, "score"]
    schema = _types(queries, docs, key) + ", score double"
    parts = []
    for block in query_blocks(queries, False, "vector"):

        def score(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            best = _Best(names, limit)
            for keys, first, _, _, sem, present in _scored(batches, block, False, True):
                d, q = _best(sem, np.broadcast_to(present[:, None], sem.shape), limit)
                yield from best.add(_rows(keys, block.ids, first, d, q, sem[d, q]))
            yield from best.rest()

        parts.append(docs.select(key, vector).mapInArrow(score, schema))
    return _union(parts, docs, schema)


def _leg_bounds(block: Block, docs: DataFrame, columns: list, content: bool, vector: bool) -> np.ndarray:
    """Lowest and highest score of each leg per query, shape (4, queries)."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        found = np.full((4, n), np.inf)
        for _, first, lex, matched, sem, present in _scored(batches, block, content, vector):
            for at, score, valid in ((0, lex, None if lex is None else matched > 0), (2, sem, None if sem is None else present[:, None])):
                if score is not None:
                    span = slice(first, first + score.shape[1])
                    found[at, span] = np.minimum(found[at, span], np.where(valid, score, np.inf).min(axis=0))
                    found[at + 1, span] = np.minimum(found[at + 1, span], np.where(valid, -score, np.inf).min(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n)), *map(pa.array, found)], ["q", "lex_lo", "lex_hi", "sem_lo", "sem_hi"]
        )

    merged = (
        docs.select(*columns).mapInArrow(bounds, "q long, lex_lo double, lex_hi double, sem_lo double, sem_hi double")
        .groupBy("q").agg(*[F.min(c).alias(c) for c in ("lex_lo", "lex_hi", "sem_lo", "sem_hi")]).collect()
    )
    out = np.full((4, len(block.ids)), np.inf)
    for row in merged:
        out[:, row["q"]] = row[1:]
    out[1], out[3] = -out[1], -out[3]
    return out


def _scaled(score: np.ndarray, low: np.ndarray, high: np.ndarray, valid: np.ndarray) -> np.ndarray:
    gap = np.where(high > low, high - low, 1.0)
    value = np.where(high > low, (score - low) / gap, 1.0)
    return np.where(valid, value, 0.0)


def blended_scores(
    queries: DataFrame, docs: DataFrame, key: str, content: str, vector: str, ratio: float, limit: int | None,
    min_score: float | None = None, digits: int = 4,
) -> DataFrame:
    """(query_id, key, score): min-max scaled lexical and semantic scores mixed by ``ratio``.

    The first pass finds each query's score bounds, the second scores, mixes
    and cuts; both are map-only over the corpus.
    """
    use_content, use_vector = ratio < 1.0, ratio > 0.0
    columns = [key, *([F.lower(content).alias(content)] if use_content else []), *([vector] if use_vector else [])]
    names = ["query_id", key, "score"]
    schema = _types(queries, docs, key) + ", score double"
    parts = []
    for block in query_blocks(queries, use_content, "vector" if use_vector else None):
        if use_content:
            add_statistics(block, docs, content)
        edge = _leg_bounds(block, docs, columns, use_content, use_vector)

        def mix(batches: Iterator[pa.RecordBatch], block: Block = block, edge: np.ndarray = edge) -> Iterator[pa.RecordBatch]:
            best = _Best(names, limit)
            for keys, first, lex, matched, sem, present in _scored(batches, block, use_content, use_vector):
                shape = (lex if lex is not None else sem).shape
                span = slice(first, first + shape[1])
                score, valid = np.zeros(shape), np.zeros(shape, dtype=bool)
                if lex is not None:
                    hit = matched > 0
                    score += (1 - ratio) * _scaled(lex, edge[0, span], edge[1, span], hit)
                    valid |= hit
                if sem is not None:
                    hit = np.broadcast_to(present[:, None], shape)
                    score += ratio * _scaled(sem, edge[2, span], edge[3, span], hit)
                    valid |= hit
                score = np.floor(score * 10**digits + 0.5 + 1e-9) / 10**digits
                if min_score is not None:
                    valid &= score >= min_score
                d, q = _best(score, valid, limit)
                yield from best.add(_rows(keys, block.ids, first, d, q, score[d, q]))
            yield from best.rest()

        parts.append(docs.select(*columns).mapInArrow(mix, schema))
    return _union(parts, docs, schema)
