"""Exact top-k search by inner product with MaxScore pruning.

A term is a dimension with a sign; its posting list holds the rows of a shard whose
component has that sign, and its bound is the query's weight times the largest
component in the list.  Terms are ordered by bound.  While the best ``k`` scores so far
reach further than the low-bound terms together, a row cannot enter the result through
those alone: they are not essential.  Essential postings are traversed for all rows; the
others are probed, largest bound first, only for rows that can still compete.  Best lists
of the shards are merged.

Shards and blocks of queries form a grid; each field of it is a bounded unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.shared import stage

SHARD_ROWS = 2_048
QUERY_ROWS = 1_024
SCALE = 1_024
FIRST_ROWS = 64
PROBES = 3

_FIELDS = "shard long, block long, asked boolean, vec_id long, weights array<long>"


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, weights``: floor(scale * x) of rows without null or non-finite components."""
    values = F.col("v")
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.where(usable & F.col("vec_id").isNotNull()).select("vec_id", F.transform(values, lambda x: F.floor(x * scale)).alias("weights"))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """``(query, row, score)`` of the best ``k`` rows of one shard for each query, ties to the smaller row id."""
    largest = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, x.shape[1])
    kind = np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order].astype(kind))
    high, low = x.max(0, initial=0), (-x).max(0, initial=0)  # the largest component of either sign
    for query_id, q in zip(query_ids, queries.astype(kind), strict=True):
        bounds = np.where(q > 0, q * high, -q * low)
        terms = np.argsort(bounds, kind="stable")
        sums = np.cumsum(bounds[terms])
        start = np.flatnonzero(ids != query_id)[:FIRST_ROWS]
        first = np.sort(x[start] @ q)[::-1]
        threshold = first[k - 1] if len(first) >= k else None
        split = int(np.searchsorted(sums, threshold, "left")) if threshold is not None else 0  # terms before it: not essential
        essential = terms[split:]
        score = x[:, essential] @ q[essential]
        rows = np.flatnonzero(ids != query_id)
        score = score[rows]
        rest = terms[:split]
        while len(rest) and len(rows):
            competitive = score + bounds[rest].sum() >= threshold
            rows, score = rows[competitive], score[competitive]
            step = max(1, -(-split // PROBES))
            probe, rest = rest[-step:], rest[:-step]
            score = score + x[np.ix_(rows, probe)] @ q[probe]
        if len(rows) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= cut], score[score >= cut]
        best = np.lexsort((rows, -score))[:k]  # rows are in id order
        for i in best:
            yield int(query_id), int(ids[rows[i]]), int(score[i])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row of ``queries`` against all rows of ``vectors``.

    Rows that are null, hold null or non-finite components or have no id take no part; a
    row does not answer a query of its own id.  Exact repeats of a row count once.  A
    shorter vector counts as filled up with zeros.  Fewer than ``k`` candidates give fewer
    rows; an empty table gives none.
    """
    rows = stage(quantised(vectors, id_column, vector_column).distinct(), "weights")
    asked = stage(quantised(queries, id_column, vector_column).distinct(), "queries")
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(0))).first()
    wanted, asked_width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(0))).first()
    width = max(width, asked_width)
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-wanted // QUERY_ROWS))
    mark = F.xxhash64("vec_id", "weights")
    grid = [
        rows.withColumn("shard", F.pmod(mark, F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asked", F.lit(False)),
        asked.withColumn("block", F.pmod(mark, F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asked", F.lit(True)),
    ]
    fields = [g.select(F.col("shard").cast("long"), F.col("block").cast("long"), "asked", "vec_id", "weights") for g in grid]

    def search(unit: pa.Table) -> pa.Table:
        mask = unit["asked"].to_numpy()
        ids, weights = unit["vec_id"].to_numpy(), unit["weights"].to_pylist()
        own = [_matrix([w for w, m in zip(weights, mask, strict=True) if m == side], width) for side in (False, True)]
        found = list(search_shard(ids[~mask], own[0], ids[mask], own[1], k)) if mask.any() and not mask.all() else []
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    best = fields[0].unionAll(fields[1]).groupBy("shard", "block").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
