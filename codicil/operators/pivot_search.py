"""Exact nearest vectors by cosine without comparing all pairs.

Unit vectors are dealt to the nearest of a few pivots and, within that cell, to rings by
their distance to it; rings of more than ``BLOCK`` vectors are dealt to several blocks.  By the
triangle inequality the distances of a query to the pivots bound how near any vector
of a ring can be.  Each query first visits its most promising blocks; the ``limit``-th
score found there is a floor, and of all other blocks only those are visited whose bound
reaches it.  A block meets its queries in groups of bounded size, so neither a
crowded cell nor a cell that very many queries visit has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators.scoring import SCORE_DIGITS, unit
from codicil.session import materialise

PIVOTS = 64
RING = 0.05  # of distance
BLOCK = 2048
GROUP = 1024  # queries that meet a block at once
FIRST_BLOCKS = 2

_NO_CELL = -1  # of zero vectors, whose score is 0 for every query
_ROUNDING = 2 * 10.0**-SCORE_DIGITS


@dataclass(frozen=True)
class PivotIndex:
    """Vectors by block, the blocks' distances to their pivots, and the pivots themselves."""

    rows: DataFrame  # block, key, vector
    blocks: DataFrame  # block, cell, low, high, vectors
    pivots: np.ndarray
    key: str


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _distances(own: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * own @ pivots.T, 0.0))


def build_pivots(vectors: DataFrame, key: str = "id", vector: str = "vector", pivots: int = PIVOTS) -> PivotIndex:
    """Deals the rows of ``vectors`` to blocks; rows without a vector are left out.

    The pivots are ``pivots`` vectors picked by a hash of their keys; which ones they are changes the
    work, never a result.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    some = rows.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("key"), "key").limit(pivots).collect()  # a fixed number
    centres = unit(np.array([r["vector"] for r in some], float)) if some else np.empty((0, 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unit(_matrix(batch.column(1)))
            cell, distance = np.full(batch.num_rows, _NO_CELL, np.int32), np.zeros(batch.num_rows)
            real = own.any(axis=1) if own.size else np.zeros(batch.num_rows, bool)
            if real.any():
                found = _distances(own[real], centres)
                cell[real], distance[real] = found.argmin(axis=1), found.min(axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(cell), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "vector", "cell", "distance"])

    kind = rows.schema["key"].dataType.simpleString()
    dealt = materialise(rows.mapInArrow(deal, f"key {kind}, vector array<double>, cell int, distance double"), "cells")
    ring = F.floor(F.col("distance") / RING).cast("int")
    sizes = dealt.groupBy("cell", ring.alias("ring")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("shards"))
    dealt = dealt.withColumn("ring", ring).join(sizes, ["cell", "ring"])
    name = F.concat_ws("/", "cell", "ring", F.pmod(F.xxhash64("key"), F.col("shards")))
    dealt = materialise(dealt.select(name.alias("block"), "key", "vector", "cell", "distance"), "vector-blocks")
    blocks = dealt.groupBy("block", "cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("vectors"))
    return PivotIndex(dealt.select("block", "key", "vector"), materialise(blocks, "block-bounds"), centres, key)


def _bounds(queries: DataFrame, index: PivotIndex) -> DataFrame:
    """``query_id, block, vectors, bound``: the best score that each block could give each query."""
    pivots = index.pivots

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unit(_matrix(batch.column(1)))
            n = len(pivots)
            away = _distances(own, pivots) if n and own.size else np.zeros((batch.num_rows, n))
            away[~own.any(axis=1)] = np.nan  # a zero vector scores 0 everywhere
            cells = np.tile(np.arange(-1, n, dtype=np.int32), batch.num_rows)
            away = np.concatenate([np.full((batch.num_rows, 1), np.nan), away], axis=1)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n + 1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cells), pa.array(away.ravel(), from_pandas=True)], names=["query_id", "cell", "away"])

    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    away = asked.mapInArrow(reach, f"query_id {kind}, cell int, away double")
    gap = F.greatest(F.lit(0.0), F.col("away") - F.col("high"), F.col("low") - F.col("away"))
    bound = F.when(F.col("away").isNull(), F.lit(0.0)).otherwise(F.lit(1.0) - gap * gap / 2)
    return away.join(index.blocks, "cell").select("query_id", "block", "vectors", bound.alias("bound"))


def _compared(wanted: DataFrame, queries: DataFrame, index: PivotIndex, limit: int) -> DataFrame:
    """``query_id, key, score``: the best ``limit`` of each wanted (query and block)."""
    groups = wanted.groupBy("block").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("groups"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    own = wanted.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
    own = own.select("query_id", "block", "group").join(asked, "query_id").select("block", "group", "query_id", "vector")
    rows = index.rows.join(groups, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "key", "vector")
    kinds = queries.schema["query_id"].dataType.simpleString(), index.rows.schema["key"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, key {kinds[1]}, score double"

    def compare(asked: pa.Table, stored: pa.Table) -> pa.Table:
        names = ["query_id", "key", "score"]
        if not asked.num_rows or not stored.num_rows:
            return pa.Table.from_arrays([asked.column("query_id").slice(0, 0), stored.column("key").slice(0, 0), pa.array([], pa.float64())], names=names)
        stored = stored.sort_by("key")
        score = np.round(unit(_matrix(asked.column("vector").combine_chunks())) @ unit(_matrix(stored.column("vector").combine_chunks())).T, SCORE_DIGITS) + 0.0
        best = np.argsort(-score, axis=1, kind="stable")[:, :limit]  # ties in the order of keys
        query = np.repeat(np.arange(len(score)), best.shape[1])
        taken = pa.array(best.ravel())
        return pa.Table.from_arrays([asked.column("query_id").take(pa.array(query)), stored.column("key").take(taken), pa.array(score[query, best.ravel()])], names=names)

    return own.groupBy("block", "group").cogroup(rows.groupBy("block", "group")).applyInArrow(compare, schema)


def _visits(queries: DataFrame, index: PivotIndex, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the first visits, the first visits, and the further ones."""
    bounds = materialise(_bounds(queries, index), "query-bounds")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("vectors"), "block")
    first = bounds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST_BLOCKS).select("query_id", "block", "vectors")
    scored = materialise(_compared(first.select("query_id", "block"), queries, index, limit), "first-visits")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = scored.withColumn("place", place).where(F.col("place") == limit).select("query_id", F.col("score").alias("floor"))
    further = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
    further = further.where(F.col("floor").isNull() | (F.col("bound") + _ROUNDING >= F.col("floor")))
    return scored, first, further.select("query_id", "block", "vectors")


def pivot_top_k(queries: DataFrame, index: PivotIndex, limit: int = 10, min_score: float | None = None) -> DataFrame:
    """``query_id, rank, <key>, score``: the same as ``vector_top_k`` on the indexed vectors.

    Queries without a vector get no row; a zero vector, asked or stored, scores 0.
    """
    scored, _, further = _visits(queries, index, limit)
    everything = scored.unionByName(_compared(further.select("query_id", "block"), queries, index, limit))
    if min_score is not None:
        everything = everything.where(F.col("score") >= min_score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return everything.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", F.col("key").alias(index.key), "score")


def compared_pairs(queries: DataFrame, index: PivotIndex, limit: int = 10) -> DataFrame:
    """``pairs, compared``: all pairs of queries and vectors, and those that a search multiplies."""
    _, first, further = _visits(queries, index, limit)
    seen = first.select("vectors").unionByName(further.select("vectors")).agg(F.coalesce(F.sum("vectors"), F.lit(0)).alias("compared"))
    total = index.blocks.agg(F.coalesce(F.sum("vectors"), F.lit(0)).alias("stored"))
    asked = queries.where("vector is not null").agg(F.count("*").alias("asked"))
    return asked.join(total, F.lit(True)).join(seen, F.lit(True)).select((F.col("asked") * F.col("stored")).alias("pairs"), "compared")  # one row each
