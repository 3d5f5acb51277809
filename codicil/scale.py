"""Size checks and skew helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a side input (queries, patterns, roots) that may be replicated to
# every executor.  Larger inputs take the shuffled form of the same join.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if the size check allows, else untouched.

    Left untouched, the join is an ordinary shuffled equi-join whose hot
    partitions are split by adaptive skew handling.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


FEW_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """A table of very few splits dealt out to the cores; larger tables as they are.

    A small file with one row group would otherwise run its text work in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


def keep_first(df: DataFrame, keys: list[str], order: list[Column], row_id: list[str]) -> DataFrame:
    """The first row of each key in ``order``, safe for very hot keys.

    The winner of each key is found with a partially aggregated minimum, so a
    key holding a third of the table is reduced before the shuffle; the full
    rows are then picked by their unique id, which spreads evenly.  ``order``
    columns must make the order total together with ``row_id``.
    """
    best = F.min(F.struct(*order, *[F.col(c).alias(f"_id{i}") for i, c in enumerate(row_id)]))
    winners = (
        df.groupBy(*keys)
        .agg(best.alias("_best"))
        .select(*[F.col(f"_best._id{i}").alias(c) for i, c in enumerate(row_id)])
    )
    return df.join(winners, row_id, "left_semi")


def winners(df: DataFrame, keys: list[str], highest: list[Column]) -> DataFrame:
    """One row of each key: the highest in ``highest``, ties by a hash of the whole row.

    A single aggregate, combined before the shuffle, so repeated and equal rows of a
    very hot key leave exactly one row.  Rows equal in every column are the same row.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*highest, F.xxhash64(*df.columns), *[F.col(c).cast("string") for c in rest])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col("_best").getField(c).alias(c) for c in rest]).select(*df.columns)
