"""Exact quantiles of groups of any size, by counting in shrinking ranges of values.

A round cuts the range that holds a wanted rank into ``BINS`` equal parts and counts the
values in each (combined before the shuffle, so a group sends at most ``BINS`` rows from
a task); the part that holds the rank, shrunk to the values found in it, is the next
range.  A range of one value is the answer.  Each round narrows a range at least to a
``BINS``-th, so a few rounds end every group, and no group is ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.session import materialise

BINS = 1024
MAX_ROUNDS = 40


def exact_quantile(rows: DataFrame, group: str, value: str, share: float = 0.5, bins: int = BINS) -> DataFrame:
    """``<group>, quantile``: the value at rank ``(n - 1) * share``, half-way ranks interpolated.

    Null and NaN values are left out, and groups without others have no row; a null group is a group.
    """
    own = materialise(rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"), "values")
    sizes = own.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = (F.col("n") - 1) * F.lit(share)
    targets = sizes.withColumn("k", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))).select("g", "k", F.lit(0).cast("long").alias("below"), "low", "high", place.alias("place"))
    targets = materialise(targets, "ranks")
    for _ in range(MAX_ROUNDS):
        if targets.where("low < high").isEmpty():
            break
        wanted = targets.where("low < high").withColumnRenamed("g", "_g")
        inside = own.join(wanted, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("low"), F.col("high")))
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        parts = inside.groupBy("g", "k", "below", "place", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = Window.partitionBy("g", "k").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # at most `bins` rows
        parts = parts.withColumn("upto", F.col("below") + F.sum("n").over(order))
        found = parts.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        found = found.select("g", "k", (F.col("upto") - F.col("n")).alias("below"), "low", "high", "place")
        targets = materialise(targets.where("low >= high").unionByName(found), "ranks")
    else:
        raise RuntimeError(f"quantiles not settled after {MAX_ROUNDS} rounds")
    ends = targets.groupBy("g").agg(F.min_by("low", "k").alias("a"), F.max_by("low", "k").alias("b"), F.first("place").alias("place"))
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
    return ends.select(F.col("g").alias(group), between.alias("quantile"))
