"""Connected components of a link table by alternating stars.

Every step is a grouped minimum (combined before the shuffle) and a join, so a
node with very many links is neither gathered in one task nor sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.shared import stage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least of the node's neighbourhood."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each neighbour below a node, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Links -> ``(node, component)``: the least node reachable, for every node that has a link.

    Nodes may be of any type with an order.  Links to itself, repeated links and
    links with a null end add nothing; without links the result has no rows.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = stage(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "links")
    before = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = stage(_small_star(_large_star(edges)), "stars")
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
