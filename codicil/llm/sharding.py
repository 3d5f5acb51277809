"""Sharding by extendible hashing.

A document's bits are those of a hash of its id.  A bucket is a prefix of these bits;
only a bucket over the byte limit splits on its next bit.  The directory is worked out
from byte counts of prefixes, ``STEP`` bits beyond the present depth at a time and only
for what is still too large, so a round reads only rows of oversized buckets.

Bits cannot part rows of equal ids: a bucket of one hash value over the limit is dealt
out by running sums of bytes (``part``); a single document over the limit is alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.shared import stage

BITS = 48
STEP = 12


def key_bits(key: Column) -> Column:
    """The first 48 bits of the MD5 of the key's text, as a string of 0 and 1."""
    number = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 2)
    return F.lpad(number, BITS, "0")


def _settled(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each prefix of ``high`` bits the least depth, from ``low``, at which its bucket fits; null if none."""
    depths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    depths = depths.withColumn("prefix", F.substring("cell", F.lit(1), F.col("depth")))
    sums = depths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"))
    fits = depths.join(sums.where(F.col("total") <= limit), ["depth", "prefix"], "left")
    return fits.groupBy("cell").agg(F.min(F.when(F.col("total").isNotNull(), F.col("depth"))).alias("depth"))


def shard(documents: DataFrame, byte_limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``id, n_bytes, shard_id, depth``; all rows of a shard hold ``byte_limit`` bytes at most.

    ``shard_id`` is the bucket's bits, followed by ``-part`` where one hash value alone
    is too large.  A single text over the limit has a part of its own.  A null text has
    0 bytes, a null id hashes as the empty string.  An empty table gives no rows.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.octet_length(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).cast("long").alias("n_bytes"))
    rest, done, low = rows.withColumn("bits", key_bits(F.col("id"))), [], 0
    while low < BITS:
        high = min(BITS, low + STEP)
        cells = rest.groupBy(F.substring("bits", 1, high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        directory = stage(_settled(cells, low, high, byte_limit), "directory")
        placed = rest.withColumn("cell", F.substring("bits", 1, high)).join(directory, "cell")
        done.append(placed.where("depth is not null").select("id", "n_bytes", F.substring("bits", F.lit(1), F.col("depth")).alias("bucket"), "depth", F.lit(0).cast("long").alias("part")))
        if not directory.where("depth is null").limit(1).count():
            rest = None
            break
        rest = stage(placed.where("depth is null").select("id", "n_bytes", "bits"), "oversized")
        low = high + 1 if high < BITS else BITS
    if rest is not None:
        done.append(_dealt(rest, byte_limit))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    shard_id = F.when(F.col("part") > 0, F.concat("bucket", F.lit("-"), F.col("part").cast("string"))).otherwise(F.col("bucket"))
    return out.select("id", "n_bytes", shard_id.alias("shard_id"), "depth")


GROUPS = 4_096


def _dealt(rows: DataFrame, byte_limit: int) -> DataFrame:
    """Rows whose hash value alone is over the limit, in parts from 1.

    Rows go to ``GROUPS`` groups of a bucket at random but repeatably; within a group
    each part is closed before half the limit is passed twice over, so no part exceeds it.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "n_bytes", F.monotonically_increasing_id()), F.lit(GROUPS)))
    salted = stage(salted, "salted")
    one = Window.partitionBy("bits", "salt").orderBy("n_bytes", "id")
    half = F.lit(byte_limit // 2)
    small = F.col("n_bytes") <= half
    running = F.sum(F.when(small, F.col("n_bytes")).otherwise(F.lit(0))).over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    alone = F.sum(F.when(small, 0).otherwise(1)).over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.when(small, F.floor((running - F.col("n_bytes")) / F.greatest(half, F.lit(1)))).otherwise(F.lit(1 << 31) + alone)
    return salted.select("id", "n_bytes", F.col("bits").alias("bucket"), F.lit(BITS).alias("depth"), (number * GROUPS + F.col("salt") + 1).cast("long").alias("part"))


def write_shards(documents: DataFrame, folder: str, byte_limit: int, id_column: str = "doc_id", text_column: str = "text", shard_column: str = "shard_id") -> None:
    """Writes the rows of ``documents`` as Parquet, one folder ``<shard_column>=...`` a shard.

    Rows must have distinct ids.  ``shard_column`` must not be a column of ``documents``.
    """
    if shard_column in documents.columns:
        raise ValueError(f"documents have a column {shard_column}; name another for the shard")
    where = shard(documents, byte_limit, id_column, text_column).select("id", "shard_id")
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    joined = documents.toDF(*names.values()).join(where, F.col(names[id_column]).eqNullSafe(F.col("id"))).drop("id")
    joined = joined.repartition("shard_id").toDF(*documents.columns, shard_column)
    joined.write.partitionBy(shard_column).parquet(folder)
