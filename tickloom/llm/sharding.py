"""Sharding by extendible hashing.

A row's key is hashed to 60 bits.  A bucket is a hash prefix; the directory
starts with one bucket of no bits, and a bucket over the byte limit, and only
such a bucket, is split on the next bit until every shard fits.

All sizes come from grouped sums: rows are summed by cell, a prefix of some
bits more than the directory is expected to need, and the cells are summed
again for every shorter prefix.  A bucket's depth is the first one at which its
sum fits.  Cells that are still too large are summed again by further bits, in
rounds that touch only their rows.  Nothing but the total size reaches the
driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

BITS = 60
STEP = 8  # bits of a further round
SHARD_BYTES = 1 << 20


def hashed(key: Column) -> Column:
    """The first 60 bits of the key's MD5 sum; a null key is an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth) -> Column:
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes, n): the shallowest fitting bucket of each cell, null where none fits at ``high``."""
    deep = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    deep = deep.withColumn("prefix", F.call_function("shiftright", "cell", (F.lit(high) - F.col("depth")).cast("int")))
    sums = deep.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    # one row cannot be split, nor rows whose whole hashes agree
    fits = sums.where((F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == BITS))
    best = (
        deep.select("cell", "depth", "prefix")
        .join(fits, ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "bytes", "n")).alias("leaf"))
    )
    return cells.select("cell").join(best, "cell", "left").select("cell", "leaf.depth", F.col("leaf.bytes").alias("shard_bytes"))


def assign(docs: DataFrame, key: str = "doc_id", limit: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, oversized), one row for each row of ``docs`` (key, text).

    ``shard`` is the bucket's hash prefix in binary digits, empty if one bucket
    holds all; n_bytes counts the text's UTF-8 bytes, none for null.  A shard
    is larger than the limit (oversized) only if it holds one row, or rows of
    one hash, as repeated keys are.  An empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        hashed(F.col(f"`{key}`")).alias("bits"),
    )
    rows = cut_lineage(rows)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done = None
    left, low, high = rows, 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 3)
    while True:
        cells = left.groupBy(_prefix(F.col("bits"), F.lit(high)).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")
        )
        leaves = cut_lineage(_leaves(cells, low, high, limit))
        placed = left.withColumn("cell", _prefix(F.col("bits"), F.lit(high))).join(leaves, "cell")
        ready = placed.where("depth IS NOT NULL").select("key", "n_bytes", "bits", "depth", "shard_bytes")
        done = ready if done is None else done.union(ready)
        if high == BITS or leaves.where("depth IS NULL").isEmpty():
            break
        left = cut_lineage(placed.where("depth IS NULL").select("key", "n_bytes", "bits"))
        low, high = high + 1, min(BITS, high + STEP)
    digits = F.lpad(F.conv(F.col("bits").cast("string"), 10, 2), BITS, "0")
    return done.select(
        F.col("key").alias(key),
        "n_bytes",
        F.substring(digits, F.lit(1), F.col("depth")).alias("shard"),
        F.col("depth").cast("long").alias("depth"),
        "shard_bytes",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def directory(assigned: DataFrame) -> DataFrame:
    """(shard, depth, first_slot, last_slot, shard_bytes, n_rows): the slots of the directory that point to each shard.

    The directory has 2^g slots, g being the largest depth; a shard of depth d
    owns the 2^(g-d) slots that start with its prefix.
    """
    shards = assigned.groupBy("shard", "depth").agg(F.max("shard_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("n_rows"))
    depth = assigned.agg(F.max("depth").alias("g"))
    number = F.coalesce(F.conv(F.nullif(F.col("shard"), F.lit("")), 2, 10).cast("long"), F.lit(0))
    width = (F.col("g") - F.col("depth")).cast("int")
    first = F.call_function("shiftleft", number, width)
    return shards.crossJoin(F.broadcast(depth)).select(
        "shard", "depth", first.alias("first_slot"),
        (first + F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1).alias("last_slot"), "shard_bytes", "n_rows",
    )


def write(docs: DataFrame, path: str, key: str = "doc_id", limit: int = SHARD_BYTES) -> None:
    """Write the rows of ``docs`` as Parquet, one folder a shard.

    Rows of one key are of one hash and so of one shard; a null key is a key as
    any other.
    """
    shards = assign(docs, key, limit).select(F.col(key).alias("_key"), F.concat(F.lit("s"), "shard").alias("shard")).distinct()
    base = docs.drop("shard", "_key")
    placed = base.join(shards, base[key].eqNullSafe(shards["_key"])).drop("_key")
    placed.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


ORACLE_SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS bits
  FROM documents),
s AS (
  SELECT d AS depth, bits >> ({BITS} - d) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n
  FROM r, range(0, {BITS + 1}) t(d) GROUP BY 1, 2),
f AS (SELECT * FROM s WHERE shard_bytes <= {SHARD_BYTES} OR n = 1 OR depth = {BITS}),
l AS (
  SELECT r.doc_id, r.n_bytes, r.bits, f.depth, f.shard_bytes,
         row_number() OVER (PARTITION BY r.bits, r.doc_id ORDER BY f.depth) AS k
  FROM r JOIN f ON f.prefix = r.bits >> ({BITS} - f.depth))
SELECT doc_id, n_bytes, substr(right(bin(bits + (CAST(1 AS BIGINT) << {BITS})), {BITS}), 1, CAST(depth AS INTEGER)) AS shard,
       CAST(depth AS BIGINT) AS depth, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversized
FROM l WHERE k = 1
"""
