"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage


def _mark(links: DataFrame) -> tuple:
    """Number and order-free checksum of the links."""
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Links are pairs of numbers in any order; a link with a null end or from a
    node to itself is no link.  A round is two grouped minimums with joins back;
    the number of rounds follows the logarithm of the longest chain, and no
    component is ever held by one task or by the driver.
    """
    known = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = cut_lineage(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        # large star: every larger neighbour of u is linked to the least around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        rest = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut_lineage(least.select("u", F.col("m").alias("v")).union(rest).distinct())
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    # at the fixed point every node but the roots has one link, to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
