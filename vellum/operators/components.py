"""Connected components of an edge table, by alternating large-star and small-star rounds.

Both kinds of round only ever need the smallest neighbour of a node, so a hub with
any number of neighbours is an aggregate that Spark sums before the shuffle, and the
join that hands it out again may be split by adaptive execution. Each round is
written to the shared folder; the driver sees one count and one checksum of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.storage import discard, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them (every edge has u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    ends = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "m"))).otherwise(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m")))
    return tied.select(F.inline(ends)).select("u", F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns u, v); root is the smallest node reachable.

    Nulls and loops are left out, repeated edges count once; no edges give no rows.
    """
    now = store(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        last, now = now, store(_small_star(_large_star(now)), "edges")
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
