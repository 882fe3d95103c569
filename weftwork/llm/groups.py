"""Connected components, and links inside buckets without all pairs of a bucket.

Nodes are values with an order (here hashes). Nothing is collected; every step is a stored table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import dropped, measured, stored

#: Rows of two ids at most (under 16 MB) that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def few(df: DataFrame, n: int) -> DataFrame:
    """df, whose n rows were counted, with a broadcast hint if they are few enough."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def _pairs(df: DataFrame) -> tuple[DataFrame, dict]:
    return measured(df.distinct(), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the smallest node of its component. Alternating large-star and small-star.

    The minima are stored before they are joined, so that Spark can split the rows of a hub.
    """
    pairs, seen = _pairs(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v"))
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, m = measured(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(few(least, m["n"]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct())
        small, m = measured(large.groupBy("u").agg(F.min("v").alias("m")))  # in large, v < u
        moved = large.join(few(small, m["n"]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        before = pairs
        pairs, now = _pairs(moved.unionByName(small.select("u", F.col("m").alias("v"))))
        dropped(before, least, large, small)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stored(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))


def shared_members(members: DataFrame) -> DataFrame:
    """(bucket, node, pivot) of the buckets that hold more than one node; pivot is a bucket's smallest. members: (bucket, node), distinct."""
    counted = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # most buckets hold one node: only bucket and count are shuffled
    shared, m = measured(counted.where("n > 1").select("bucket"))
    rows = stored(members.join(few(shared, m["n"]), "bucket"))
    pivots = stored(rows.groupBy("bucket").agg(F.min("node").alias("pivot")))
    out = stored(rows.join(few(pivots, m["n"]), "bucket").select("bucket", "node", "pivot"))
    dropped(shared, rows, pivots)
    return out


def linked(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], features: Callable[[DataFrame], DataFrame] | None = None, possible: Callable[[], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(edges, components) such that every pair of nodes in a bucket that verify() accepts is in one component.

    members: as shared_members gives them. verify takes pairs (u, v) and returns those that hold. First the
    smallest node of a bucket is tested against the others. A bucket whose nodes are then all in one component is done.
    In any other, the nodes outside its largest component are tested against those of other components.

    features gives columns (node, f, a struct) for such nodes, and possible a condition on fu and fv that every pair
    that verify would accept fulfils: pairs beyond it are never made.
    """
    tested = stored(members.where("node != pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct())
    edges = stored(verify(tested))
    roots = components(edges)
    named = stored(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
    sizes = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    busy, m = measured(largest.where("roots > 1").select("bucket", "main"))
    if not m["n"]:
        return edges, roots
    rows = named.join(few(busy, m["n"]), "bucket")
    if features:
        known = stored(features(stored(rows.select("node").distinct())))
        rows = rows.join(known, "node")
    rows = stored(rows)
    a = rows.where("root != main").select("bucket", F.col("node").alias("u"), F.col("root").alias("_r"), *([F.col("f").alias("fu")] if features else []))
    b = rows.select("bucket", F.col("node").alias("v"), "root", "main", *([F.col("f").alias("fv")] if features else []))
    fits = (F.col("_r") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("u") < F.col("v")))  # each pair once
    if possible:
        fits = fits & possible()
    pairs = a.join(b, "bucket").where(fits).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    fresh = stored(pairs.join(tested, ["u", "v"], "left_anti"))
    more, m = measured(verify(fresh))
    dropped(rows, named, busy, fresh, tested)
    if m["n"]:
        edges = stored(edges.unionByName(more))
        roots = components(edges)
    return edges, roots
