"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step lets a node's neighbours point to the smallest node among them (Kiveris et al.,
Connected Components in MapReduce and Beyond), which takes a number of rounds that grows with the
logarithm of the longest chain. A node's neighbours are never listed: their least is an aggregate that combines before the shuffle, and
is joined back to its edges, of which a hub's large partition is split by Spark's handling of skewed joins. Each round is written to the shared folder.

A null end, a loop or a repeated edge adds nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import remove, save, scratch_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """From each node u, its neighbours above u (large) or not above u (small) point to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    linked = both.where("v > u") if large else both
    out = linked.join(least, linked.u == least.w).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge (src, dst).

    A null end or a loop is no edge; repeated edges count once.
    """
    spark = edges.sparkSession

    def saved(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "edges")
        save(df, path)
        return spark.read.schema(df.schema).parquet(path), path

    # u > v: a node points to a lesser one
    start = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now, path = saved(start.where("src is not null and dst is not null and src <> dst").distinct())
    mark = None
    for _ in range(limit):
        nxt, new_path = saved(_star(_star(now, True), False))
        old, mark = mark, nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if path:
            remove(spark, path)
        now, path = nxt, new_path
        if old == mark:
            break
    else:
        raise RuntimeError("components: no fixed point within the limit of rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
