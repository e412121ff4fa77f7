"""Connected components with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, tasks


def components(edges: DataFrame, work: Work, tag: str = "cc") -> DataFrame:
    """(id, component) for every end of the edges (src, dst); component is the smallest id reachable.

    Alternating large-star and small-star rounds: the number of edges never
    grows, a hub's edges are aggregated with a map-side minimum, and they are joined
    with a written table, so adaptive execution can split a hub's partition.  Every round is written to the shared folder.  Null ends are dropped; no edges give no rows.
    """
    link = edges.where("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    link = work.save(link, f"{tag}-0")
    k = tasks(link.count())  # edges never grow in number
    if link.isEmpty():
        return link.select(F.col("u").alias("id"), F.col("v").alias("component"))
    n, before = 0, None
    while True:
        # large-star: every larger neighbour of a node goes to the node's smallest neighbour
        both = link.union(link.select(F.col("v"), F.col("u")))
        low = work.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-{n}-low", k)
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: every smaller neighbour, and the node, go to the smallest neighbour
        big = work.save(big.where("u <> v").distinct(), f"{tag}-{n}-large", k)
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        n += 1
        new = work.save(small.where("u <> v").distinct(), f"{tag}-{n}", k)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(*(f"{tag}-{n - 1}{x}" for x in ("", "-low", "-large")))
        link = new
        if now == before:
            break
        before = now
    roots = link.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return link.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
