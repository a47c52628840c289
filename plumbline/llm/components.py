"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, saved, tasks_for


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the least node that links reach.

    Large-star and small-star rounds (each node's larger, then smaller neighbours hang
    on to its least neighbour) end after a number of rounds that grows as the
    logarithm of the longest chain. Only sums, minima and joins on node ids take part;
    no component is ever gathered. ``most``: so many tasks are enough for the links. Repeated
    links count once; a link of a node to itself, or to a null, adds nothing, not even the
    node; an empty table gives no rows; other columns are ignored.
    """
    edges = packed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), most)
    # steps on few edges stay in few tasks; the number of edges hardly grows from round to round
    k, before = tasks_for(edges), None
    few = lambda df: df.coalesce(k)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = few(few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = saved(few(few(small.where("u > v")).distinct()))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
