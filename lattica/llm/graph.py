"""Distributed connected components, and one representative per class of equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import drop_staged, stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b; longs, either direction, repeats and loops allowed; rows with a null end count for nothing) -> (id, component): the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes, each a grouped minimum and an equi-join whose
    result is staged; ends after about log(n) rounds. Ids that occur in no edge other than a loop are not returned. A hub is
    only ever summed up by its minimum, never gathered.
    """
    links = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u joins u's smallest neighbour (or u itself)
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        mid = stage(large)
        # small star: u and its smaller neighbours join the smallest of them
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = stage(small)
        drop_staged(mid)
        drop_staged(links)
        links = new
        # links are distinct: equal counts and sums of two 64-bit hashes are equal links
        now = tuple(links.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(20,0)")) for seed in (1, 2)]).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
