"""Alignment of data sets by their labels: missing dates, ensembles, outer merges, nearest matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(spine: DataFrame, present: DataFrame, key: str = "t") -> DataFrame:
    """Labels of the spine that no row has."""
    return spine.join(present.select(key).distinct(), key, "left_anti")


def without(df: DataFrame, gone: DataFrame, key: str = "t") -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def missing_anywhere(tables: list[DataFrame], key: str = "t") -> DataFrame:
    return reduce(DataFrame.union, [t.select(key) for t in tables]).distinct()


def newest(files: DataFrame, k: int, by: str = "t") -> DataFrame:
    """The k files last changed per date; equal times go by path."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("mtime"), "path"))
    return files.withColumn("rank", rank).where(F.col("rank") <= k)


def tolerant(spine: DataFrame, files: DataFrame, minus_hours: int, plus_hours: int) -> DataFrame:
    """For each date all files of the best kind there are: 0 exact, 1 earlier by minus_hours, 2 later by plus_hours. Dates without any are left out.

    Each file is a candidate for three dates, so an equi-join does; no range join.
    """
    offers = F.array(*[F.struct((F.col("t") + F.expr(f"interval {h} hours")).alias("t"), F.lit(kind).alias("kind")) for kind, h in ((0, 0), (1, minus_hours), (2, -plus_hours))])
    offered = files.select("path", F.explode(offers).alias("o")).select(F.col("o.t").alias("t"), F.col("o.kind").alias("kind"), "path")
    met = spine.join(offered, "t")
    best = met.groupBy("t").agg(F.min("kind").alias("kind"))
    return met.join(best, ["t", "kind"])


def equal_members(df: DataFrame, member: str = "realization", key: str = "t") -> DataFrame:
    """Ensembles cut to the smallest size that any date with a value has, members numbered from 0."""
    sizes = df.where("has_value").groupBy(key).agg(F.countDistinct(member).alias("n"))
    least = sizes.agg(F.min("n").alias("_least"))
    number = (F.dense_rank().over(Window.partitionBy(key).orderBy(member)) - 1).cast("int")
    return df.join(sizes.select(key), key, "left_semi").withColumn("_k", number).join(F.broadcast(least), F.col("_k") < F.col("_least")).drop("_least", member).withColumnRenamed("_k", member)


def merge(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Outer merge of the variables that both have; raises when read if two values of one cell conflict."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in shared])
    both = left.select(*keys, *shared).join(r, keys, "full_outer")

    def one(c: str) -> Column:
        clash = F.abs(F.col(c) - F.col(f"_r_{c}")) > tolerance
        return F.when(clash, F.raise_error(F.lit(f"conflicting values of {c}")).cast("double")).otherwise(F.coalesce(c, f"_r_{c}")).alias(c)

    return both.select(*keys, *[one(c) for c in shared])


def nearest_lead(df: DataFrame, target: float, keys: list[str]) -> DataFrame:
    """Rows of the lead time closest to target, the first of equals."""
    best = df.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("lead") - target).alias("d"), F.col("lead").alias("lead"))).alias("b")).select(*keys, F.col("b.lead").alias("lead"))
    return df.join(best, [*keys, "lead"])
