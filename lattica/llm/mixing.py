"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected number of copies is its source's target over
its source's size; the whole part is handed out to every document for certain, the rest is a fixed-size sample
with unequal inclusion probabilities. Each document draws u; documents are ranked by the odds of u over the odds
of their inclusion probability, and the sample is the head of that order, cut where its words fill what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stage, unit_hash

#: Histogram bins of the rank order. Only the bin in which a source's words run out is ordered row by row.
BINS = 4096
#: Parts that equal rows are numbered in when only some of them are drawn.
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_copies: float) -> DataFrame:
    """(skey, source, source_size) with one row per source -> the same with `target`.

    Weights go round the sources in code-point order, null last. A target stops at max_copies * source_size; what is
    over is shared again by weight. That is a water level: target = min(cap, weight * level). The level comes from
    running sums over sources ordered by cap / weight. The unpartitioned windows see a row per source, no more.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_fill = Window.orderBy("_fill", "skey")
    capped = (
        sizes.withColumn("_w", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
        .withColumn("_cap", max_copies * F.col("source_size"))
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (budget * F.col("_total") - F.col("_before")) / F.col("_left"))
    )
    level = F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(Window.partitionBy())
    return capped.withColumn("target", F.least("_cap", F.coalesce(F.col("_w") * level, F.col("_cap")))).drop(
        "_w", "_cap", "_fill", "_total", "_before", "_left", "_level"
    )


def pareto_mix(
    docs: DataFrame,
    size: Column,
    *,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    max_copies: int = 2,
    importance: Column | None = None,
    seed: int = 20,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with `size`, `source_size`, `target` (double) and `copies` (long, 0 or more); no row is dropped here.

    size: words of a row, a whole number (null counts 0). importance: a non-negative whole number to which inclusion
    probabilities are proportional within a source (default: the whole square root of size, so long texts are somewhat
    likelier than short ones); copies of one row differ by at most 1 and never exceed max_copies.
    Ties in rank go by id and size. Of rows that are equal in both (null ids count as equal) as many are drawn as fit; which of them is open, so reruns
    agree but for that. Rows without words get the whole copies only. A source's words are within half of its largest document of its target, as
    long as its inclusion probabilities stay below 1. Input columns called like an output column are replaced. Empty tables give empty tables.
    """
    size = F.coalesce(size.cast("long"), F.lit(0))
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    measured = docs.withColumns({"_x_size": size, "_x_key": skey})
    weight = F.coalesce(importance.cast("long"), F.lit(0)) if importance is not None else F.floor(F.sqrt("_x_size"))
    measured = measured.withColumn("_x_imp", weight)

    # one pass over the texts leaves (id, source, size, importance); all else reads this
    narrow = stage(measured.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("_x_key").alias("skey"), F.col("_x_size").alias("size"), F.col("_x_imp").alias("imp")))
    sizes = narrow.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("imp")).alias("_mass"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    plan = stage(
        source_targets(sizes, weights, budget, max_copies)
        .withColumn("_whole", whole.cast("long"))
        .withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
        # inclusion probability of importance 1, so that expected words are _rest
        .withColumn("_unit", F.coalesce(F.try_divide(F.col("_rest"), F.col("_mass").cast("double")), F.lit(0.0)))
        .select("skey", "source_size", "target", "_whole", "_rest", "_unit"),
        files=1,
    )

    def ranked(df: DataFrame, key: str, of: str, imp: str) -> DataFrame:
        u = unit_hash(F.col(of), seed=seed)
        p = F.least(F.greatest(F.col("_unit") * F.col(imp), F.lit(1e-15)), F.lit(1 - 1e-12))
        odds = (u / (1 - u)) / (p / (1 - p))
        return df.join(plan.withColumnRenamed("skey", key), key).withColumn("_odds", odds).withColumn("_bin", F.least(F.floor(F.col("_odds") / (1 + F.col("_odds")) * BINS), F.lit(BINS - 1)))

    rows = ranked(narrow.drop("source"), "skey", "id", "imp")
    running = Window.partitionBy("skey").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        rows.groupBy("skey", "_rest", "_bin")
        .agg(F.sum("size").alias("_words"))
        .withColumn("_upto", F.sum("_words").over(running))
        .where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_words") < F.col("_rest")) & (F.col("_rest") > 0))
        .select("skey", F.col("_bin").alias("_edge"), (F.col("_upto") - F.col("_words")).alias("_before"))
    )
    edge = stage(edge, files=1)
    # equal ranks are one entry, so a bin is ordered by entries however many rows are equal; the middles of `_fit` rows of an entry lie within the rest
    in_bin = Window.partitionBy("skey").orderBy("_odds", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    entries = rows.join(edge, "skey").where(F.col("_bin") == F.col("_edge")).groupBy("skey", "_rest", "_before", "_odds", "id", "size").agg(F.count(F.lit(1)).alias("_many"))
    start = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_many")).over(in_bin), F.lit(0))
    fit = F.when(F.col("size") > 0, F.least(F.floor((F.col("_rest") - start) / F.col("size") + 0.5), F.col("_many"))).otherwise(F.when(start <= F.col("_rest"), F.col("_many")).otherwise(0))
    cut = entries.withColumn("_fit", fit).where("_fit > 0").groupBy("skey").agg(F.max(F.struct(F.struct("_odds", "id", "size").alias("at"), "_fit", "_many")).alias("_last"))
    bounds = edge.join(cut, "skey", "left").select(F.col("skey").alias("_x_key"), "_edge", F.col("_last.at").alias("_last"), F.col("_last._fit").alias("_fit"), F.col("_last._many").alias("_many"))
    bounds = stage(bounds, files=1)

    out = ranked(measured, "_x_key", id_col, "_x_imp").join(bounds, "_x_key", "left")
    here = F.struct(F.col("_odds"), F.col(id_col).alias("id"), F.col("_x_size").alias("size"))
    in_edge = F.col("_bin") == F.col("_edge")
    torn = F.coalesce(in_edge & (here == F.col("_last")) & (F.col("_fit") < F.col("_many")), F.lit(False))
    drawn = F.coalesce((F.col("_bin") < F.col("_edge")) | (in_edge & (here <= F.col("_last"))), F.lit(False))
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]

    def given(df: DataFrame, extra: Column) -> DataFrame:
        copies = (F.col("_whole") + F.when(extra, 1).otherwise(0)).cast("long")
        return df.select(*[F.col("_x_row").getField(c).alias(c) for c in kept], F.col("_x_size").alias("size"), "source_size", "target", copies.alias("copies"))

    out = out.select(F.struct(*[docs[c] for c in kept]).alias("_x_row"), "_x_key", "_x_size", measured["_x_imp"], out["source_size"], out["target"], "_whole", "_fit", torn.alias("_torn"), drawn.alias("_drawn"))
    if bounds.where("_fit < _many").isEmpty():  # a row per source
        return given(out, F.col("_drawn"))
    # equal rows of which only some are drawn: numbered within salts, and salts one after another, so that no task gets all of them
    ties = stage(out.where("_torn").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    upto = Window.partitionBy("_x_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = ties.groupBy("_x_key", "_salt").count().select("_x_key", "_salt", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_first"))
    number = F.col("_first") + F.row_number().over(Window.partitionBy("_x_key", "_salt").orderBy(F.lit(1)))
    numbered = ties.join(F.broadcast(first), ["_x_key", "_salt"])  # SALTS rows a source
    return given(out.where("not _torn"), F.col("_drawn")).union(given(numbered.withColumn("_drawn", number <= F.col("_fit")), F.col("_drawn")))
