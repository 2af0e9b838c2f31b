"""Samples for training: dense arrays with a mask, in a seeded order and in batches, without a sort of all samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack(cells: DataFrame, keys: list[str], inputs: list[str], targets: list[str], height: int, width: int) -> DataFrame:
    """(keys, x, x_mask, y, y_mask): a row per sample, arrays over channels x height x width, channel by channel and line by line.

    Cells that are null, NaN or absent are 0 with mask false; cells outside the grid are refused. Of repeated cells one counts: the one with
    greatest values, channel by channel in the order given. One shuffle, by sample; a sample has to fit in a task.
    """
    n, names = height * width, [*inputs, *targets]
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    place = F.when(inside, F.col("y") * width + F.col("x")).otherwise(F.raise_error(F.lit("cell outside the grid")).cast("int")).cast("int")
    values = F.array(*[F.col(c).cast("double") for c in names])
    grouped = cells.select(*keys, F.struct(place.alias("at"), values.alias("v")).alias("cell")).groupBy(*keys).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys).schema)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, v in zip(batch["at"], batch["v"], strict=True):
                full = np.full((len(names), n), np.nan)
                full[:, np.asarray(at, int)] = np.asarray([np.asarray(line, float) for line in v]).reshape(-1, len(names)).T
                valid = ~np.isnan(full)
                full[~valid] = 0.0
                k = len(inputs)
                rows.append((full[:k].ravel(), valid[:k].ravel(), full[k:].ravel(), valid[k:].ravel()))
            packed = pd.DataFrame(rows, columns=["x", "x_mask", "y", "y_mask"], index=batch.index)
            yield pd.concat([batch[keys], packed], axis=1)

    flat = grouped.select(*keys, F.col("cells.at").alias("at"), F.col("cells.v").alias("v"))
    return flat.mapInPandas(dense, f"{kinds}, x array<double>, x_mask array<boolean>, y array<double>, y_mask array<boolean>")


def shuffled(samples: DataFrame, keys: list[str], seed: int, shards: int, batch: int) -> DataFrame:
    """(shard, batch, place, ...): samples dealt to shards and ordered within each by the md5 of the seed and their keys, so that reruns agree.

    A shard is read by one trainer; its batches are runs of `batch` places. Only places within a shard are ordered, and shards are the
    caller's to choose, so no task orders all samples. Repeated keys keep any order among themselves.
    """
    code: Column = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    dealt = samples.withColumn("_code", code).withColumn("shard", (F.conv(F.substring("_code", 1, 7), 16, 10).cast("long") % shards).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("_code")) - 1
    return dealt.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch).cast("int")).drop("_code")


def masked_stats(samples: DataFrame, channels: list[str], values: str = "x", mask: str = "x_mask") -> DataFrame:
    """(variable, n, mean, std) of each channel over its valid cells, from packed samples; an aggregate per sample goes before the shuffle."""
    size = F.size(values) / len(channels)
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(channels) - 1)), lambda c: F.struct(c.alias("c"), F.slice(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), (c * size + 1).cast("int"), size.cast("int")).alias("cells"))))
    cells = samples.select(parts.alias("p")).select("p.c", F.explode("p.cells").alias("cell")).where("cell.m").select("c", F.col("cell.v").alias("v"))
    name = F.element_at(F.array(*map(F.lit, channels)), F.col("c") + 1)
    return cells.groupBy(name.alias("variable")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
