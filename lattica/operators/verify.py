"""Forecast verification: all skill metrics of all variables and models in one grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geo import cos_lat

EPS = 1e-6
METRICS = ["rmse", "mae", "bias", "mape", "stderr", "r2", "fss", "sal_s", "sal_a", "sal_l"]


def metric(name: str, a: Column, b: Column, threshold: float = 0.5, eps: float = EPS) -> Column:
    """An aggregate over paired values, a the truth and b the forecast. Pairs with a null on either side are left out.

    bias is truth minus forecast. stderr is the population deviation of the differences. r2 of no pairs is 1. fss has no neighbourhood:
    it compares exceedances cell by cell, and a null exceeds nothing.
    """
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    d = a2 - b2
    if name == "rmse":
        return F.sqrt(F.avg(d * d))
    if name == "mae":
        return F.avg(F.abs(d))
    if name == "bias":
        return F.avg(d)
    if name == "mape":
        return F.avg(F.abs(F.try_divide(d, a2 + eps)) * 100.0)
    if name == "stderr":
        return F.stddev_pop(d)
    if name == "r2":
        return 1.0 - F.coalesce(F.sum(d * d), F.lit(0.0)) / (F.coalesce(F.var_pop(a2) * F.count(a2), F.lit(0.0)) + eps)
    if name == "fss":
        ea, eb = (F.coalesce((v > threshold).cast("double"), F.lit(0.0)) for v in (a, b))
        return 1.0 - F.avg((ea - eb) * (ea - eb)) / (F.avg(ea * ea + eb * eb) + eps)
    if name == "sal_s":
        return (F.stddev_pop(b2) - F.stddev_pop(a2)) / (F.stddev_pop(a2) + eps)
    if name == "sal_a":
        return (F.avg(b2) - F.avg(a2)) / (F.avg(a2) + eps)
    if name == "sal_l":
        return F.try_divide(F.sum(b2 * F.abs(b2)), F.sum(F.abs(b2))) - F.try_divide(F.sum(a2 * F.abs(a2)), F.sum(F.abs(a2)))
    raise ValueError(f"unknown metric {name!r}")


def pair_models(df: DataFrame, truth: str, models: dict[str, str], keys: list[str]) -> DataFrame:
    """One row per cell and model, (keys, model, a, b): the models stacked, so one aggregation serves all of them."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("b")) for m, c in models.items()]))
    return df.select(*keys, F.col(truth).alias("a"), stacked.alias("_m")).select(*keys, "a", F.col("_m.model").alias("model"), F.col("_m.b").alias("b"))


def cell_metrics(pairs: DataFrame, by: list[str], names: list[str] | None = None, threshold: float = 0.5, eps: float = EPS) -> DataFrame:
    """Metrics per group of `by` (usually model, variable, y, x and lat), over time."""
    return pairs.groupBy(*by).agg(*[metric(n, F.col("a"), F.col("b"), threshold, eps).alias(n) for n in names or METRICS])


def geo_mean(value: Column, lat: Column) -> Column:
    """Area-weighted mean of what is not null."""
    w = cos_lat(lat)
    return F.sum(value * w) / F.sum(F.when(value.isNotNull(), w))


def area_means(cells: DataFrame, names: list[str], sets: list[list[str]], by: list[str]) -> DataFrame:
    """Area-weighted means of cell metrics over several groupings at once: () the globe, (y) or (x) the profiles."""
    dims = sorted({d for s in sets for d in s})
    out = cells.groupingSets([[F.col(c) for c in by + s] for s in sets], *[F.col(c) for c in by + dims])
    return out.agg(*[geo_mean(F.col(n), F.col("lat")).alias(n) for n in names], *[F.grouping(d).cast("int").alias(f"all_{d}") for d in dims])


def compare(means: DataFrame, names: list[str], base: str, other: str) -> DataFrame:
    """Two models side by side: (metric, base value, other value, diff, abs_diff, pct)."""
    long = means.unpivot(["model"], names, "metric", "value")
    wide = long.groupBy("metric").pivot("model", [base, other]).agg(F.first("value"))
    v1, v2 = F.col(base), F.col(other)
    change = F.abs(v2) - F.abs(v1)
    return wide.select("metric", v1.alias("v1"), v2.alias("v2"), (v2 - v1).alias("diff"), change.alias("abs_diff"), (change / (F.abs(v1) + 1e-10) * 100.0).alias("pct"))


def weighted_loss(pairs: DataFrame, by: list[str], lam: float = 0.1, scale: float = 0.5, eps: float = EPS) -> DataFrame:
    """Heteroscedastic loss of predictions p against y, with input x: squared errors over the sample variance of y, and a
    pull towards the input where target and input agree. Two aggregations: the variance first, joined back by group."""
    var = pairs.groupBy(*by).agg(F.var_samp("y").alias("_var"))
    both = pairs.join(var, by)
    p, y, x = F.col("p"), F.col("y"), F.col("x")
    first = F.avg((p - y) * (p - y) / (F.col("_var") + eps))
    second = F.avg(F.exp(-F.abs(y - x) / scale) * (p - x) * (p - x))
    return both.groupBy(*by).agg((first + lam * second).alias("loss"))


def spatial_correlation(models: DataFrame, field: list[str], by: list[str]) -> DataFrame:
    """(by, correlation): the mean over fields of the correlation of a and b across a field's cells. Fields without variance don't count."""
    each = models.groupBy(*by, *field).agg(F.corr("a", "b").alias("_r"))
    return each.groupBy(*by).agg(F.avg(F.when(~F.isnan("_r"), F.col("_r"))).alias("correlation"))
