"""Statistics, normalisation, profiles, splits and the linear correction baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.store import kept

EPS = 1e-6
#: Parts that rows with one key are numbered in.
SALTS = 64


def channel_stats(long: DataFrame, by: str = "variable", value: str = "value") -> DataFrame:
    """Mean and deviation per channel over what is not null; channels without values have mean 0 and the deviation of eps."""
    return long.groupBy(by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.sqrt(F.coalesce(F.var_pop(value), F.lit(0.0)) + EPS).alias("std"))


def normalise(long: DataFrame, stats: DataFrame, by: str = "variable", value: str = "value") -> DataFrame:
    """A row per channel is joined; Spark broadcasts it as its size allows."""
    return long.join(stats, by).withColumn(value, (F.col(value) - F.col("mean")) / (F.col("std") + EPS)).drop("mean", "std")


def denormalise(long: DataFrame, stats: DataFrame, by: str = "variable", value: str = "value") -> DataFrame:
    """Without the eps that normalise() adds, so not its exact inverse."""
    return long.join(stats, by).withColumn(value, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")


def save_stats(stats: DataFrame, path: str) -> DataFrame:
    """Channel statistics written once (a row per channel) and read back, for runs that normalise by them later."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)
    return stats.sparkSession.read.parquet(path)


def unflatten(samples: DataFrame, keys: list[str], channels: list[str], height: int, width: int, value: str = "value") -> DataFrame:
    """Rows (keys, value: array of channels x height x width, channel by channel and line by line) -> (keys, y, x, a column per channel)."""
    cells = samples.select(*keys, F.posexplode(value).alias("at", "v"))
    place = cells.select(*keys, (F.col("at") / (height * width)).cast("int").alias("c"), (F.col("at") % (height * width) / width).cast("int").alias("y"), (F.col("at") % width).cast("int").alias("x"), "v")
    return place.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate(channels)])


def save_predictions(cells: DataFrame, keys: DataFrame, path: str) -> DataFrame:
    """Predicted cells with the times, leads and members of the samples (`sample`) that they are of, written by year and read back."""
    out = cells.join(keys, "sample").drop("sample")
    out.withColumn("year", F.year("t")).write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)
    return cells.sparkSession.read.parquet(path)


def profile(long: DataFrame, by: str = "variable", value: str = "value") -> DataFrame:
    v = F.col(value)
    return long.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def quantiles(long: DataFrame, by: str, value: str, qs: list[float], exact: bool = True) -> DataFrame:
    """Linear interpolation; exact holds a channel's distinct values in memory, else an approximation with bounded memory is used."""
    of = F.percentile(value, F.array(*map(F.lit, qs))) if exact else F.percentile_approx(value, qs, 100_000)
    q = long.groupBy(by).agg(of.alias("_q"))
    return q.select(by, F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("_q").alias("value"))).alias("_z")).select(by, F.col("_z.q").alias("q"), F.col("_z.value").alias("value"))


def quantiles_by_selection(long: DataFrame, by: str, value: str, qs: list[float], bins: int = 4096) -> DataFrame:
    """Exact quantiles with linear interpolation, for any number of values a channel; channels without values give no rows, null and NaN don't count.

    Each wanted rank has a range of values that holds it. A scan counts the rows in `bins` parts of every range at once, sums of counts
    pick the part with the rank, and that part's least and greatest value are the next range, until a range is one value. Ranges of at
    most `bins` rows are counted by value. A task holds counts of parts, and the driver a number a round. Ranges shrink to the 1/bins-th each round, so rounds go
    with the logarithm of rows, or of the values' spread where nearly all lie in a small part of it. Finite values are expected, less than 1e308 apart.
    Values are written once, as every scan has to see the same bits: a mean worked out again sums up in another order.
    """
    given = kept(long.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    whole = given.groupBy("_by").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    at = F.col("q") * (F.col("n") - 1)
    asked = whole.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_frac", at - F.floor(at))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor(at).alias("k")), F.struct(F.lit(1).alias("end"), F.ceil(at).alias("k")))
    ranks = kept(asked.withColumn("_e", F.explode(ends)).select("_by", "q", "_frac", "_e.end", "_e.k", "n", "lo", "hi"), 1)  # rows by channel and quantile
    while ranks.where("lo < hi").limit(1).count():
        open_ranges = ranks.where("lo < hi").select("_by", "lo", "hi", "n").distinct()
        part = F.when(F.col("n") <= bins, F.col("_v")).otherwise(F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("double"))
        met = given.join(open_ranges, "_by").where(F.col("_v").between(F.col("lo"), F.col("hi")))
        counts = met.groupBy("_by", "lo", part.alias("part")).agg(F.count("_v").alias("rows"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = counts.withColumn("upto", F.sum("rows").over(Window.partitionBy("_by", "lo").orderBy("part")))
        inside = (F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("rows"))
        narrowed = ranks.where("lo < hi").join(upto, ["_by", "lo"]).where(inside)
        narrowed = narrowed.select("_by", "q", "_frac", "end", (F.col("k") - F.col("upto") + F.col("rows")).alias("k"), F.col("rows").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        ranks = kept(ranks.where("lo = hi").unionByName(narrowed), 1)
    found = ranks.groupBy("_by", "q", "_frac").agg(*[F.max(F.when(F.col("end") == e, F.col("lo"))).alias(f"_v{e}") for e in (0, 1)])
    return found.select(F.col("_by").alias(by), "q", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_frac")).alias("value"))


def regime(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin: (-inf, e0], (e0, e1], ..., (last, inf)."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(value <= edges[i], i).otherwise(out)
    return F.when(value.isNotNull(), out)


def season(t: Column) -> Column:
    m = F.month(t)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def in_season(t: Column, name: str) -> Column:
    return season(t) == name if name in ("DJF", "MAM", "JJA", "SON") else F.lit(True)


def split_exact(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """train (boolean): exactly int(n * fraction) rows with the least md5 of seed and key.

    A histogram over the first hexadecimal digits finds the bin in which the count is reached, and counts by hash in that bin the key; the driver gets a
    row of each. Rows with equal keys count one by one: where only some of a key's rows fit, they are numbered within salts, so that no task gets all of them.
    """
    hashed = df.withColumns({"_h": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))})
    in_bin = F.substring("_h", 1, 3)
    bins = hashed.groupBy(in_bin.alias("_b")).count().withColumns({"_upto": F.sum("count").over(Window.orderBy("_b")), "_want": F.floor(F.sum("count").over(Window.partitionBy()) * fraction)})
    edge = bins.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("count") < F.col("_want"))).select("_b", (F.col("_want") - F.col("_upto") + F.col("count")).alias("left")).first()
    if edge is None:  # no row is taken
        return hashed.drop("_h").withColumn("train", F.lit(False))
    ranks = hashed.where(in_bin == edge["_b"]).groupBy("_h").count().withColumn("_upto", F.sum("count").over(Window.orderBy("_h")))
    last = ranks.where(F.col("_upto") - F.col("count") < edge["left"]).orderBy(F.col("_h").desc()).select("_h", "count", (edge["left"] - F.col("_upto") + F.col("count")).alias("fit")).first()
    if last["fit"] == last["count"]:
        return hashed.withColumn("train", F.col("_h") <= last["_h"]).drop("_h")
    torn = kept(hashed.where(F.col("_h") == last["_h"]).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    before = torn.groupBy("_salt").count().select("_salt", F.coalesce(F.sum("count").over(Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_salt").orderBy(F.lit(1)))
    torn = torn.join(F.broadcast(before), "_salt").withColumn("train", number <= last["fit"])  # SALTS rows
    rest = hashed.where(F.col("_h") != last["_h"]).withColumn("train", F.col("_h") < last["_h"])
    return rest.select(*df.columns, "train").union(torn.select(*df.columns, "train"))


def fit_linear(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Slope and intercept of truth a on forecast b per cell; a cell without spread keeps its mean bias."""
    slope, bias = F.regr_slope("a", "b"), F.avg(F.col("a") - F.col("b"))
    flat = F.coalesce(F.var_pop("b"), F.lit(0.0)) == 0
    return pairs.groupBy(*by).agg(F.when(flat, 1.0).otherwise(slope).alias("slope"), F.when(flat, bias).otherwise(F.regr_intercept("a", "b")).alias("intercept"))


def apply_linear(pairs: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    return pairs.join(fit, by).withColumn("p", F.col("slope") * F.col("b") + F.col("intercept")).drop("slope", "intercept")
