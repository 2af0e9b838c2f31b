"""Every registered query and its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import geo, timeaxis
from lattica.operators import align, curvilinear, grid, samples, scatter, spectral, stats, verify
from lattica.functions.store import shared_dir
from lattica.plans import experiment
from lattica.plans import views as v
from lattica.sources import files, perfile
from lattica.sources.zarr import read_zarr, write_zarr
from lattica.spec import Region
from lattica.streaming.verification import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return verify.pair_models(v.grid_pair(spark, sf), "an", {"fc": "fc", "pr": "pr"}, ["t", "y", "x", "lat"])


# verification: a query per metric, and all of them in one aggregation

_THR = 40000.0
_E = "1e-6::DOUBLE"
_METRIC_SQL = {
    "rmse": "sqrt(avg((a - b) * (a - b)))",
    "mae": "avg(abs(a - b))",
    "bias": "avg(a - b)",
    "mape": f"avg(abs((a - b) / (a + {_E})) * 100)",
    "stderr": "stddev_pop(a - b)",
    "r2": f"1 - sum((a - b) * (a - b)) / (var_pop(a) * count(a) + {_E})",
    "fss": f"1 - avg(power(CASE WHEN a > {_THR} THEN 1e0 ELSE 0e0 END - CASE WHEN b > {_THR} THEN 1e0 ELSE 0e0 END, 2)) / (avg(CASE WHEN a > {_THR} THEN 1e0 ELSE 0e0 END + CASE WHEN b > {_THR} THEN 1e0 ELSE 0e0 END) + {_E})",
    "sal_s": f"(stddev_pop(b) - stddev_pop(a)) / (stddev_pop(a) + {_E})",
    "sal_a": f"(avg(b) - avg(a)) / (avg(a) + {_E})",
    "sal_l": "sum(b * abs(b)) / sum(abs(b)) - sum(a * abs(a)) / sum(abs(a))",
}


def _cell_query(names: list[str], key: str) -> None:
    sql = f"WITH {v.PAIR}, {v.PAIRS} SELECT model, y, x, " + ", ".join(f"round({_METRIC_SQL[n]}, 4) {n}" for n in names) + " FROM pairs GROUP BY 1, 2, 3"
    query(sql, key)(lambda spark, sf: rounded(verify.cell_metrics(pairs(spark, sf), ["model", "y", "x"], names, _THR), *names))


for _n in ("rmse", "mae", "bias", "mape", "stderr", "r2", "fss"):
    _cell_query([_n], f"{_n}_cell")
_cell_query(["sal_s", "sal_a", "sal_l"], "sal_cell")
_cell_query(verify.METRICS, "all_metrics_cell")

_CELLS = f"{v.PAIR}, {v.PAIRS}, cells AS (SELECT model, y, x, lat, " + ", ".join(f"{_METRIC_SQL[n]} {n}" for n in verify.METRICS) + " FROM pairs GROUP BY 1, 2, 3, 4)"
_W = "cos(radians(lat))"


def _means(names: list[str]) -> str:
    return ", ".join(f"round(sum({n} * {_W}) / sum({_W}), 4) {n}" for n in names)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return verify.cell_metrics(pairs(spark, sf), ["model", "y", "x", "lat"], None, _THR)


@query(f"WITH {_CELLS} SELECT model, {_means(verify.METRICS)} FROM cells GROUP BY 1")
def geo_mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    means = _cells(spark, sf).groupBy("model").agg(*[verify.geo_mean(F.col(n), F.col("lat")).alias(n) for n in verify.METRICS])
    return rounded(means, *verify.METRICS)


_G = ["rmse", "mae", "bias"]


@query(f"WITH {_CELLS} SELECT model, y, x, CAST(grouping(y) AS INT) all_y, CAST(grouping(x) AS INT) all_x, {_means(_G)} FROM cells GROUP BY GROUPING SETS ((model), (model, y), (model, x))")
def metric_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(verify.area_means(_cells(spark, sf), _G, [[], ["y"], ["x"]], ["model"]).select("model", "y", "x", "all_y", "all_x", *_G), *_G)


@query(
    f"WITH {_CELLS}, m AS (SELECT model, " + ", ".join(f"sum({n} * {_W}) / sum({_W}) {n}" for n in _G) + " FROM cells GROUP BY 1), l AS (UNPIVOT m ON rmse, mae, bias INTO NAME metric VALUE value), "
    "w AS (SELECT metric, max(CASE WHEN model = 'fc' THEN value END) v1, max(CASE WHEN model = 'pr' THEN value END) v2 FROM l GROUP BY 1) "
    "SELECT metric, round(v1, 4) v1, round(v2, 4) v2, round(v2 - v1, 4) diff, round(abs(v2) - abs(v1), 4) abs_diff, round((abs(v2) - abs(v1)) / (abs(v1) + 1e-10::DOUBLE) * 100, 4) pct FROM w"
)
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    means = _cells(spark, sf).groupBy("model").agg(*[verify.geo_mean(F.col(n), F.col("lat")).alias(n) for n in _G])
    return rounded(verify.compare(means, _G, "fc", "pr"), "v1", "v2", "diff", "abs_diff", "pct")


@query(
    f"WITH {v.PAIR}, {v.PAIRS}, k AS (SELECT model, var_samp(a) w FROM pairs GROUP BY 1) SELECT model, round(avg((b - a) * (b - a) / (w + {_E})) + 0.1::DOUBLE * avg(exp(-abs(a - 0.5::DOUBLE * b) / 5e4::DOUBLE) * (0.5::DOUBLE * b) * (0.5::DOUBLE * b)), 2) loss FROM pairs JOIN k USING (model) GROUP BY 1"
)
def hetero_loss(spark: SparkSession, sf: str) -> DataFrame:
    given = pairs(spark, sf).select("model", F.col("a").alias("y"), F.col("b").alias("p"), (0.5 * F.col("b")).alias("x"))
    return rounded(verify.weighted_loss(given, ["model"], 0.1, 5e4), "loss", digits=2)


# statistics

_LONG = f"WITH {v.PAIR}, {v.LONG}"
_STATS = "st AS (SELECT variable, avg(value) mean, sqrt(var_pop(value) + 1e-6::DOUBLE) std FROM long GROUP BY 1)"


@query(f"{_LONG}, {_STATS} SELECT variable, round(mean, 4) mean, round(std, 4) std FROM st")
def channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.channel_stats(v.long(spark, sf)), "mean", "std")


@query(f"{_LONG}, {_STATS} SELECT t, y, x, variable, round((value - mean) / (std + 1e-6::DOUBLE), 4) \"value\" FROM long JOIN st USING (variable)")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.long(spark, sf)
    return rounded(stats.normalise(rows, stats.channel_stats(rows)).select("t", "y", "x", "variable", "value"), "value")


@query(f"{_LONG}, {_STATS} SELECT t, y, x, variable, round((value - mean) / (std + 1e-6::DOUBLE) * std + mean, 2) \"value\" FROM long JOIN st USING (variable)")
def denormalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.long(spark, sf)
    fitted = stats.channel_stats(rows)
    return rounded(stats.denormalise(stats.normalise(rows, fitted), fitted).select("t", "y", "x", "variable", "value"), "value", digits=2)


@query(f"{_LONG} SELECT variable, count(value) n, round(avg(value), 4) mean, round(stddev_pop(value), 4) std, round(min(value), 4) min, round(max(value), 4) max FROM long GROUP BY 1")
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.profile(v.long(spark, sf)), "mean", "std", "min", "max")


_Q = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@query(f"{_LONG} SELECT variable, q, round(quantile_cont(value, q), 4) \"value\" FROM long, (SELECT unnest({_Q}::DOUBLE[]) q) GROUP BY 1, 2".replace("quantile_cont(value, q)", "CASE q " + " ".join(f"WHEN {q}::DOUBLE THEN quantile_cont(value, {q}::DOUBLE)" for q in _Q) + " END"))
def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.quantiles(v.long(spark, sf), "variable", "value", _Q), "value")


@query(f"{_LONG} SELECT variable, CAST(CASE WHEN value <= 20000 THEN 0 WHEN value <= 40000 THEN 1 WHEN value <= 60000 THEN 2 ELSE 3 END AS INT) regime, count(*) n, round(avg(value), 4) mean, round(stddev_pop(value), 4) std FROM long GROUP BY 1, 2")
def regimes(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.long(spark, sf).withColumn("regime", stats.regime(F.col("value"), [20000.0, 40000.0, 60000.0]).cast("int"))
    return rounded(rows.groupBy("variable", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), "mean", "std")


@query(f"WITH {v.PAIR} SELECT y, x, round(avg(an), 4) an, round(avg(fc), 4) fc FROM grid_pair GROUP BY 1, 2")
def time_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(v.grid_pair(spark, sf).groupBy("y", "x").agg(F.avg("an").alias("an"), F.avg("fc").alias("fc")), "an", "fc")


@query(f"WITH {v.MEMBER} SELECT y, x, round(avg(an), 4) an FROM grid_member GROUP BY 1, 2")
def average_members(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(v.grid_member(spark, sf).groupBy("y", "x").agg(F.avg("an").alias("an")), "an")


_SEASON = "CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) <= 5 THEN 'MAM' WHEN month(t) <= 8 THEN 'JJA' ELSE 'SON' END"


@query(f"WITH {v.PAIR} SELECT {_SEASON} season, y, x, round(avg(an), 4) an FROM grid_pair GROUP BY 1, 2, 3")
def season_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(v.grid_pair(spark, sf).groupBy(stats.season(F.col("t")).alias("season"), "y", "x").agg(F.avg("an").alias("an")), "an")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.9::DOUBLE) train FROM orders")
def exact_split(spark: SparkSession, sf: str) -> DataFrame:
    return stats.split_exact(v.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.9, 42)


_FIT = f"{v.PAIR}, {v.PAIRS}, fit AS (SELECT model, y, x, CASE WHEN var_pop(b) = 0 THEN 1 ELSE regr_slope(a, b) END slope, CASE WHEN var_pop(b) = 0 THEN avg(a - b) ELSE regr_intercept(a, b) END intercept FROM pairs WHERE t < TIMESTAMP '2000-01-01' GROUP BY 1, 2, 3)"


def _train(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p, cut = pairs(spark, sf), F.expr("timestamp_ntz'2000-01-01 00:00:00'")
    return p.where(F.col("t") < cut), p.where(F.col("t") >= cut)


@query(f"WITH {_FIT} SELECT model, y, x, round(slope, 4) slope, round(intercept, 3) intercept FROM fit")
def linear_correction(spark: SparkSession, sf: str) -> DataFrame:
    fit = stats.fit_linear(_train(spark, sf)[0], ["model", "y", "x"])
    return rounded(rounded(fit, "slope"), "intercept", digits=3)


@query(f"WITH {_FIT}, p AS (SELECT model, a, slope * b + intercept p FROM pairs JOIN fit USING (model, y, x) WHERE t >= TIMESTAMP '2000-01-01') SELECT model, round(avg(p), 3) mean, round(stddev_samp(p), 3) std, round(sqrt(avg((a - p) * (a - p))), 3) rmse FROM p GROUP BY 1")
def verify_correction(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train(spark, sf)
    p = stats.apply_linear(test, stats.fit_linear(train, ["model", "y", "x"]), ["model", "y", "x"])
    d = F.col("a") - F.col("p")
    return rounded(p.groupBy("model").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"), F.sqrt(F.avg(d * d)).alias("rmse")), "mean", "std", "rmse", digits=3)


# time and alignment

_START, _END = datetime(2024, 1, 1), datetime(2024, 1, 31)
_SPINE12 = "spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 12:00:00', INTERVAL 12 HOUR)) t)"


def _spine12(spark: SparkSession) -> DataFrame:
    return timeaxis.spine(spark, _START, _END, "12h")


@query("SELECT unnest(generate_series(CAST(date_trunc('day', min(ts)) AS TIMESTAMP), CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 12 HOUR, INTERVAL 12 HOUR)) t FROM events")
def date_spine(spark: SparkSession, sf: str) -> DataFrame:
    """Half days from the first to the last day of the events."""
    return timeaxis.spine_of(v.table(spark, sf, "events").select(timeaxis.floor_day(F.col("ts")).alias("t")), "12h")


@query("SELECT unnest(generate_series(CASE WHEN date_trunc('month', min(l_shipdate)) = min(l_shipdate) THEN min(l_shipdate) ELSE CAST(date_trunc('month', min(l_shipdate)) AS TIMESTAMP) + INTERVAL 1 MONTH END, max(l_shipdate), INTERVAL 1 MONTH)) t FROM lineitem")
def month_spine(spark: SparkSession, sf: str) -> DataFrame:
    """Months that begin between the first and the last ship date."""
    return timeaxis.spine_of(v.table(spark, sf, "lineitem"), "MS", "l_shipdate")


@query(f"WITH {v.SERIES}, {_SPINE12} SELECT t FROM spine ANTI JOIN series USING (t)")
def missed_dates(spark: SparkSession, sf: str) -> DataFrame:
    return align.missing(_spine12(spark), v.series(spark, sf))


_GONE = "gone AS (SELECT DISTINCT t FROM grid_pair WHERE an > 60000 AND y = 0)"


def _gone(spark: SparkSession, sf: str, y: int = 0) -> DataFrame:
    return v.grid_pair(spark, sf).where((F.col("an") > 60000) & (F.col("y") == y)).select("t").distinct()


@query(f"WITH {v.PAIR}, {_GONE} SELECT t, y, x, round(an, 4) an FROM grid_pair ANTI JOIN gone USING (t)")
def drop_missed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(align.without(v.grid_pair(spark, sf), _gone(spark, sf)).select("t", "y", "x", "an"), "an")


@query(f"WITH {v.PAIR} SELECT DISTINCT t FROM grid_pair WHERE an > 60000 AND y IN (0, 1)")
def missed_union(spark: SparkSession, sf: str) -> DataFrame:
    return align.missing_anywhere([_gone(spark, sf, 0), _gone(spark, sf, 1)])


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) t FROM orders")
def month_snap(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "orders").select("o_orderkey", v.month(F.col("o_orderdate")).alias("t"))


_LEAD = "lead AS (SELECT t, y, x, realization, CAST(24 * realization AS DOUBLE) lead, an FROM grid_member)"


@query(f"WITH {v.MEMBER}, {_LEAD}, b AS (SELECT t, y, x, min((abs(lead - 60), lead)) k FROM (SELECT t, y, x, lead FROM lead) GROUP BY 1, 2, 3) SELECT t, y, x, l.lead, round(an, 4) an FROM lead l JOIN b USING (t, y, x) WHERE l.lead = b.k[2]".replace("min((abs(lead - 60), lead)) k", "min(abs(lead - 60) * 1000 + lead) k").replace("b.k[2]", "(b.k % 1000)"))
def nearest_lead(spark: SparkSession, sf: str) -> DataFrame:
    led = v.grid_member(spark, sf).withColumn("lead", F.col("realization") * 24.0)
    return rounded(align.nearest_lead(led, 60.0, ["t", "y", "x"]).select("t", "y", "x", "lead", "an"), "an")


_FILES = "files AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) t, ts mtime, CAST(event_id AS VARCHAR) path FROM events)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), F.col("ts").alias("mtime"), F.col("event_id").cast("string").alias("path"))


@query(f"WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mtime DESC, path) k FROM files) SELECT t, path, CAST(k AS INT) \"rank\" FROM r WHERE k <= 3")
def newest_k(spark: SparkSession, sf: str) -> DataFrame:
    return align.newest(_files(spark, sf), 3).select("t", "path", "rank")


@query(
    f"WITH {_FILES}, s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 06:00:00', INTERVAL 6 HOUR)) t), c AS (SELECT s.t, path, CASE WHEN f.t = s.t THEN 0 WHEN f.t < s.t THEN 1 ELSE 2 END kind FROM s JOIN files f ON f.t IN (s.t, s.t - INTERVAL 1 HOUR, s.t + INTERVAL 1 HOUR)) "
    "SELECT t, CAST(kind AS INT) kind, path FROM c WHERE kind = (SELECT min(kind) FROM c d WHERE d.t = c.t)"
)
def tolerance_match(spark: SparkSession, sf: str) -> DataFrame:
    return align.tolerant(timeaxis.spine(spark, _START, _END, "6h"), _files(spark, sf), 1, 1).select("t", "kind", "path")


@query(
    f"WITH {v.MEMBER}, n AS (SELECT t, count(DISTINCT realization) n FROM grid_member GROUP BY 1), r AS (SELECT *, dense_rank() OVER (PARTITION BY t ORDER BY realization) - 1 k FROM grid_member) SELECT t, y, x, CAST(k AS INT) realization, round(an, 4) an FROM r WHERE k < (SELECT min(n) FROM n)"
)
def ensemble_align(spark: SparkSession, sf: str) -> DataFrame:
    members = v.grid_member(spark, sf).withColumn("has_value", F.col("an").isNotNull())
    return rounded(align.equal_members(members).select("t", "y", "x", "realization", "an"), "an")


@query(f"WITH {v.MEMBER} SELECT t, y, x, count(DISTINCT realization) members, bool_or(an IS NOT NULL) any_valid FROM grid_member GROUP BY 1, 2, 3")
def member_counts(spark: SparkSession, sf: str) -> DataFrame:
    return v.grid_member(spark, sf).groupBy("t", "y", "x").agg(F.countDistinct("realization").alias("members"), F.bool_or(F.col("an").isNotNull()).alias("any_valid"))


@query(f"WITH {v.PAIR}, {v.MEMBER} SELECT t, y, x, realization, round(m.fc - p.an, 4) error FROM grid_member m JOIN grid_pair p USING (t, y, x)")
def broadcast_members(spark: SparkSession, sf: str) -> DataFrame:
    truth = v.grid_pair(spark, sf).select("t", "y", "x", "an")
    members = v.grid_member(spark, sf).select("t", "y", "x", "realization", "fc")
    return members.join(truth, ["t", "y", "x"]).select("t", "y", "x", "realization", F.round(F.col("fc") - F.col("an"), 4).alias("error"))


@query(f"WITH {v.PAIR} SELECT t, y, x, round(coalesce(l.an, r.an), 4) an FROM (SELECT t, y, x, an FROM grid_pair WHERE y < 5) l FULL JOIN (SELECT t, y, x, an FROM grid_pair WHERE y > 3) r USING (t, y, x)")
def source_sum(spark: SparkSession, sf: str) -> DataFrame:
    g = v.grid_pair(spark, sf).select("t", "y", "x", "an")
    return rounded(align.merge(g.where("y < 5"), g.where("y > 3"), ["t", "y", "x"], 1e-6), "an")


@query(f"WITH {v.PAIR} SELECT t, y, x, round(an, 4) an, NULL::DOUBLE fc FROM grid_pair WHERE t < TIMESTAMP '1998-01-01' UNION ALL SELECT t, y, x, NULL, round(fc, 4) FROM grid_pair WHERE t >= TIMESTAMP '1998-01-01'")
def concat_time(spark: SparkSession, sf: str) -> DataFrame:
    g, cut = v.grid_pair(spark, sf), F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    parts = g.where(F.col("t") < cut).select("t", "y", "x", "an").unionByName(g.where(F.col("t") >= cut).select("t", "y", "x", "fc"), allowMissingColumns=True)
    return rounded(parts, "an", "fc")


@query(f"{_LONG} SELECT t, y, x, variable, round(value, 4) \"value\" FROM long")
def stack_variables(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(v.long(spark, sf).drop("lat"), "value")


@query(f"WITH {v.MEMBER} SELECT t, y, x, (dense_rank() OVER (ORDER BY t) - 1) * 7 + realization sample_id, round(an, 4) an FROM grid_member")
def flatten_samples(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    members = v.grid_member(spark, sf)
    order = members.select("t").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("t")) - 1)  # a row per date
    return members.join(order, "t").select("t", "y", "x", (F.col("k") * 7 + F.col("realization")).cast("long").alias("sample_id"), F.round("an", 4).alias("an"))


@query(f"WITH {v.PAIR}, k AS (SELECT avg(an) > 0.5::DOUBLE * avg(fc) yes FROM grid_pair) SELECT t, y, x, round(CASE WHEN yes THEN an / 2 ELSE an END, 4) an FROM grid_pair, k")
def unit_fix(spark: SparkSession, sf: str) -> DataFrame:
    g = v.grid_pair(spark, sf)
    means = g.agg((F.avg("an") > 0.5 * F.avg("fc")).alias("_yes"))
    return g.crossJoin(F.broadcast(means)).select("t", "y", "x", F.round(F.when(F.col("_yes"), F.col("an") / 2).otherwise(F.col("an")), 4).alias("an"))


# regions and grids

_BOX = Region("box", (-121.0, -106.0), (43.0, 35.0))
_OVER_CUT = Region("cut", (170.0, -150.0), (45.0, 33.0))


@query(f"WITH {v.PAIR} SELECT t, y, x, round(an, 4) an FROM grid_pair WHERE lat BETWEEN 35 AND 43 AND lon BETWEEN -121 AND -106")
def region_subset(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.subset(v.grid_pair(spark, sf), _BOX).select("t", "y", "x", "an"), "an")


_WRAP = "w AS (SELECT t, y, x, lat, CAST((160 + 10 * x + 180) % 360 - 180 AS DOUBLE) lon, an FROM grid_pair)"


@query(f"WITH {v.PAIR}, {_WRAP} SELECT t, y, x, lon, round(an, 4) an FROM w WHERE lat BETWEEN 33 AND 45 AND (lon >= 170 OR lon <= -150)")
def region_subset_wrap(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = v.grid_pair(spark, sf).withColumn("lon", geo.wrap(160.0 + 10.0 * F.col("x"), 0.0))
    return rounded(grid.subset(wrapped, _OVER_CUT).select("t", "y", "x", "lon", "an"), "an")


@query(f"WITH {v.CURV}, h AS (SELECT *, lon >= -121 AND lon < -106 AND lat >= 35 AND lat < 43 hit FROM grid_curv) SELECT y, x, CASE WHEN hit THEN v END v FROM h WHERE y IN (SELECT y FROM h WHERE hit) AND x IN (SELECT x FROM h WHERE hit)")
def region_subset_curvilinear(spark: SparkSession, sf: str) -> DataFrame:
    return grid.subset_curvilinear(v.grid_curv(spark, sf), _BOX, ["v"]).select("y", "x", "v")


@query(f"WITH {v.PAIR}, a AS (SELECT lat - lag(lat) OVER (ORDER BY lat) d FROM (SELECT DISTINCT lat FROM grid_pair)), b AS (SELECT lon - lag(lon) OVER (ORDER BY lon) d FROM (SELECT DISTINCT lon FROM grid_pair)) SELECT (SELECT round(avg(abs(d)), 6) FROM a) dlat, (SELECT round(avg(abs(d)), 6) FROM b) dlon")
def grid_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.resolution(v.grid_pair(spark, sf)), "dlat", "dlon", digits=6)


@query(f"WITH {v.CURV}, d AS (SELECT abs(lat - lag(lat) OVER (PARTITION BY x ORDER BY y)) a, abs(lon - lag(lon) OVER (PARTITION BY y ORDER BY x)) b FROM grid_curv) SELECT round(median(a), 6) dlat, round(median(b), 6) dlon FROM d")
def curvilinear_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.curvilinear_resolution(v.grid_curv(spark, sf)), "dlat", "dlon", digits=6)


def _axis_sql(name: str, n: int, first: float, step: float, start: float, by: float, count: int, clamp: bool) -> str:
    at = f"({start}::DOUBLE + {by}::DOUBLE * k - {first}::DOUBLE) / {step}::DOUBLE"
    at = f"greatest(0e0, least({n - 1}e0, {at}))" if clamp else at
    return (
        f"{name} AS (SELECT CAST(k AS INT) k, i, CASE WHEN i = lo THEN 1 - (pos - lo) ELSE pos - lo END w FROM (SELECT k, pos, CAST(least(floor(pos + 1e-9::DOUBLE), {n - 2}) AS INT) lo FROM (SELECT k, {at} pos FROM range({count}) r(k)) WHERE pos BETWEEN -1e-9::DOUBLE AND {n - 1} + 1e-9::DOUBLE) z, LATERAL (SELECT unnest([lo, lo + 1]) i))"
    )


_LAT_TO, _LON_TO = [46.0 - 1.5 * k for k in range(12)], [-131.0 + 2.0 * k for k in range(20)]


def _regrid_sql(clamp: bool) -> str:
    axes = _axis_sql("wy", 8, 45, -2, 46, -1.5, 12, clamp) + ", " + _axis_sql("wx", 12, -130, 3, -131, 2, 20, clamp)
    return f"WITH {v.SPINE}, {axes}, r AS (SELECT t, wy.k y, wx.k x, sum(an * wy.w * wx.w) v, sum(CASE WHEN an IS NOT NULL THEN wy.w * wx.w END) n FROM grid_spine g JOIN wy ON g.y = wy.i JOIN wx ON g.x = wx.i GROUP BY 1, 2, 3) SELECT t, y, x, round(CASE WHEN n > 1 - 1e-9::DOUBLE THEN v END, 3) an FROM r"


def _regrid(spark: SparkSession, sf: str, fill: str) -> DataFrame:
    return rounded(grid.regrid(v.grid_spine(spark, sf), (8, 45.0, -2.0), (12, -130.0, 3.0), _LAT_TO, _LON_TO, ["t"], ["an"], fill), "an", digits=3)


query(_regrid_sql(False), "regrid_bilinear")(lambda spark, sf: _regrid(spark, sf, "null"))
query(_regrid_sql(True), "regrid_border")(lambda spark, sf: _regrid(spark, sf, "border"))


@query(
    f"WITH {v.SPINE}, g AS (SELECT *, last_value(an IGNORE NULLS) OVER b v0, last_value(CASE WHEN an IS NOT NULL THEN x END IGNORE NULLS) OVER b i0, first_value(an IGNORE NULLS) OVER f v1, first_value(CASE WHEN an IS NOT NULL THEN x END IGNORE NULLS) OVER f i1 FROM grid_spine WINDOW b AS (PARTITION BY t, y ORDER BY x ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY t, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT t, y, x, round(coalesce(an, v0 + (v1 - v0) * (x - i0) / nullif(i1 - i0, 0)), 3) an FROM g"
)
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.fill_gaps(v.grid_spine(spark, sf).select("t", "y", "x", "an"), "an", "x", ["t", "y"]), "an", digits=3)


_MIRROR = "CASE WHEN (({c} + k.k) % 16 + 16) % 16 < 8 THEN (({c} + k.k) % 16 + 16) % 16 ELSE 15 - (({c} + k.k) % 16 + 16) % 16 END"
_KERNEL = "k AS (SELECT k, exp(-0.5::DOUBLE * k * k / (1.5::DOUBLE * 1.5::DOUBLE)) / sum(exp(-0.5::DOUBLE * k * k / (1.5::DOUBLE * 1.5::DOUBLE))) OVER () w FROM range(-6, 7) r(k))"


@query(
    f"WITH {v.FIELD8}, {_KERNEL}, a AS (SELECT f.vec_id, f.y, f.x, sum(g.v * k.w) v FROM field8 f CROSS JOIN k JOIN field8 g ON g.vec_id = f.vec_id AND g.x = f.x AND g.y = {_MIRROR.format(c='f.y')} GROUP BY 1, 2, 3), "
    f"b AS (SELECT f.vec_id, f.y, f.x, sum(g.v * k.w) v FROM a f CROSS JOIN k JOIN a g ON g.vec_id = f.vec_id AND g.y = f.y AND g.x = {_MIRROR.format(c='f.x')} GROUP BY 1, 2, 3) SELECT vec_id, y, x, round(v, 6) v FROM b"
)
def gaussian_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.smooth(v.field8(spark, sf), "v", 1.5, {"y": 8, "x": 8}, ["vec_id"]), "v", digits=6)


@query(f"WITH {v.FIELD8} SELECT vec_id, CAST(y - 2 AS INT) y, CAST(x - 1 AS INT) x, round(v, 6) v FROM field8 WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def crop_centre(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.crop_centre(v.field8(spark, sf), 8, 8, 4, 6), "v", digits=6)


@query(f"WITH {v.FIELD8} SELECT vec_id, CAST(ty AS INT) y, CAST(tx AS INT) x, round(v, 6) v FROM field8 JOIN range(10) a(ty) ON y = least(ty, 7) JOIN range(6) b(tx) ON x = least(tx, 7)")
def crop_pad(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.match_size(v.field8(spark, sf), 8, 8, 10, 6).select("vec_id", "y", "x", "v"), "v", digits=6)


# spectra

_DFT = (
    f"{v.FIELD8}, ab AS (SELECT vec_id, y, x, v a, v * (1 + 0.1::DOUBLE * x) b FROM field8), c AS (SELECT vec_id, ky, kx, "
    + ", ".join(f"sum({s} * {f}(-2 * pi() * (ky * y + kx * x) / 8)) {p}_{s}" for s in "ab" for p, f in (("re", "cos"), ("im", "sin")))
    + " FROM ab CROSS JOIN range(8) i(ky) CROSS JOIN range(5) j(kx) GROUP BY 1, 2, 3), m AS (SELECT ky, kx, avg(re_a * re_a + im_a * im_a) pa, avg(re_b * re_b + im_b * im_b) pb, avg(re_a * re_b + im_a * im_b) re, avg(im_a * re_b - re_a * im_b) im FROM c GROUP BY 1, 2)"
)


def _spectrum(spark: SparkSession, sf: str) -> DataFrame:
    ab = v.field8(spark, sf).select("vec_id", "y", "x", F.col("v").alias("a"), (F.col("v") * (1 + 0.1 * F.col("x"))).alias("b"))
    return spectral.power(spectral.rfft2(ab, 8, 8, ["vec_id"], ["a", "b"]), "a", "b")


@query(f"WITH {_DFT} SELECT CAST(ky AS INT) ky, CAST(kx AS INT) kx, round(pa, 6) power_a, round(pb, 6) power_b, round(pb / (pa + {_E}), 4) ratio FROM m")
def fft_power(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(_spectrum(spark, sf).drop("coherence"), "power_a", "power_b", digits=6), "ratio")


@query(f"WITH {_DFT} SELECT CAST(ky AS INT) ky, CAST(kx AS INT) kx, round(least(1, greatest(0, sqrt(re * re + im * im) / (sqrt(pa) * sqrt(pb) + {_E}))), 5) coherence FROM m")
def coherence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_spectrum(spark, sf).select("ky", "kx", "coherence"), "coherence", digits=5)


_KM = "111.32::DOUBLE"
_RADIAL = (
    f"{v.SPINE}, f AS (SELECT t, y, x, coalesce(an, 0) a FROM grid_spine), f0 AS (SELECT t, y, x, (a - avg(a) OVER (PARTITION BY t)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * y / 8)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * x / 12)) a FROM f), "
    "c AS (SELECT t, i, j, power(sum(a * cos(2 * pi() * (i * y / 8 + j * x / 12))), 2) + power(sum(a * sin(2 * pi() * (i * y / 8 + j * x / 12))), 2) p FROM f0 CROSS JOIN range(8) a(i) CROSS JOIN range(7) b(j) GROUP BY 1, 2, 3), "
    f"l AS (SELECT i, j, 1 / sqrt(power((CASE WHEN i < 4 THEN i ELSE i - 8 END) / (16 * {_KM}), 2) + power(j / (36 * {_KM}) / cos(radians(45 - 2 * i)), 2)) len FROM range(8) a(i), range(7) b(j) WHERE i + j > 0), "
    "e AS (SELECT min(len) lo, max(len) hi FROM l WHERE i = 0), g AS (SELECT i, j, CASE WHEN len < lo OR len >= hi THEN NULL ELSE floor(ln(len / lo) / (ln(hi / lo) / 9)) END bin FROM l, e)"
)


@query(f"WITH {_RADIAL} SELECT CAST(k AS BIGINT) bin, round(lo * (power(hi / lo, k / 9) + power(hi / lo, (k + 1) / 9)) / 2, 6) wavelength_km, round(s / n, 0) power FROM range(9) r(k) CROSS JOIN e LEFT JOIN (SELECT bin, sum(p) s, count(*) n FROM c JOIN g USING (i, j) GROUP BY 1) h ON h.bin = k")
def radial_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Time-mean radial spectra."""
    g = v.grid_spine(spark, sf).withColumn("lat", 45.0 - 2.0 * F.col("y"))
    return rounded(rounded(spectral.radial_spectrum(g, "an", 3.0, 2.0, n_bins=10), "wavelength_km", digits=6), "power", digits=0)


def _welch_sql(lines: str, starts: str, nfft: int, keys: str) -> str:
    """d: densities of segments. lines: (keys, n: points of a line, pos, a). starts: (n, size, s). Only the last frequency is not doubled."""
    return (
        f"lines AS ({lines}), starts AS ({starts}), seg AS (SELECT {keys}, size, s, pos - s i, a - avg(a) OVER (PARTITION BY {keys}, size, s) a, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (pos - s) / size) w FROM lines JOIN starts USING (n) WHERE pos BETWEEN s AND s + size - 1), "
        f"d AS (SELECT {keys}, size, s, k, (power(sum(a * w * cos(2 * pi() * k * i / {nfft})), 2) + power(sum(a * w * sin(2 * pi() * k * i / {nfft})), 2)) / sum(w * w) * CASE WHEN k < {nfft // 2} THEN 2 ELSE 1 END d FROM seg CROSS JOIN range(1, {nfft // 2 + 1}) r(k) GROUP BY {keys}, size, s, k)"
    )


@query(f"WITH {v.SPINE}, {_welch_sql('SELECT t, y, 12 n, x pos, coalesce(an, 0) a FROM grid_spine', 'SELECT 12 n, 12 size, 0 s', 100, 't, y')} SELECT CAST(k AS BIGINT) k, round(k / 100, 4) freq, round(avg(d), 0) density FROM d GROUP BY 1, 2")
def psd_welch_1d(spark: SparkSession, sf: str) -> DataFrame:
    rows = spectral.welch_rows(v.grid_spine(spark, sf).fillna(0.0), "an", ["t", "y"])
    return rounded(rounded(rows.groupBy("k").agg(F.avg("freq").alias("freq"), F.avg("density").alias("density")), "freq"), "density", digits=0)


@query(f"WITH {_DFT} SELECT CAST(ky AS INT) ky, CAST(kx AS INT) kx, round(pa / coalesce(nullif(sum(pa) OVER (PARTITION BY ky), 0), 1), 6) power_a FROM m")
def row_normalised_psd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spectral.row_share(_spectrum(spark, sf).select("ky", "kx", "power_a"), "power_a", ["ky"]), "power_a", digits=6)


@query(f"WITH {_DFT} SELECT CAST(ky AS INT) ky, CAST(kx AS INT) kx, round(ln(pa), 5) log_power, round(pa / max(pa) OVER (), 6) share FROM m")
def log_power(spark: SparkSession, sf: str) -> DataFrame:
    p = _spectrum(spark, sf)
    top = p.agg(F.max("power_a").alias("_top"))
    return p.crossJoin(F.broadcast(top)).select("ky", "kx", F.round(F.ln("power_a"), 5).alias("log_power"), F.round(F.col("power_a") / F.col("_top"), 6).alias("share"))


@query(f"WITH {_DFT}, q AS (SELECT ln(pa) v FROM m WHERE pa > 0) SELECT round(min(v), 5) lo, round(max(v), 5) hi, round(CASE WHEN min(v) < 0 AND max(v) > 0 THEN 0 ELSE (min(v) + max(v)) / 2 END, 5) centre FROM q")
def psd_range(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = F.min(F.ln("power_a")), F.max(F.ln("power_a"))
    centre = F.when((lo < 0) & (hi > 0), 0.0).otherwise((lo + hi) / 2)
    return rounded(_spectrum(spark, sf).where("power_a > 0").agg(lo.alias("lo"), hi.alias("hi"), centre.alias("centre")), "lo", "hi", "centre", digits=5)


_SEASON = "CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) IN (3, 4, 5) THEN 'MAM' WHEN month(t) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
_CUBE = (
    f"{v.PAIR}, {v.PAIRS}, maps AS (SELECT {_SEASON} season, model, y, x, avg(b) mean, var_pop(b) variance, sqrt(avg((b - a) * (b - a))) rmse FROM pairs GROUP BY 1, 2, 3, 4), "
    "cube AS (SELECT season, model, y, x, 'mean' metric, mean a FROM maps UNION ALL SELECT season, model, y, x, 'variance', variance FROM maps UNION ALL SELECT season, model, y, x, 'rmse', rmse FROM maps), "
    + _welch_sql(
        "SELECT season, model, metric, 'x' along, y line, 12 n, x pos, a FROM cube UNION ALL SELECT season, model, metric, 'y', x, 8, y, a FROM cube",
        "SELECT n, size, s FROM (VALUES (8), (12)) a(n), (VALUES (4), (8)) b(size), range(12) r(s) WHERE s % (size // 2) = 0 AND s + size <= n", 16, "season, model, metric, along, line"
    )
)


@query(f"WITH {_CUBE} SELECT season, model, metric, along, CAST(size AS INT) size, CAST(k AS BIGINT) k, round(k / 16, 4) freq, round(log10(avg(d)), 7) log_density FROM d GROUP BY 1, 2, 3, 4, 5, 6, 7")
def psd_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Spectra along both axes of seasonal means, variances and errors of both models, for several window sizes: one plan for all of them."""
    error = F.col("b") - F.col("a")
    maps = pairs(spark, sf).withColumn("season", stats.season(F.col("t"))).groupBy("season", "model", "y", "x").agg(F.avg("b").alias("mean"), F.var_pop("b").alias("variance"), F.sqrt(F.avg(error * error)).alias("rmse"))
    long = maps.unpivot(["season", "model", "y", "x"], ["mean", "variance", "rmse"], "metric", "value")
    cube = rounded(spectral.psd_cube(long, "value", ["season", "model", "metric"], [4, 8], nfft=16), "freq")
    return cube.withColumn("log_density", F.round(F.log10("density"), 7)).drop("density")


@query(f"WITH {v.PAIR}, {v.PAIRS} SELECT model, round(avg(abs(a - b)), 4) mae, round(sqrt(avg((a - b) * (a - b))), 4) rmse FROM pairs GROUP BY 1")
def pooled_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(verify.cell_metrics(pairs(spark, sf), ["model"], ["mae", "rmse"]), "mae", "rmse")


@query(
    f"WITH {v.CURV}, d AS (SELECT 'lon' axis, abs(lon - lag(lon) OVER (ORDER BY x)) d FROM grid_curv WHERE y = 4 UNION ALL SELECT 'lat', abs(lat - lag(lat) OVER (ORDER BY y)) FROM grid_curv WHERE x = 6) SELECT axis, count(d) n, round(avg(d), 6) mean, round(stddev_pop(d), 6) std FROM d GROUP BY 1"
)
def spacing_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curvilinear.spacing(v.grid_curv(spark, sf)).drop("cv"), "mean", "std", digits=6)


def _area(p: str, q: str) -> tuple[str, str, str]:
    """det, w1 * det and w2 * det of the triangle p, q, d around the target (la, lo)."""
    return (
        f"(({q}.lat - d.lat) * ({p}.lon - d.lon) + (d.lon - {q}.lon) * ({p}.lat - d.lat))",
        f"(({q}.lat - d.lat) * (lo - d.lon) + (d.lon - {q}.lon) * (la - d.lat))",
        f"((d.lat - {p}.lat) * (lo - d.lon) + ({p}.lon - d.lon) * (la - d.lat))",
    )


_QUADS = "FROM grid_curv a JOIN grid_curv {q} ON {on} JOIN grid_curv d ON d.y = a.y + 1 AND d.x = a.x + 1 CROSS JOIN targets"
_HALVES = " UNION ALL ".join(
    f"SELECT ty, tx, a.y, a.x, {k} k, {w1} / {det} w1, {w2} / {det} w2, 1 - {w1} / {det} - {w2} / {det} w3, {q}.y qy, {q}.x qx {_QUADS.format(q=q, on=on)}"
    for k, q, on in ((0, "b", "b.y = a.y AND b.x = a.x + 1"), (1, "c", "c.y = a.y + 1 AND c.x = a.x"))
    for det, w1, w2 in (_area("a", q),)
)
_REGRID = (
    f"{v.PAIR}, {v.CURV}, targets AS (SELECT ty, tx, CAST(44 - ty AS DOUBLE) la, CAST(-128 + 2 * tx AS DOUBLE) lo FROM range(12) a(ty), range(15) b(tx)), tri AS ({_HALVES}), "
    "one AS (SELECT * FROM tri WHERE least(w1, w2, w3) >= -1e-9::DOUBLE QUALIFY row_number() OVER (PARTITION BY ty, tx ORDER BY y, x, k) = 1), "
    "weights AS (SELECT ty, tx, y, x, w1 w FROM one UNION ALL SELECT ty, tx, qy, qx, w2 FROM one UNION ALL SELECT ty, tx, y + 1, x + 1, w3 FROM one)"
)


_APPLIED = "SELECT t, ty, tx, CASE WHEN sum(w) FILTER (WHERE an IS NOT NULL) > 1 - 1e-9::DOUBLE THEN sum(an * w) END v FROM grid_pair JOIN {weights} USING (y, x) GROUP BY 1, 2, 3"
_EVERY = "(SELECT DISTINCT t FROM grid_pair) m CROSS JOIN targets"
_CURV_LAT, _CURV_LON = [44.0 - k for k in range(12)], [-128.0 + 2.0 * k for k in range(15)]


@query(f"WITH {_REGRID}, r AS ({_APPLIED.format(weights='weights')}) SELECT t, CAST(ty AS INT) y, CAST(tx AS INT) x, round(v, 4) an FROM {_EVERY} LEFT JOIN r USING (t, ty, tx)")
def regrid_curvilinear(spark: SparkSession, sf: str) -> DataFrame:
    """All months of the grid as if it were curvilinear, by halves of its quads."""
    df = v.grid_pair(spark, sf).select("t", "y", "x", "an")
    return rounded(curvilinear.regrid_any(df, v.grid_curv(spark, sf), _CURV_LAT, _CURV_LON, ["t"], ["an"], by="quads"), "an")


# scattered points: in SQL all triangles around a target are compared, and all points

_TRIPLES = (
    "pts AS (SELECT *, 1e-6::DOUBLE * (((y * y * 349 + x * x * 617 + y * x * 211) % 1009) / 1009::DOUBLE) e FROM grid_scatter), "
    "triples AS (SELECT a.y ay, a.x ax, b.y qy, b.x qx, c.y cy, c.x cx, a.lat al, a.lon ao, b.lat bl, b.lon bo, c.lat cl, c.lon co, a.e ae, b.e be, c.e ce, (b.lat - a.lat) * (c.lon - a.lon) - (b.lon - a.lon) * (c.lat - a.lat) det "
    "FROM pts a JOIN pts b ON (a.y, a.x) < (b.y, b.x) JOIN pts c ON (b.y, b.x) < (c.y, c.x)), "
    "held AS (SELECT *, 1 - w1 - w2 w3 FROM (SELECT *, ((bl - la) * (co - lo) - (bo - lo) * (cl - la)) / det w1, ((cl - la) * (ao - lo) - (co - lo) * (al - la)) / det w2 FROM triples CROSS JOIN targets WHERE abs(det) > 1e-9::DOUBLE) WHERE w1 >= -1e-9::DOUBLE AND w2 >= -1e-9::DOUBLE AND w1 + w2 <= 1 + 1e-9::DOUBLE), "
    "best AS (SELECT ty, tx, min_by({'ay': ay, 'ax': ax, 'qy': qy, 'qx': qx, 'cy': cy, 'cx': cx, 'w1': w1, 'w2': w2, 'w3': w3}, w1 * ((al - la) ** 2 + (ao - lo) ** 2 + ae) + w2 * ((bl - la) ** 2 + (bo - lo) ** 2 + be) + w3 * ((cl - la) ** 2 + (co - lo) ** 2 + ce)) s FROM held GROUP BY 1, 2), "
    "tri AS (SELECT ty, tx, s.ay y, s.ax x, greatest(s.w1, 0) w FROM best UNION ALL SELECT ty, tx, s.qy, s.qx, greatest(s.w2, 0) FROM best UNION ALL SELECT ty, tx, s.cy, s.cx, greatest(s.w3, 0) FROM best)"
)
_NEAR = "near AS (SELECT ty, tx, p.y y, p.x x, 1e0 w FROM (SELECT ty, tx, min({'d': (lat - la) * (lat - la) + (lon - lo) * (lon - lo), 'y': y, 'x': x}) p FROM targets CROSS JOIN grid_scatter GROUP BY 1, 2))"
_TARGETS = "targets AS (SELECT ty, tx, CAST(46 - 2 * ty AS DOUBLE) la, CAST(-133 + 3 * tx AS DOUBLE) lo FROM range(9) a(ty), range(14) b(tx))"
_FAR_LAT, _FAR_LON = [46.0 - 2.0 * k for k in range(9)], [-133.0 + 3.0 * k for k in range(14)]


@query(f"WITH {v.SCATTER}, {_TARGETS}, {_TRIPLES} SELECT CAST(ty AS INT) ty, CAST(tx AS INT) tx, y, x, round(w, 6) w FROM tri WHERE w > 1e-6::DOUBLE")
def delaunay_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Corners and weights of the Delaunay triangle of scattered cells that holds a target."""
    weights = scatter.triangulation_weights(v.grid_scatter(spark, sf), curvilinear.target_cells(spark, _FAR_LAT, _FAR_LON))
    return rounded(weights.where("w > 1e-6"), "w", digits=6)


@query(f"WITH {v.SCATTER}, {_TARGETS}, {_NEAR} SELECT CAST(ty AS INT) ty, CAST(tx AS INT) tx, y, x FROM near")
def nearest_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Of scattered cells the one nearest to a target, inside their hull and outside."""
    return scatter.nearest_points(v.grid_scatter(spark, sf), curvilinear.target_cells(spark, _FAR_LAT, _FAR_LON)).drop("w")


def _scattered(fill: bool) -> str:
    value = "coalesce(r.v, n.v)" if fill else "r.v"
    return (
        f"WITH {v.PAIR}, {v.SCATTER}, {_TARGETS}, {_TRIPLES}, {_NEAR}, r AS ({_APPLIED.format(weights='tri')}), n AS ({_APPLIED.format(weights='near')}) "
        f"SELECT m.t, CAST(targets.ty AS INT) y, CAST(targets.tx AS INT) x, round({value}, 4) an FROM {_EVERY} LEFT JOIN r ON r.t = m.t AND r.ty = targets.ty AND r.tx = targets.tx LEFT JOIN n ON n.t = m.t AND n.ty = targets.ty AND n.tx = targets.tx"
    )


def _regrid_scattered(spark: SparkSession, sf: str, fill: str) -> DataFrame:
    df = v.grid_pair(spark, sf).select("t", "y", "x", "an")
    return rounded(curvilinear.regrid_any(df, v.grid_scatter(spark, sf), _FAR_LAT, _FAR_LON, ["t"], ["an"], fill), "an")


query(_scattered(False), "regrid_scattered")(lambda spark, sf: _regrid_scattered(spark, sf, "null"))
query(_scattered(True), "regrid_nearest")(lambda spark, sf: _regrid_scattered(spark, sf, "nearest"))

_FILLED = (
    "valid AS (SELECT t, y, x, an, 1e-6::DOUBLE * (((y * y * 349 + x * x * 617 + y * x * 211) % 1009) / 1009::DOUBLE) e FROM grid_spine WHERE an IS NOT NULL), "
    "gaps AS (SELECT t, y gy, x gx FROM grid_spine JOIN (SELECT t FROM valid GROUP BY 1 HAVING count(*) >= 4) USING (t) WHERE an IS NULL), "
    "triples AS (SELECT a.t, a.y ay, a.x ax, b.y qy, b.x qx, c.y cy, c.x cx, a.an av, b.an bv, c.an cv, a.e ae, b.e be, c.e ce, (b.y - a.y) * (c.x - a.x) - (b.x - a.x) * (c.y - a.y) det "
    "FROM valid a JOIN valid b ON a.t = b.t AND (a.y, a.x) < (b.y, b.x) JOIN valid c ON a.t = c.t AND (b.y, b.x) < (c.y, c.x)), "
    "held AS (SELECT *, (det - d1 - d2) / det::DOUBLE w3, d1 / det::DOUBLE w1, d2 / det::DOUBLE w2 FROM (SELECT *, (qy - gy) * (cx - gx) - (qx - gx) * (cy - gy) d1, (cy - gy) * (ax - gx) - (cx - gx) * (ay - gy) d2 FROM triples JOIN gaps USING (t) WHERE det <> 0) "
    "WHERE sign(det) * d1 >= 0 AND sign(det) * d2 >= 0 AND sign(det) * (det - d1 - d2) >= 0), "
    "inner_ AS (SELECT t, gy, gx, min_by(w1 * av + w2 * bv + w3 * cv, w1 * ((ay - gy) ** 2 + (ax - gx) ** 2 + ae) + w2 * ((qy - gy) ** 2 + (qx - gx) ** 2 + be) + w3 * ((cy - gy) ** 2 + (cx - gx) ** 2 + ce)) v FROM held GROUP BY 1, 2, 3), "
    "outer_ AS (SELECT t, gy, gx, p.v v FROM (SELECT t, gy, gx, min({'d': (y - gy) ** 2 + (x - gx) ** 2, 'y': y, 'x': x, 'v': an}) p FROM gaps JOIN valid USING (t) GROUP BY 1, 2, 3))"
)


@query(f"WITH {v.SPINE}, {_FILLED} SELECT g.t, g.y, g.x, round(coalesce(g.an, i.v, o.v), 3) an FROM grid_spine g LEFT JOIN inner_ i ON i.t = g.t AND i.gy = g.y AND i.gx = g.x LEFT JOIN outer_ o ON o.t = g.t AND o.gy = g.y AND o.gx = g.x")
def inpaint(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells of every month from triangles of its valid ones, else from the nearest."""
    return rounded(grid.inpaint(v.grid_spine(spark, sf), "an", {"y": 8, "x": 12}, ["t"]), "an", digits=3)


@query(f"WITH {v.PAIR}, {v.PAIRS}, r AS (SELECT model, t, corr(a, b) r FROM pairs GROUP BY 1, 2) SELECT model, round(avg(r) FILTER (WHERE NOT isnan(r)), 6) correlation FROM r GROUP BY 1")
def spatial_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(verify.spatial_correlation(pairs(spark, sf), ["t"], ["model"]), "correlation", digits=6)


@query(f"WITH {v.PAIR} SELECT round((max_by(lat, y) - min_by(lat, y)) / (max(y) - min(y)), 6) dy, round((max_by(lon, x) - min_by(lon, x)) / (max(x) - min(x)), 6) dx FROM grid_pair")
def grid_info(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid.grid_info(v.grid_pair(spark, sf)), "dy", "dx", digits=6)


@query(f"WITH {v.SERIES} SELECT variable, max_by(t, value) best, min_by(t, value) worst FROM series GROUP BY 1")
def extreme_times(spark: SparkSession, sf: str) -> DataFrame:
    return v.series(spark, sf).groupBy("variable").agg(F.max_by("t", "value").alias("best"), F.min_by("t", "value").alias("worst"))


@query(f"WITH {v.SPINE} SELECT t, y, x, round(an, 4) an, round(fc, 4) fc FROM grid_spine WHERE t BETWEEN TIMESTAMP '1996-05-01' AND TIMESTAMP '1998-11-01' AND 45 - 2 * y BETWEEN 35 AND 43 AND -130 + 3 * x BETWEEN -121 AND -106")
def chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """A period and a box of the grid, read back from a store of chunks that the query has written to the shared folder."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    write_zarr(v.grid_pair(spark, sf), path, ["an", "fc"], {"t": 12, "y": 4, "x": 6})
    cells = read_zarr(spark, path, bounds={"t": (datetime(1996, 5, 1), datetime(1998, 11, 1)), "lat": (35.0, 43.0), "lon": (-121.0, -106.0)})
    return rounded(cells.select("t", "y", "x", "an", "fc"), "an", "fc")


# archives of files, merges of several sources, samples

_MODE = f"SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) t, l_returnflag || l_linestatus mode, CAST(6 * (l_linenumber % 3) AS DOUBLE) lead, CAST(l_suppkey % 8 AS INT) y, CAST(l_partkey % 12 AS INT) x, avg({v._P}) an, avg({v._P} * (1 - l_discount)) fc FROM lineitem GROUP BY 1, 2, 3, 4, 5"


@query(
    f"WITH c AS ({_MODE}), k AS (SELECT *, dense_rank() OVER (ORDER BY mode) - 1 k FROM c), n AS (SELECT year(t) y4, k, min(abs(lead - 7) * 100 + lead) best FROM k GROUP BY 1, 2) "
    "SELECT k.t, CAST(k.k AS INT) realization, lead, y, x, round(an / 1000, 4) an, CASE WHEN mode <> 'RF' THEN round(fc, 4) END fc FROM k JOIN n ON year(k.t) = n.y4 AND k.k = n.k AND abs(lead - 7) * 100 + lead = best"
)
def file_members(spark: SparkSession, sf: str) -> DataFrame:
    """An archive with a file per year and member, some without a variable, written to the shared folder and read file by file: members by name,
    the lead time nearest to 7 hours, a change of units inside the reading task."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    line = v.table(spark, sf, "lineitem")
    price, d = F.col("l_extendedprice") * v.UNIT, F.col("l_discount")
    y, x = (F.col("l_suppkey") % 8).cast("int").alias("y"), (F.col("l_partkey") % 12).cast("int").alias("x")
    lead = (6 * (F.col("l_linenumber") % 3)).cast("double").alias("lead")
    cells = line.select(v.month(F.col("l_shipdate")).alias("t"), F.concat("l_returnflag", "l_linestatus").alias("mode"), lead, y, x, price.alias("an"), (price * (1 - d)).alias("fc"))
    cells = cells.groupBy("t", "mode", "lead", "y", "x").agg(F.avg("an").alias("an"), F.avg("fc").alias("fc"))
    lacks = F.col("mode") == "RF"
    for part, rows in (("whole", cells.where(~lacks)), ("bare", cells.where(lacks).drop("fc"))):
        rows.withColumn("year", F.year("t")).repartition("year", "mode").write.partitionBy("year", "mode").parquet(f"{root}/{part}")
    found = files.listing(spark, root, "*.parquet")
    found = found.select("path", "mtime", F.regexp_extract("path", "mode=([^/]+)", 1).alias("mode"), F.make_date(F.regexp_extract("path", "year=([0-9]+)", 1).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("t"))
    read = perfile.read_members(spark, perfile.numbered(found, ["mode"]), f"{root}/read", ["an", "fc"], lead=7.0, step=lambda rows, request: rows.assign(an=rows["an"] / 1000))
    return rounded(read.rows().select("t", "realization", "lead", "y", "x", "an", "fc"), "an", "fc")


_PARTS = "p1 AS (SELECT t, y, x, an FROM grid_pair WHERE x < 8), p2 AS (SELECT t, y, x, an, fc FROM grid_pair WHERE x >= 4), p3 AS (SELECT t, y, x, pr FROM grid_pair WHERE y % 3 <> 0)"


def _parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    pair = v.grid_pair(spark, sf)
    cut = [pair.where("x < 8").select("t", "y", "x", "an"), pair.where("x >= 4").select("t", "y", "x", "an", "fc"), pair.where("y % 3 <> 0").select("t", "y", "x", "pr")]
    # rounded, as means of two scans may differ in their last bits
    return [rounded(p, *[c for c in p.columns if c not in ("t", "y", "x")]) for p in cut]


@query(f"WITH {v.PAIR}, {_PARTS} SELECT t, y, x, round(coalesce(p1.an, p2.an), 4) an, round(fc, 4) fc, round(pr, 4) pr FROM p1 FULL JOIN p2 USING (t, y, x) FULL JOIN p3 USING (t, y, x)")
def merge_no_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.combine_variables(_parts(spark, sf), ["t", "y", "x"])


@query(
    f"WITH {v.PAIR}, l AS (SELECT t, y, x, round(an, 2) an FROM grid_pair), r AS (SELECT t, y, x, round(CASE WHEN (y + x) % 4 = 0 THEN pr ELSE an END, 2) an FROM grid_pair) "
    "SELECT t, y, x, 'an' variable, least(l.an, r.an) low, greatest(l.an, r.an) high FROM l JOIN r USING (t, y, x) WHERE l.an <> r.an"
)
def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Where two archives of one variable disagree."""
    pair = v.grid_pair(spark, sf)
    other = pair.select("t", "y", "x", F.when((F.col("y") + F.col("x")) % 4 == 0, F.col("pr")).otherwise(F.col("an")).alias("an"))
    return experiment.conflicts([rounded(p, "an", digits=2) for p in (pair.select("t", "y", "x", "an"), other)], ["t", "y", "x"])


@query(ORACLE["quantiles"])
def quantiles_by_selection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.quantiles_by_selection(v.long(spark, sf), "variable", "value", _Q), "value")


@query(
    f"WITH {v.SPINE}, s AS (SELECT t, md5('11|' || CAST(t AS VARCHAR)) code, CAST(count(fc) AS BIGINT) x_valid, CAST(count(an) AS BIGINT) y_valid, round(coalesce(sum(fc), 0), 2) x_sum, round(coalesce(sum(an), 0), 2) y_sum FROM grid_spine GROUP BY 1), "
    "d AS (SELECT *, CAST(CAST('0x' || substr(code, 1, 7) AS BIGINT) % 3 AS INT) shard FROM s), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY shard ORDER BY code) - 1 AS INT) place FROM d) "
    "SELECT t, shard, CAST(place // 4 AS INT) batch, place, CAST(96 AS INT) size, x_valid, y_valid, x_sum, y_sum FROM p"
)
def sample_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Fields as samples with masks, in seeded batches; what each holds, counted and summed from its arrays."""
    packed = samples.pack(v.grid_spine(spark, sf), ["t"], ["fc"], ["an"], 8, 12)
    dealt = samples.shuffled(packed, ["t"], 11, 3, 4)

    def total(c: str):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 2)

    def valid(c: str):
        return F.size(F.filter(c, lambda m: m)).cast("long")

    return dealt.select("t", "shard", "batch", "place", F.size("x").alias("size"), valid("x_mask").alias("x_valid"), valid("y_mask").alias("y_valid"), total("x").alias("x_sum"), total("y").alias("y_sum"))


@query(f"WITH {v.PAIR} SELECT t, CAST(7 - y AS INT) y, x, lat, round(an, 4) an FROM grid_pair")
def axis_increasing(spark: SparkSession, sf: str) -> DataFrame:
    """Latitudes run down in the tables' grid; here up."""
    return rounded(grid.increasing(v.grid_pair(spark, sf).select("t", "y", "x", "lat", "an"), "lat", "y"), "an")


@query(f"WITH {v.PAIR}, m AS (SELECT *, CASE WHEN lon < -115 THEN lon + 360 ELSE lon END lon360 FROM grid_pair), k AS (SELECT x, CAST(row_number() OVER (ORDER BY lon360) - 1 AS INT) k FROM (SELECT DISTINCT x, lon360 FROM m)) SELECT t, y, k.k x, lon360 lon, round(an, 4) an FROM m JOIN k USING (x)")
def axis_rolled(spark: SparkSession, sf: str) -> DataFrame:
    """The grid cut at 115 degrees west, columns numbered from there."""
    return rounded(grid.rolled(v.grid_pair(spark, sf).select("t", "y", "x", "lon", "an"), -115.0), "an")


@query(f"WITH {v.MEMBER}, a AS (SELECT *, dense_rank() OVER (ORDER BY t) k FROM grid_member), b AS (SELECT *, dense_rank() OVER (ORDER BY realization DESC) r FROM a WHERE k = 6) SELECT t, realization, y, x, round(an, 4) an FROM b WHERE r = 2")
def index_slice(spark: SparkSession, sf: str) -> DataFrame:
    """A field by numbers: the sixth month, then the last member but one."""
    return rounded(grid.at_index(v.grid_member(spark, sf), t=5, realization=-2).select("t", "realization", "y", "x", "an"), "an")


# windows of a stream, here over a table

@query(
    f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END \"start\", event_type variable, count(*) n, round(avg(value * {v.UNIT}::DOUBLE - 1.5::DOUBLE), 4) bias, round(avg(abs(value * {v.UNIT}::DOUBLE - 1.5::DOUBLE)), 4) mae, round(sqrt(avg((value * {v.UNIT}::DOUBLE - 1.5::DOUBLE) * (value * {v.UNIT}::DOUBLE - 1.5::DOUBLE))), 4) rmse FROM events GROUP BY 1, 2"
)
def windowed_verification(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").select(F.col("ts").alias("t"), F.col("event_type").alias("variable"), (F.col("value") * v.UNIT).alias("a"), F.lit(1.5).alias("b"))
    return rounded(windowed(e), "bias", "mae", "rmse")
