"""Gridded views of the driver's tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A unit conversion of the values; it also keeps means off decimal ties, which two engines may round differently.
UNIT = 0.98765432101


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def month(t: Column) -> Column:
    return F.date_trunc("month", t).cast("timestamp_ntz")


def _cells(spark: SparkSession, sf: str, *extra: Column) -> DataFrame:
    line = table(spark, sf, "lineitem")
    price, d, tax = F.col("l_extendedprice") * UNIT, F.col("l_discount"), F.col("l_tax")
    y, x = (F.col("l_suppkey") % 8).cast("int"), (F.col("l_partkey") % 12).cast("int")
    keyed = line.select(month(F.col("l_shipdate")).alias("t"), *extra, y.alias("y"), x.alias("x"), price.alias("an"), (price * (1 - d) * (1 + tax)).alias("fc"), (price * (1 - d / 2) * (1 + tax / 2)).alias("pr"))
    means = keyed.groupBy("t", *[c for c in keyed.columns if c == "realization"], "y", "x").agg(*[F.avg(c).alias(c) for c in ("an", "fc", "pr")])
    return means.withColumns({"lat": 45.0 - 2.0 * F.col("y"), "lon": -130.0 + 3.0 * F.col("x")})


def grid_pair(spark: SparkSession, sf: str) -> DataFrame:
    """(t, y, x, an, fc, pr, lat, lon): truth and two forecasts on an 8 x 12 grid by month."""
    return _cells(spark, sf)


def grid_member(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, (F.col("l_linenumber") - 1).cast("int").alias("realization"))


def grid_spine(spark: SparkSession, sf: str) -> DataFrame:
    """Every month and cell; missing ones are null."""
    pair = grid_pair(spark, sf)
    months = pair.select("t").distinct()
    ys, xs = (spark.range(n).select(F.col("id").cast("int").alias(c)) for c, n in (("y", 8), ("x", 12)))
    return months.crossJoin(F.broadcast(ys.crossJoin(xs))).join(pair.select("t", "y", "x", "an", "fc", "pr"), ["t", "y", "x"], "left")


def grid_curv(spark: SparkSession, sf: str) -> DataFrame:
    """(y, x, lat, lon, v): the cells that occur, sheared; v is their number of rows."""
    line = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 8).cast("int").alias("y"), (F.col("l_partkey") % 12).cast("int").alias("x"))
    cells = line.groupBy("y", "x").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return cells.select("y", "x", (45.0 - 2.0 * F.col("y") + 0.1 * F.col("x")).alias("lat"), (-130.0 + 3.0 * F.col("x") + 0.2 * F.col("y")).alias("lon"), "v")


def grid_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """(y, x, lat, lon): the cells of every fifth diagonal left out, the others moved about by their numbers of rows."""
    moved = grid_curv(spark, sf).where((F.col("y") + F.col("x")) % 5 != 0)
    return moved.select("y", "x", (F.col("lat") + F.col("v") % 7 * 0.125).alias("lat"), (F.col("lon") + F.col("v") % 11 * 0.125).alias("lon"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """(t, variable, value): means of events by 12 hours and type."""
    e = table(spark, sf, "events")
    t = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.when(F.hour("ts") >= 12, F.expr("interval 12 hours")).otherwise(F.expr("interval 0 hours"))
    return e.groupBy(t.cast("timestamp_ntz").alias("t"), F.col("event_type").alias("variable")).agg(F.avg(F.col("value") * UNIT).alias("value"))


def field8(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, y, x, v): embeddings as 8 x 8 fields."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return e.select("vec_id", (F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


# the same in SQL
_P = f"(l_extendedprice * {UNIT}::DOUBLE)"
_MEANS = f"avg({_P}) an, avg({_P} * (1 - l_discount) * (1 + l_tax)) fc, avg({_P} * (1 - l_discount / 2) * (1 + l_tax / 2)) pr"
_KEYS = "CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) t, CAST(l_suppkey % 8 AS INT) y, CAST(l_partkey % 12 AS INT) x"
PAIR = f"grid_pair AS (SELECT *, CAST(45 - 2 * y AS DOUBLE) lat, CAST(-130 + 3 * x AS DOUBLE) lon FROM (SELECT {_KEYS}, {_MEANS} FROM lineitem GROUP BY 1, 2, 3))"
MEMBER = f"grid_member AS (SELECT {_KEYS}, CAST(l_linenumber - 1 AS INT) realization, {_MEANS} FROM lineitem GROUP BY 1, 2, 3, 4)"
SPINE = PAIR + ", grid_spine AS (SELECT m.t, CAST(ys.y AS INT) y, CAST(xs.x AS INT) x, an, fc, pr FROM (SELECT DISTINCT t FROM grid_pair) m CROSS JOIN range(8) ys(y) CROSS JOIN range(12) xs(x) LEFT JOIN grid_pair g ON g.t = m.t AND g.y = ys.y AND g.x = xs.x)"
CURV = "grid_curv AS (SELECT CAST(y AS INT) y, CAST(x AS INT) x, CAST(45 - 2 * y AS DOUBLE) + 0.1::DOUBLE * x lat, CAST(-130 + 3 * x AS DOUBLE) + 0.2::DOUBLE * y lon, CAST(n AS DOUBLE) v FROM (SELECT CAST(l_suppkey % 8 AS INT) y, CAST(l_partkey % 12 AS INT) x, count(*) n FROM lineitem GROUP BY 1, 2))"
SCATTER = CURV + ", grid_scatter AS (SELECT y, x, lat + v % 7 * 0.125::DOUBLE lat, lon + v % 11 * 0.125::DOUBLE lon FROM grid_curv WHERE (y + x) % 5 <> 0)"
SERIES = f"series AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END t, event_type variable, avg(value * {UNIT}::DOUBLE) value FROM events GROUP BY 1, 2)"
FIELD8 = "field8 AS (SELECT vec_id, CAST((p - 1) // 8 AS INT) y, CAST((p - 1) % 8 AS INT) x, CAST(embedding[p] AS DOUBLE) v FROM embeddings, range(1, 65) r(p))"
LONG = "long AS (SELECT t, y, x, lat, 'an' variable, an value FROM grid_pair UNION ALL SELECT t, y, x, lat, 'fc', fc FROM grid_pair UNION ALL SELECT t, y, x, lat, 'pr', pr FROM grid_pair)"
PAIRS = "pairs AS (SELECT t, y, x, lat, an a, 'fc' model, fc b FROM grid_pair UNION ALL SELECT t, y, x, lat, an, 'pr', pr FROM grid_pair)"


def long(spark: SparkSession, sf: str) -> DataFrame:
    return grid_pair(spark, sf).unpivot(["t", "y", "x", "lat"], ["an", "fc", "pr"], "variable", "value")
