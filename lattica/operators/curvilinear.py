"""Grids whose coordinates vary along both axes: what kind they are, their spacing, and regridding by triangles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.store import kept
from lattica.operators.grid import curvilinear_resolution, nearest_cells, regrid, resolution, same_axes
from lattica.operators.scatter import nearest_points, triangulation_weights


def _step(df: DataFrame, c: str, along: str, by: str):
    d = F.col(c) - F.lag(c).over(Window.partitionBy(by).orderBy(along))
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0 if c == "lon" else d


def is_rectilinear(df: DataFrame, tolerance: float = 1e-6) -> bool:
    """Whether lat depends on y alone and lon on x alone, though both are given per cell."""
    d = df.select(F.abs(_step(df, "lat", "x", "y")).alias("a"), F.abs(_step(df, "lon", "y", "x")).alias("b")).agg(F.max("a"), F.max("b")).first()
    return all(v is None or v < tolerance for v in d)


def spacing(df: DataFrame) -> DataFrame:
    """Mean, population deviation and variation of neighbour distances along the middle row (lon) and column (lat)."""
    size = df.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).first()
    row = df.where(F.col("y") == (size["h"] or 0) // 2).select(F.lit("lon").alias("axis"), F.abs(_step(df, "lon", "x", "y")).alias("d"))
    column = df.where(F.col("x") == (size["w"] or 0) // 2).select(F.lit("lat").alias("axis"), F.abs(_step(df, "lat", "y", "x")).alias("d"))
    stats = row.union(column).groupBy("axis").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))
    return stats.withColumn("cv", F.try_divide("std", "mean"))


def is_regular(df: DataFrame, variation: float = 0.5, points: int = 10) -> bool:
    return all(r["n"] + 1 >= points and r["cv"] is not None and r["cv"] < variation for r in spacing(df).collect())  # two rows


def grid_resolution(df: DataFrame) -> tuple[float, float]:
    """(dlat, dlon): means of the axes of rectilinear grids and of regular curvilinear ones, else medians of all neighbours."""
    if is_rectilinear(df):
        return tuple(resolution(df).first())
    if is_regular(df):
        got = {r["axis"]: r["mean"] for r in spacing(df).collect()}
        return got["lat"], got["lon"]
    return tuple(curvilinear_resolution(df).first())


def target_axes(lon: tuple[float, float], lat: tuple[float, float], step: float, eps: float = 1e-6) -> tuple[list[float], list[float]]:
    """Both ends included, in the order given; by index, so errors don't add up."""
    out = []
    for a, b in (lat, lon):
        n = math.floor(abs(b - a) / step + eps) + 1
        out.append([a + math.copysign(step, b - a) * k for k in range(n)])
    return out[0], out[1]


def triangle_weights(cells: DataFrame, lat_to: list[float], lon_to: list[float]) -> DataFrame:
    """(ty, tx, y, x, w): barycentric weights of every target in the triangle of source cells that holds it.

    Each quad of neighbouring cells is split along its falling diagonal. A triangle meets the targets inside its bounding box through
    index ranges of the regular target axes, so no triangle is compared with all targets. A target on an edge takes
    the triangle with the lowest number. A target in no triangle has no row. One table serves all times and variables: apply with `apply_weights`.
    """
    step = {"lat": lat_to[1] - lat_to[0] if len(lat_to) > 1 else 1.0, "lon": lon_to[1] - lon_to[0] if len(lon_to) > 1 else 1.0}
    corner = cells.select("y", "x", F.struct("y", "x", "lat", "lon").alias("p"))

    def moved(dy: int, dx: int, name: str) -> DataFrame:
        return corner.select((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("p").alias(name))

    quads = moved(0, 0, "a").join(moved(0, 1, "b"), ["y", "x"]).join(moved(1, 0, "c"), ["y", "x"]).join(moved(1, 1, "d"), ["y", "x"])
    halves = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("p"), F.col("b").alias("q"), F.col("d").alias("r")), F.struct(F.lit(1).alias("k"), F.col("a").alias("p"), F.col("c").alias("q"), F.col("d").alias("r"))))
    tri = quads.select("y", "x", halves.alias("t")).select("y", "x", "t.k", "t.p", "t.q", "t.r")

    def indices(c: str, first: float, n: int):
        ends = [(F.col(f"{v}.{c}") - first) / step[c] for v in "pqr"]
        low, high = F.greatest(F.ceil(F.least(*ends) - 1e-9), F.lit(0)), F.least(F.floor(F.greatest(*ends) + 1e-9), F.lit(n - 1))
        return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))

    met = tri.withColumn("ty", indices("lat", lat_to[0], len(lat_to))).withColumn("tx", indices("lon", lon_to[0], len(lon_to)))
    v, u = F.lit(lat_to[0]) + F.col("ty") * step["lat"], F.lit(lon_to[0]) + F.col("tx") * step["lon"]
    (py, px), (qy, qx), (ry, rx) = ((F.col(f"{n}.lat"), F.col(f"{n}.lon")) for n in "pqr")
    det = (qy - ry) * (px - rx) + (rx - qx) * (py - ry)
    w1 = F.try_divide((qy - ry) * (u - rx) + (rx - qx) * (v - ry), det)
    w2 = F.try_divide((ry - py) * (u - rx) + (px - rx) * (v - ry), det)
    inside = met.withColumns({"w1": w1, "w2": w2}).withColumn("w3", 1.0 - F.col("w1") - F.col("w2")).where(F.least("w1", "w2", "w3") >= -1e-9)
    one = inside.groupBy("ty", "tx").agg(F.min(F.struct("y", "x", "k", "p", "q", "r", "w1", "w2", "w3")).alias("s"))
    parts = F.explode(F.array(*[F.struct(F.col(f"s.{n}.y").alias("y"), F.col(f"s.{n}.x").alias("x"), F.col(f"s.w{k}").alias("w")) for k, n in enumerate("pqr", 1)]))
    return one.select(F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), parts.alias("c")).select("ty", "tx", "c.y", "c.x", "c.w")


def target_cells(spark: SparkSession, lat_to: list[float], lon_to: list[float]) -> DataFrame:
    """(ty, tx, lat, lon) of two axes."""
    lats, lons = (F.array(*map(F.lit, map(float, to))) for to in (lat_to, lon_to))
    at = spark.range(len(lat_to) * len(lon_to)).select(F.floor(F.col("id") / len(lon_to)).cast("int").alias("ty"), (F.col("id") % len(lon_to)).cast("int").alias("tx"))
    return at.select("ty", "tx", F.get(lats, "ty").alias("lat"), F.get(lons, "tx").alias("lon"))


def apply_weights(df: DataFrame, weights: DataFrame, keys: list[str], values: list[str], targets: DataFrame | None = None) -> DataFrame:
    """A sparse product: each value times its weights, summed per target. A target is null where a corner with weight is missing, has no value,
    or where there are no weights; targets (ty, tx) then have a row for every field (keys) all the same."""
    met = df.join(weights, ["y", "x"])
    whole = [F.coalesce(F.sum(F.when(F.col(v).isNotNull(), F.col("w"))), F.lit(0.0)) > 1 - 1e-9 for v in values]
    sums = [F.when(w, F.sum(F.col(v) * F.col("w"))).alias(v) for v, w in zip(values, whole, strict=True)]
    out = met.groupBy(*keys, "ty", "tx").agg(*sums)
    if targets is not None:
        every = df.select(*keys).distinct().crossJoin(targets.select("ty", "tx"))  # the cells of the result
        out = every.join(out, [*keys, "ty", "tx"], "left")
    return out.withColumnsRenamed({"ty": "y", "tx": "x"})


def is_whole(cells: DataFrame) -> bool:
    """Whether every row and column of the grid has its cell, so that neighbours make quads."""
    n = cells.agg(F.count(F.lit(1)).alias("n"), ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("all")).first()
    return n["n"] == n["all"]


def regrid_any(df: DataFrame, cells: DataFrame, lat_to: list[float], lon_to: list[float], keys: list[str], values: list[str], fill: str = "null", by: str | None = None) -> DataFrame:
    """df's fields on the axes lat_to and lon_to: as they are if the grids are the same, bilinear from regular axes, by triangles from
    curvilinear grids and scattered points. cells: (y, x, lat, lon) of the source grid.

    by: "axes", "quads" (halves of the quads of neighbours) or "points" (Delaunay triangles, for cells in any order); if None, axes for rectilinear
    grids, quads where no cell is missing and both target axes have even steps, else points. Targets outside the source are null; with fill "border", on regular axes, they take the
    border's line; with "nearest" what is null takes the nearest cell's value.
    """
    targets = target_cells(df.sparkSession, lat_to, lon_to)
    cells = kept(cells.select("y", "x", "lat", "lon"))  # looked at several times below
    if by is None and same_axes(cells, targets.withColumnsRenamed({"ty": "y", "tx": "x"})):
        return df.select(*keys, "y", "x", *values)
    steps = [np.diff(to) for to in (lat_to, lon_to)]
    even = all(np.allclose(s, s[:1]) for s in steps)
    by = by or ("axes" if is_rectilinear(cells) else "quads" if even and is_whole(cells) else "points")
    if by == "quads" and not even:
        raise ValueError("quads need target axes with even steps")
    if by == "axes":
        ends = [cells.agg((F.max(i) + 1).alias("n"), F.min_by(c, i).alias("first"), F.max_by(c, i).alias("last")).first() for i, c in (("y", "lat"), ("x", "lon"))]
        lat, lon = ((e["n"], e["first"], (e["last"] - e["first"]) / max(e["n"] - 1, 1) or 1.0) for e in ends)
        out = regrid(df, lat, lon, lat_to, lon_to, keys, values, "border" if fill == "border" else "null")
    else:
        if fill == "border":
            raise ValueError("a border is only known on regular axes")
        weights = triangle_weights(cells, lat_to, lon_to) if by == "quads" else triangulation_weights(cells, targets)
        out = apply_weights(df, weights, keys, values, targets)
    if fill != "nearest":
        return out.select(*keys, "y", "x", *values)
    nearest = nearest_cells(cells, lat_to, lon_to) if by == "axes" else nearest_points(cells, targets)
    near = apply_weights(df, nearest, keys, values, targets).withColumnsRenamed({v: f"_near_{v}" for v in values})
    both = near.join(out, [*keys, "y", "x"], "left")
    return both.select(*keys, "y", "x", *[F.coalesce(v, f"_near_{v}").alias(v) for v in values])
