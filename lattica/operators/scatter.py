"""Scattered points: the nearest one, and linear interpolation in the Delaunay triangle that holds a target.

Points are dealt over square tiles, and tiles over ever larger ones with the bounds of what they hold, so that a search goes from the
largest tile down and follows only tiles that can matter. The plane is that of longitude and latitude, or of any two coordinates.

The triangle of a target is the facet under it when points are lifted onto a paraboloid: of all triangles of points around the target the one with the
least lifted height there. A task finds it among a few points; then the points of all other tiles that its circle meets are looked at, and
those inside the circle join the few, until there are none. No task ever needs a triangulation of the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.store import kept

#: Points of a tile, about.
PER_TILE = 8
#: Added to a lifted height, times a share that goes by the point's indices: which diagonal points on one circle get doesn't hang on rounding.
TIE = 1e-6
#: Points this far below a facet count as below it.
TOLERANCE = 1e-11
#: Tiles of a circle that are named one by one; for more the search goes from the largest tile down.
NAMED = 64
#: Points that join a target's few in a round.
JOINING = 8
#: Points of a file of the index, about.
ROWS = 200_000
#: Sets of hull corners merged in one task.
MERGED = 16
POINT = "struct<y: int, x: int, lat: double, lon: double>"


def tie_share(y, x):
    """In [0, 1), by the indices of a point (64-bit); for columns and for arrays. Not linear in them: the diagonals of a rectangle get unequal sums."""
    at = y * y * 349 + x * x * 617 + y * x * 211
    return (F.pmod(at, F.lit(1009)) if isinstance(at, Column) else at % 1009) / 1009.0


@dataclass
class Tiles:
    """placed: points with their tile (i, j). bounds: (level, i, j, lat0, lat1, lon0, lon1) of tiles that hold points; level 0 are the smallest, at
    level `top` one holds all."""

    placed: DataFrame
    bounds: DataFrame
    lat: float
    lon: float
    step: float
    top: int

    def tile(self, c: str, value: Column) -> Column:
        return F.floor((value - getattr(self, c)) / self.step).cast("long")


def tiled(points: DataFrame, per_tile: int = PER_TILE) -> Tiles | None:
    """points: (y, x, lat, lon); those without coordinates count for nothing. None if there are none."""
    points = points.where("lat is not null and lon is not null").select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "lat", "lon")
    box = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{k}") for c in ("lat", "lon") for k, f in ((0, F.min), (1, F.max))]).first()
    if not box["n"]:
        return None
    h, w = box["lat1"] - box["lat0"], box["lon1"] - box["lon0"]
    step = max(math.sqrt(h * w * per_tile / box["n"]), max(h, w) * per_tile / box["n"]) or 1.0
    top = math.ceil(math.log2(max(h, w) / step + 2))
    out = Tiles(points, points, box["lat0"], box["lon0"], step, top)
    several = math.ceil(box["n"] / ROWS)
    out.placed = kept(points.withColumns({"i": out.tile("lat", F.col("lat")), "j": out.tile("lon", F.col("lon"))}), several)
    bounds = [F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1")]
    least = kept(out.placed.groupBy("i", "j").agg(*bounds), several)
    grow = [F.min("lat0").alias("lat0"), F.max("lat1").alias("lat1"), F.min("lon0").alias("lon0"), F.max("lon1").alias("lon1")]
    levels = [least.select(F.lit(0).alias("level"), "i", "j", "lat0", "lat1", "lon0", "lon1")]
    for level in range(1, top + 1):
        levels.append(least.groupBy(F.shiftright("i", level).alias("i"), F.shiftright("j", level).alias("j")).agg(*grow).select(F.lit(level).alias("level"), "i", "j", "lat0", "lat1", "lon0", "lon1"))
    out.bounds = kept(reduce(DataFrame.union, levels), several)
    return out


def _away(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Least and greatest squared distance from a place to the bounds lat0 .. lon1."""
    near = [F.greatest(F.col(f"{c}0") - at, at - F.col(f"{c}1"), F.lit(0.0)) for c, at in (("lat", lat), ("lon", lon))]
    far = [F.greatest(F.abs(F.col(f"{c}0") - at), F.abs(F.col(f"{c}1") - at)) for c, at in (("lat", lat), ("lon", lon))]
    return near[0] * near[0] + near[1] * near[1], far[0] * far[0] + far[1] * far[1]


def _down(asked: DataFrame, tiles: Tiles, follow) -> DataFrame:
    """asked with a row for each smallest tile (i, j) that `follow` leaves of it: a filter on rows with a tile's bounds, level by level."""
    out = asked.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    for level in range(tiles.top - 1, -1, -1):
        below = tiles.bounds.where(F.col("level") == level).drop("level").withColumns({"_i": F.shiftright("i", 1), "_j": F.shiftright("j", 1)}).withColumnsRenamed({"i": "_ci", "j": "_cj"})
        met = out.withColumnsRenamed({"i": "_i", "j": "_j"}).join(below, ["_i", "_j"]).drop("_i", "_j").withColumnsRenamed({"_ci": "i", "_cj": "j"})
        out = follow(met).drop("lat0", "lat1", "lon0", "lon1")
    return out


def nearest_points(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(ty, tx, y, x, w = 1): of points (y, x, lat, lon) the one nearest to each target (ty, tx, lat, lon); ties go to the first by y and x.

    From a level to the next a target keeps the tiles that may hold a point as near as the farthest corner of the nearest tile. Targets without
    coordinates have no row; without points there are none.
    """
    tiles = tiled(points)
    asked = targets.select("ty", "tx", F.col("lat").alias("u"), F.col("lon").alias("v")).where("u is not null and v is not null")
    if tiles is None:
        return asked.select("ty", "tx", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1.0).alias("w")).where("false")
    low, high = _away(F.col("u"), F.col("v"))
    own = Window.partitionBy("ty", "tx")

    def follow(met: DataFrame) -> DataFrame:
        return met.withColumns({"_low": low, "_reach": F.min(high).over(own)}).where(F.col("_low") <= F.col("_reach")).drop("_low", "_reach")

    met = _down(asked, tiles, follow).join(tiles.placed, ["i", "j"])
    d, e = F.col("lat") - F.col("u"), F.col("lon") - F.col("v")
    best = met.groupBy("ty", "tx").agg(F.min(F.struct((d * d + e * e).alias("d"), "y", "x")).alias("at"))
    return best.select("ty", "tx", "at.y", "at.x", F.lit(1.0).alias("w"))


def hull(at: np.ndarray) -> np.ndarray:
    """Rows of the corners of the convex hull of places (n, 2), in turn; points on its edges are no corners."""
    order = np.lexsort((at[:, 1], at[:, 0]))
    order = order[np.append(True, (np.diff(at[order], axis=0) != 0).any(axis=1))] if len(order) else order

    def chain(rows: list[int]) -> list[int]:
        out: list[int] = []
        for r in rows:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = at[out[-2]], at[out[-1]], at[r]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(r)
        return out

    rows = order.tolist()
    lower, upper = chain(rows), chain(rows[::-1])
    return np.array(lower[:-1] + upper[:-1] if len(rows) > 1 else rows, int)


def _hull_of(points: DataFrame) -> list:
    """The corners of the hull of all points: hulls of partitions, merged MERGED at a time. Only corners reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            t = pa.Table.from_batches([*held, batch])
            at = np.stack([t.column("lat").to_numpy(), t.column("lon").to_numpy()], axis=1)
            held = t.take(pa.array(hull(at))).combine_chunks().to_batches()
        yield from held

    out = points.select("y", "x", "lat", "lon")
    many = out.rdd.getNumPartitions()
    out = out.mapInArrow(run, "y int, x int, lat double, lon double")
    while many > 1:
        many = -(-many // MERGED)
        out = out.repartition(many).mapInArrow(run, "y int, x int, lat double, lon double")
    return out.collect()


def facet(x: np.ndarray, y: np.ndarray, lifted: np.ndarray, start: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The facet under the origin: rows of its corners, their weights, and its plane (slopes and height at the origin).

    start: rows of a triangle that holds the origin. The row farthest below the present plane replaces the corner that lets the triangle
    still hold the origin, until none is below.
    """
    corners = list(start)
    for _ in range(10 * len(x) + 100):
        m = np.stack([x[corners], y[corners], np.ones(3)])
        weights = np.linalg.solve(m, [0.0, 0.0, 1.0])
        plane = np.linalg.solve(m.T, lifted[corners])
        below = lifted - (plane[0] * x + plane[1] * y + plane[2])
        new = int(below.argmin())
        if below[new] >= -TOLERANCE or new in corners:
            break
        share = np.linalg.solve(m, [x[new], y[new], 1.0])
        ratio = np.where(share > 1e-12, np.maximum(weights, 0) / np.where(share > 1e-12, share, 1.0), np.inf)
        corners[int(ratio.argmin())] = new
    return corners, weights, plane


def fan(corners: np.ndarray, at: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Of places (n, 2): whether each is in the convex polygon (n, bool), its edges included up to slack, and the fan triangle's second corner."""
    ways = corners[1:] - corners[0]
    rel = at - corners[0]
    side = ways[:, 0][None] * rel[:, 1:] - ways[:, 1][None] * rel[:, :1]  # > 0: left of the ray to a corner
    k = np.clip((side[:, 1:-1] > 0).sum(axis=1) if len(ways) > 2 else np.zeros(len(at), int), 0, len(ways) - 2)
    inside = np.ones(len(at), bool)
    for a, b in ((corners[0][None], corners[k + 1]), (corners[k + 1], corners[k + 2]), (corners[k + 2], corners[0][None])):
        edge = b - a
        gap = (edge[:, 0] * (at - a)[:, 1] - edge[:, 1] * (at - a)[:, 0]) / np.hypot(edge[:, 0], edge[:, 1])
        inside &= gap >= -slack
    return inside, k + 1


def triangulation_weights(points: DataFrame, targets: DataFrame, tie: float = TIE) -> DataFrame:
    """(ty, tx, y, x, w): weights of each target (ty, tx, lat, lon) in the Delaunay triangle of points (y, x, lat, lon) that holds it.

    Points may be in any order and number; (y, x) is their key. Targets outside the hull of the points, or without coordinates, have no rows; nor has any
    if all points lie on a line. Of points on one circle the triangle is the one with the least lifted height plus tie * tie_share(y, x). Of points
    at one place the one of least such height counts. Corners of the hull are collected and sent to tasks: boundaries of grids, not grids.
    """
    tiles = tiled(points)
    asked = targets.select(F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), F.col("lat").alias("u"), F.col("lon").alias("v")).where("u is not null and v is not null")
    none = asked.select("ty", "tx", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("w")).where("false")
    if tiles is None:
        return none
    corners = _hull_of(tiles.placed)
    at = np.array([(r["lat"], r["lon"]) for r in corners])
    order = hull(at)
    corners, at = [tuple(corners[k]) for k in order], at[order]
    if len(corners) < 3:
        return none
    slack = 1e-9 * float(np.ptp(at, axis=0).max())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
            ok, k = fan(at, place, slack)
            few = [[dict(zip(("y", "x", "lat", "lon"), corners[c], strict=True)) for c in (0, n, n + 1)] for n in k[ok].tolist()]
            kind = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(ok)).columns, pa.array(few, kind)], names=["ty", "tx", "u", "v", "few"])

    target = "ty int, tx int, u double, v double"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64())]))
        for batch in batches:
            few, weights, planes, settled = [], [], [], []
            for u, v, p, again in zip(*(batch.column(k).to_pylist() for k in (2, 3)), batch.column(4), batch.column(5).to_pylist(), strict=True):
                y, x, lat, lon = (p.values.field(k).to_numpy() for k in range(4))
                a, b = lat - u, lon - v
                found, w, plane = facet(a, b, a * a + b * b + tie * tie_share(y.astype(np.int64), x.astype(np.int64)), [0, 1, 2])
                few.append([{"y": y[k], "x": x[k], "lat": lat[k], "lon": lon[k]} for k in found])
                weights.append(w.tolist())
                planes.append(plane)
                settled.append(again and found == [0, 1, 2])  # what was found inside the circle was so by rounding only
            a, b, c = np.array(planes).reshape(-1, 3).T
            circle = [batch.column(2).to_numpy() + a / 2, batch.column(3).to_numpy() + b / 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(few, kind), pa.array(weights, pa.list_(pa.float64())), pa.array(a), pa.array(b), pa.array(c), *map(pa.array, circle), pa.array(np.sqrt(np.maximum(c + (a * a + b * b) / 4, 0))), pa.array(settled, pa.bool_())],
                names=["ty", "tx", "u", "v", "few", "w", "a", "b", "c", "mid_u", "mid_v", "radius", "settled"],
            )

    started = asked.mapInArrow(inside, f"{target}, few array<{POINT}>")
    # a target's few are a triangle of the hull around it and the points of the tiles about it
    own = {"_i": tiles.tile("lat", F.col("u")), "_j": tiles.tile("lon", F.col("v"))}
    about = F.explode(F.array(*[F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = started.withColumns(own).select("ty", "tx", about.alias("t")).select("ty", "tx", "t.i", "t.j").join(tiles.placed, ["i", "j"])
    near = near.groupBy("ty", "tx").agg(F.collect_list(F.struct("y", "x", "lat", "lon")).alias("near"))
    open_ = started.join(near, ["ty", "tx"], "left").select("ty", "tx", "u", "v", F.concat("few", F.coalesce("near", F.array().cast(f"array<{POINT}>"))).alias("few"), F.lit(False).alias("again"))

    facets, done = f"{target}, few array<{POINT}>, w array<double>, a double, b double, c double, mid_u double, mid_v double, radius double, settled boolean", []
    mid_low, _ = _away(F.col("mid_u"), F.col("mid_v"))
    while True:
        state = kept(open_.mapInArrow(solve, facets))
        reach = F.col("radius") * (1 + 1e-9) + 1e-9
        ends = {f"{k}{n}": tiles.tile(c, F.col(f"mid_{m}") + s * reach) for k, c, m in (("_i", "lat", "u"), ("_j", "lon", "v")) for n, s in ((0, -1), (1, 1))}
        ask = state.where("not settled").select("ty", "tx", "u", "v", "a", "b", "c", "mid_u", "mid_v", reach.alias("reach"), *[c.alias(n) for n, c in ends.items()])
        # a huge circle's indices are no longs any more; its count of tiles as a double is
        wide = [F.col("reach") * 2 / tiles.step + 2] * 2
        small = wide[0] * wide[1] <= NAMED
        named = ask.where(small).withColumn("i", F.explode(F.sequence("_i0", "_i1"))).withColumn("j", F.explode(F.sequence("_j0", "_j1")))
        searched = _down(ask.where(~small), tiles, lambda met: met.where(mid_low <= F.col("reach") * F.col("reach")))
        met = named.select("ty", "tx", "u", "v", "a", "b", "c", "i", "j").union(searched.select("ty", "tx", "u", "v", "a", "b", "c", "i", "j")).join(tiles.placed, ["i", "j"])
        d, e = F.col("lat") - F.col("u"), F.col("lon") - F.col("v")
        below = d * d + e * e + tie * tie_share(F.col("y").cast("long"), F.col("x").cast("long")) - (F.col("a") * d + F.col("b") * e + F.col("c"))
        most = met.withColumn("below", below).where(F.col("below") < -TOLERANCE).groupBy("ty", "tx", "i", "j").agg(F.min(F.struct("below", "y", "x", "lat", "lon")).alias("p"))
        more = most.groupBy("ty", "tx").agg(F.slice(F.array_sort(F.collect_list("p")), 1, JOINING).alias("more"))
        more = kept(more)
        done.append(state.join(more.select("ty", "tx"), ["ty", "tx"], "left_anti"))
        if more.isEmpty():
            break
        joined = F.concat("few", F.transform("more", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"), p["lat"].alias("lat"), p["lon"].alias("lon"))))
        open_ = state.join(more, ["ty", "tx"]).select("ty", "tx", "u", "v", joined.alias("few"), F.lit(True).alias("again"))
    parts = reduce(DataFrame.union, done).select("ty", "tx", F.explode(F.arrays_zip("few", "w")).alias("p"))
    return parts.select("ty", "tx", F.col("p.few.y").alias("y"), F.col("p.few.x").alias("x"), F.greatest(F.col("p.w"), F.lit(0.0)).alias("w"))
