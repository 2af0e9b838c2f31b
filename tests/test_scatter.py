"""Nearest points, Delaunay weights, inpainting and the rows that sparse fields must not lose, against brute force on hand-made grids."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import curvilinear, grid, scatter, spectral, stats
from lattica.sources import base
from lattica.spec import DataSource, Leadtime, Region, Selection, TimeRange, Variable

POINTS = "y int, x int, lat double, lon double"


def share(y, x):
    return (y * y * 349 + x * x * 617 + y * x * 211) % 1009 / 1009


def least_triangle(points, u, v):
    """Of all triangles of points around (u, v) the one with the least lifted height there: corner -> weight, or None."""
    at = np.array([(p[2] - u, p[3] - v) for p in points])
    z = (at**2).sum(axis=1) + scatter.TIE * np.array([share(*p[:2]) for p in points])
    i, j, k = np.array([(i, j, k) for i in range(len(points)) for j in range(i) for k in range(j)]).T
    cross = lambda a, b: at[a, 0] * at[b, 1] - at[a, 1] * at[b, 0]
    det = cross(i, j) + cross(j, k) + cross(k, i)
    flat = np.abs(det) < 1e-9
    w = np.stack([cross(j, k), cross(k, i), cross(i, j)]) / np.where(flat, 1, det)
    ok = (w.min(axis=0) >= -1e-9) & ~flat
    if not ok.any():
        return None
    m = np.where(ok, w[0] * z[i] + w[1] * z[j] + w[2] * z[k], np.inf).argmin()
    return {points[c[m]][:2]: w[n, m] for n, c in enumerate((i, j, k))}


def cloud(kind):
    rng = random.Random(kind)
    if kind == "random":
        return [(k, k % 3, rng.uniform(0, 10), rng.uniform(0, 20)) for k in range(50)]
    if kind == "gap":  # long triangles over a hole
        out = [(k, 7, rng.uniform(0, 10), rng.uniform(0, 20)) for k in range(200)]
        return [p for p in out if not (3 < p[2] < 8 and 4 < p[3] < 16)][:50]
    if kind == "lattice":  # four points on every circle
        return [(y, x, float(y), float(x)) for y in range(6) for x in range(8)]
    if kind == "masked":
        return [(y, x, 45 - 2.0 * y + 0.1 * x, -130 + 3.0 * x + 0.2 * y) for y in range(7) for x in range(9) if (y * x) % 4 != 3]
    return [(k, 0, rng.gauss(0, 0.01) if k < 40 else rng.uniform(-50, 50), rng.gauss(0, 0.01) if k < 40 else rng.uniform(-50, 50)) for k in range(48)]  # one dense spot


@pytest.mark.parametrize("kind", ["random", "gap", "lattice", "masked", "dense"])
def test_clouds(spark, kind):
    points = cloud(kind)
    random.Random(1).shuffle(points)
    low, high = (np.array([f(p[c] for p in points) for c in (2, 3)]) for f in (min, max))
    places = [low - 0.1 * (high - low) + (high - low) * 1.2 * (a / 9, b / 9) for a in range(10) for b in range(10)]
    targets = [(n // 10, n % 10, *map(float, p)) for n, p in enumerate(places)] + [(10, 0, *points[3][2:]), (10, 1, None, 1.0), (10, 2, 1e6, 0.0)]
    p, t = spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, "ty int, tx int, lat double, lon double")
    got = {}
    for r in scatter.triangulation_weights(p, t).collect():
        got.setdefault((r["ty"], r["tx"]), {})[r["y"], r["x"]] = r["w"]
    near = {(r["ty"], r["tx"]): (r["y"], r["x"]) for r in scatter.nearest_points(p, t).collect()}
    assert (10, 1) not in got and (10, 1) not in near and (10, 2) not in got
    for ty, tx, u, v in targets:
        if u is None:
            continue
        assert near[ty, tx] == min(((q[2] - u) * (q[2] - u) + (q[3] - v) * (q[3] - v), *q[:2]) for q in points)[1:]
        want, have = least_triangle(points, u, v), got.get((ty, tx))
        assert (want is None) == (have is None)
        if want:
            assert all(abs(want.get(c, 0) - have.get(c, 0)) < 1e-6 for c in {*want, *have})


def test_few_points(spark):
    """None, one, two places, a line, repeated places and points without coordinates."""
    t = spark.createDataFrame([(0, 0, 0.5, 0.5), (0, 1, 9.0, 9.0)], "ty int, tx int, lat double, lon double")
    for points in ([], [(0, 0, 1.0, 1.0)], [(0, 0, 0.0, 0.0), (0, 1, 1.0, 1.0), (5, 5, None, 2.0)], [(0, k, float(k), float(k)) for k in range(9)], [(k, 0, 1.0, 1.0) for k in range(30)]):
        p = spark.createDataFrame(points, POINTS)
        assert scatter.triangulation_weights(p, t).count() == 0
        assert scatter.nearest_points(p, t).count() == (2 if points else 0)
    square = [(y, x, float(y), float(x)) for y in (0, 1) for x in (0, 1)] * 3
    got = scatter.triangulation_weights(spark.createDataFrame(square, POINTS), t)
    assert {(r["ty"], r["tx"]) for r in got.collect()} == {(0, 0)} and got.agg(F.sum("w")).first()[0] == pytest.approx(1)


def test_a_larger_cloud(spark):
    """Thousands of points: linear fields come out exactly, and every circle is empty."""
    rng = np.random.default_rng(4)
    at = rng.uniform(0, 50, (4000, 2))
    at = at[(np.abs(at - 25) > 6).any(axis=1)]  # a hole in the middle
    p = spark.createDataFrame([(k, 0, float(a), float(b)) for k, (a, b) in enumerate(at)], POINTS)
    t = spark.range(900).select((F.col("id") / 30).cast("int").alias("ty"), (F.col("id") % 30).cast("int").alias("tx")).withColumns({"lat": 2.0 + F.col("ty") * 1.55, "lon": 2.0 + F.col("tx") * 1.55})
    rows = scatter.triangulation_weights(p, t).toPandas()
    assert rows.groupby(["ty", "tx"]).size().eq(3).all() and len(rows) == 2700
    rows["v"] = rows.w * (3 * at[rows.y, 0] - at[rows.y, 1])
    got = rows.groupby(["ty", "tx"]).v.sum()
    want = [3 * (2 + 1.55 * a) - (2 + 1.55 * b) for a, b in got.index]
    assert np.allclose(got, want)
    for _, three in rows.groupby(["ty", "tx"]):
        a, b, c = at[three.y.to_numpy()]
        m = np.array([b - a, c - a])
        mid = np.linalg.solve(2 * m, [(b @ b - a @ a), (c @ c - a @ a)])
        assert (((at - mid) ** 2).sum(axis=1) > (a - mid) @ (a - mid) - 1e-5).all()


@pytest.mark.parametrize("holes", [0.02, 0.4, 0.8])
def test_inpainting(spark, holes):
    rng = np.random.default_rng(7)
    field = rng.normal(size=(9, 11))
    field[rng.random(field.shape) < holes] = np.nan
    few = np.full((9, 11), np.nan)
    few[0, 0] = few[4, 4] = few[8, 2] = 1.0
    line = np.full((9, 11), np.nan)
    line[3, :5] = [1, 2, 3, 4, 5]
    cells = [(t, y, x, None if np.isnan(v) else float(v)) for t, f in enumerate((field, few, line)) for (y, x), v in np.ndenumerate(f) if not (np.isnan(v) and y % 2)]
    out = grid.inpaint(spark.createDataFrame(cells, "t int, y int, x int, v double"), "v", {"y": 9, "x": 11}, ["t"]).collect()
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in out}
    assert len(got) == 3 * 99
    for t, f in enumerate((field, few, line)):
        valid = [(int(y), int(x), float(y), float(x)) for y, x in zip(*np.nonzero(~np.isnan(f)), strict=True)]
        for (y, x), v in np.ndenumerate(f):
            if not np.isnan(v):
                want = v
            elif t == 1:
                assert got[t, y, x] is None
                continue
            elif (w := least_triangle(valid, y, x) if t == 0 else None) is not None:
                want = sum(f[c] * k for c, k in w.items())
            else:
                want = f[min(((q[0] - y) ** 2 + (q[1] - x) ** 2, *q[:2]) for q in valid)[1:]]
            assert got[t, y, x] == pytest.approx(want)


def sheared(spark, keep=lambda y, x: True):
    return spark.createDataFrame([(y, x, 40.0 - 2 * y + 0.1 * x, 10.0 + 3 * x + 0.2 * y) for y in range(5) for x in range(6) if keep(y, x)], POINTS)


def test_masked_curvilinear_grid(spark):
    """Quads end at masked cells; triangles of the cells that are left go on over them, and what is outside takes the nearest."""
    cells = sheared(spark, lambda y, x: (y, x) not in {(2, 2), (2, 3)})
    assert not curvilinear.is_whole(cells) and curvilinear.is_whole(sheared(spark))
    df = cells.select(F.lit(1).alias("t"), "y", "x", (F.col("lat") + 10 * F.col("lon")).alias("v"))
    lat, lon = [50.0, 37.0, 36.0], [9.0, 17.5, 18.5]
    got = {(r["y"], r["x"]): r["v"] for r in curvilinear.regrid_any(df, cells, lat, lon, ["t"], ["v"]).collect()}
    assert len(got) == 9 and all(got[y, x] == pytest.approx(lat[y] + 10 * lon[x]) for y in (1, 2) for x in (1, 2)) and got[0, 0] is None
    filled = {(r["y"], r["x"]): r["v"] for r in curvilinear.regrid_any(df, cells, lat, lon, ["t"], ["v"], fill="nearest").collect()}
    values = {(r["y"], r["x"]): r for r in cells.collect()}
    for at, v in filled.items():
        u, w = lat[at[0]], lon[at[1]]
        c = min(values.values(), key=lambda r: ((r["lat"] - u) ** 2 + (r["lon"] - w) ** 2, r["y"], r["x"]))
        assert v == pytest.approx(got[at] if got[at] is not None else c["lat"] + 10 * c["lon"])
    for wrong in ({"fill": "border"}, {"by": "quads"}):  # quads need regular axes
        with pytest.raises(ValueError):
            curvilinear.regrid_any(df, cells, lat, lon, ["t"], ["v"], **wrong)


@pytest.mark.parametrize("by", ["quads", "points"])
def test_sparse_fields_keep_their_targets(spark, by):
    """A date without some cells has a row for every target: null where a corner is missing, and outside."""
    cells = sheared(spark)
    full = cells.select(F.lit(1).alias("t"), "y", "x", F.col("lat").alias("v"))
    sparse = full.where("not (y <= 1 and x <= 1) and not (y = 2 and x = 2)").withColumn("t", F.lit(2))
    out = curvilinear.regrid_any(full.union(sparse), cells, [42.0, 39.0, 36.0], [8.2, 12.4, 16.6], ["t"], ["v"], by=by)
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in out.collect()}
    assert len(got) == 18 and all(got[t, 0, x] is None for t in (1, 2) for x in range(3))
    assert got[1, 1, 1] == pytest.approx(39.0) and got[2, 1, 1] is None and got[1, 2, 2] == pytest.approx(36.0) and got[2, 2, 2] is None


@pytest.mark.parametrize("rows", [[(k % 5) for k in range(300)], [1] * 100, [None] * 50 + [2] * 50, [3]])
def test_split_of_repeated_keys(spark, rows):
    """No row is lost or repeated, and the number is exact."""
    df = spark.createDataFrame([(k, n) for n, k in enumerate(rows)], "k int, n int")
    for fraction in (0.0, 0.3, 0.9, 1.0):
        got = stats.split_exact(df, "k", fraction, 42)
        assert got.columns == ["k", "n", "train"] and sorted(r["n"] for r in got.collect()) == list(range(len(rows)))
        assert got.where("train").count() == int(len(rows) * fraction)


def test_period_is_in_no_zone(spark):
    df = spark.createDataFrame([(datetime(2019, 12, 31, 19), 0, 0, 1.0), (datetime(2020, 1, 1), 0, 0, 2.0), (datetime(2020, 1, 2), 0, 0, 3.0)], "t timestamp_ntz, y int, x int, u double")
    chosen = Selection((Variable("u"),), Region("r", (0, 1), (0, 1)), TimeRange(datetime(2020, 1, 1), datetime(2020, 1, 2)))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(r["u"] for r in base.FrameSource(spark, DataSource("s", chosen), lambda: df).load().collect()) == [2.0, 3.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("one_lead, want", [(None, 1), (True, 2), (False, 1)])
def test_lead_guard_from_the_source(spark, one_lead, want):
    df = spark.createDataFrame([(datetime(2020, 1, 1), 24, 1.0), (datetime(2020, 1, 1), 48, 2.0)], "t timestamp_ntz, lead int, u double")
    chosen = Selection((Variable("u", leadtime=Leadtime("one day", "day", 1)),), Region("r", (0, 1), (0, 1)), TimeRange(datetime(2020, 1, 1), datetime(2020, 1, 2)))
    source = base.FrameSource(spark, DataSource("s", chosen), lambda: df)
    source.one_lead = one_lead
    assert source.load().count() == want


def test_radial_spectrum_of_members(spark):
    """A field is a time and a member; the mean over fields equals that of the members taken apart."""
    rng = np.random.default_rng(0)
    rows = [(t, m, y, x, 45.0 - y, float(rng.normal())) for t in range(2) for m in range(3) for y in range(8) for x in range(12)]
    df = spark.createDataFrame(rows, "t int, realization int, y int, x int, lat double, v double")
    both = {r["bin"]: r["power"] for r in spectral.radial_spectrum(df, "v", 3.0, 2.0, n_bins=6, field=["t", "realization"]).collect()}
    apart = [{r["bin"]: r["power"] for r in spectral.radial_spectrum(df.where(F.col("realization") == m), "v", 3.0, 2.0, n_bins=6).collect()} for m in range(3)]
    for k, p in both.items():
        assert p is None and apart[0][k] is None or p == pytest.approx(np.mean([a[k] for a in apart]))


def test_all_smoothings_in_one_pass(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(t, y, x, float(rng.normal())) for t in range(2) for y in range(6) for x in range(7)], "t int, y int, x int, v double")
    sizes = {"y": 6, "x": 7}
    each = {(r["t"], r["y"], r["x"]): (r["a"], r["b"]) for r in grid.smooth_each(df, "v", {"a": 0.8, "b": 3.0}, sizes, ["t"]).collect()}
    for k, sigma in enumerate((0.8, 3.0)):
        assert all(each[r["t"], r["y"], r["x"]][k] == pytest.approx(r["v"]) for r in grid.smooth(df, "v", sigma, sizes, ["t"]).collect())
