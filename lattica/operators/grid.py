"""Operations on rectilinear grids in long form: subsets, resolution, regridding, gaps, smoothing, crops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.geo import in_region, lon_between, nearest, within, wrap
from lattica.operators import scatter
from lattica.operators.fields import on_fields
from lattica.spec import Region


def subset(df: DataFrame, region: Region, grid_min: float | None = -180.0) -> DataFrame:
    return df.where(in_region(region, F.col("lat"), F.col("lon"), grid_min))


def subset_curvilinear(df: DataFrame, region: Region, values: list[str]) -> DataFrame:
    """Rows and columns of the grid that a cell of the half-open box touches; values outside the box are null."""
    (west, east), (south, north) = region.lon, sorted(region.lat)
    lon = (F.col("lon") >= west) & (F.col("lon") < east) if west < east else (F.col("lon") >= west) | (F.col("lon") < east)
    hit = lon & (F.col("lat") >= south) & (F.col("lat") < north)
    marked = df.withColumn("_hit", hit)
    ys, xs = (marked.where("_hit").select(c).distinct() for c in ("y", "x"))
    kept = marked.join(ys, "y", "left_semi").join(xs, "x", "left_semi")
    return kept.select(*[F.when(F.col("_hit"), F.col(c)).alias(c) if c in values else c for c in df.columns])


def extremes(df: DataFrame) -> DataFrame:
    """One row: the least and greatest longitude and latitude."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])


def cut_longitude(df: DataFrame, west: float) -> DataFrame:
    """One row (lon, x): where to cut the circle so that a region that begins at west is in one piece: the grid longitude before the one
    nearest to west, and its index among them; before the first comes the last."""
    axis = df.select("lon").distinct()  # an axis, not cells
    line = Window.orderBy("lon")
    marked = axis.withColumns({"x": F.row_number().over(line) - 1, "_before": F.lag("lon").over(line)})
    last = axis.agg(F.max("lon").alias("_last"), F.count(F.lit(1)).alias("_n"))
    at = marked.agg(F.min(F.struct(F.abs(wrap(F.col("lon") - west, 0.0)).alias("away"), "x", "_before")).alias("at"))
    return at.crossJoin(last).select(F.coalesce("at._before", "_last").alias("lon"), F.when(F.col("at.x") == 0, F.col("_n") - 1).otherwise(F.col("at.x") - 1).cast("int").alias("x"))  # two single rows


def _axis(df: DataFrame, index: str, *columns: str) -> DataFrame:
    """The axis's cells, once each: as many rows as the axis is long."""
    return df.groupBy(index).agg(*[F.min(c).alias(c) for c in columns])


def increasing(df: DataFrame, axis: str, index: str) -> DataFrame:
    """Cells with the index turned round if the axis runs down, so that it runs up; data stay with their coordinates. Axes that don't vary, or neither
    run up nor down, are refused when read. Null indices stay null. Nothing but the axis, a row per index, is ordered."""
    along = Window.orderBy(index)
    steps = _axis(df.where(F.col(index).isNotNull()), index, axis).withColumn("_d", F.col(axis) - F.lag(axis).over(along))
    turn = steps.agg(F.max("_d").alias("_up"), F.min("_d").alias("_down"), (F.min(index) + F.max(index)).alias("_ends"))
    turned = F.when(F.col("_up") < 0, F.col("_ends") - F.col(index)).when((F.col("_down") > 0) | F.col("_up").isNull(), F.col(index))
    turned = turned.otherwise(F.raise_error(F.lit(f"{axis} neither runs up nor down")).cast("int"))
    return df.crossJoin(F.broadcast(turn)).withColumn(index, F.when(F.col(index).isNotNull(), turned.cast(df.schema[index].dataType))).select(*df.columns)  # a row


def rolled(df: DataFrame, west: float, lon: str = "lon", index: str = "x") -> DataFrame:
    """Longitudes in [west, west + 360), and the index counted from 0 along them, so that the grid starts at the cut and runs on across the seam."""
    moved = df.withColumn(lon, (F.col(lon) - west) - F.floor((F.col(lon) - west) / 360) * 360 + west)
    places = _axis(moved, index, lon).select(index, (F.row_number().over(Window.orderBy(lon, index)) - 1).cast("int").alias("_new"))
    return moved.join(places, index).withColumn(index, F.col("_new")).select(*df.columns)


def at_index(df: DataFrame, **places: int) -> DataFrame:
    """The slice at the n-th distinct label of each column named, counted from 0 in order, or from the last with negative n. Columns are taken in turn: a
    label's number is counted within the slices before. A number beyond the labels gives no rows. Labels are met on the driver by the number, never as a whole."""
    for c, n in places.items():
        labels = df.where(F.col(c).isNotNull()).select(c).distinct()
        nearest_end = labels.orderBy(F.col(c) if n >= 0 else F.col(c).desc()).limit(n + 1 if n >= 0 else -n)
        label = nearest_end.agg((F.max if n >= 0 else F.min)(c).alias("at"), F.count(c).alias("n")).where(F.col("n") == (n + 1 if n >= 0 else -n))
        df = df.join(F.broadcast(label.select(F.col("at").alias(c))), c, "left_semi").select(*df.columns)  # a row
    return df


def resolution(df: DataFrame) -> DataFrame:
    """Mean spacing of the axes (dlat, dlon), from the distinct axis values. An axis is small beside the cells, so its window may be one task."""
    out = None
    for c in ("lat", "lon"):
        axis = df.select(c).distinct().withColumn("_d", F.abs(F.col(c) - F.lag(c).over(Window.orderBy(c))))
        one = axis.agg(F.avg("_d").alias(f"d{c}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def grid_info(df: DataFrame) -> DataFrame:
    """One row (dy, dx): signed mean steps of lat along y and of lon along x, for spectra. The lines of an axis are few, whatever the cells."""
    ends = df.agg(*[f(F.struct(i, c)).alias(f"{n}_{c}") for i, c in (("y", "lat"), ("x", "lon")) for n, f in (("first", F.min), ("last", F.max))])
    step = [F.try_divide(F.col(f"last_{c}.{c}") - F.col(f"first_{c}.{c}"), F.col(f"last_{c}.{i}") - F.col(f"first_{c}.{i}")) for i, c in (("y", "lat"), ("x", "lon"))]
    return ends.select(step[0].alias("dy"), step[1].alias("dx"))


def curvilinear_resolution(df: DataFrame) -> DataFrame:
    """Median neighbour distance along y of lat, and along x of lon (unwrapped)."""
    dlat = F.abs(F.col("lat") - F.lag("lat").over(Window.partitionBy("x").orderBy("y")))
    step = F.col("lon") - F.lag("lon").over(Window.partitionBy("y").orderBy("x"))
    dlon = F.abs(F.pmod(step + 180.0, F.lit(360.0)) - 180.0)
    return df.select(dlat.alias("a"), dlon.alias("b")).agg(F.median("a").alias("dlat"), F.median("b").alias("dlon"))


def axis_weights(n_source: int, first: float, step: float, targets: list[float], fill: str = "null") -> list[tuple[int, int, float]]:
    """(target index, source index, weight) of linear interpolation along a regular axis; outside it null leaves out, border clamps."""
    out = []
    for k, v in enumerate(targets):
        at = (v - first) / step
        if fill == "border":
            at = min(max(at, 0.0), n_source - 1.0)
        if not -1e-9 <= at <= n_source - 1 + 1e-9:
            continue
        i = min(max(math.floor(at + 1e-9), 0), n_source - 2) if n_source > 1 else 0
        w = min(max(at - i, 0.0), 1.0)
        out += [(k, i, 1.0 - w)] + ([(k, i + 1, w)] if n_source > 1 else [])
    return out


def regrid(df: DataFrame, lat: tuple[int, float, float], lon: tuple[int, float, float], lat_to: list[float], lon_to: list[float], keys: list[str], values: list[str], fill: str = "null") -> DataFrame:
    """Bilinear onto the axes lat_to and lon_to. lat, lon: (size, first, step) of the source axes. keys: what a field is (time, member).

    Weights are two small tables of one row per target line and neighbour, far below any broadcast limit; every source cell meets
    its weights by equi-joins and one aggregation sums them up. A target with a missing neighbour is null.
    """
    spark = df.sparkSession
    wy = spark.createDataFrame(axis_weights(*lat, lat_to, fill), "ty int, y int, wy double")
    wx = spark.createDataFrame(axis_weights(*lon, lon_to, fill), "tx int, x int, wx double")
    met = df.join(wy, "y").join(wx, "x").withColumn("_w", F.col("wy") * F.col("wx"))
    sums = [F.sum(F.col(v) * F.col("_w")).alias(v) for v in values] + [F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).alias(f"_n_{v}") for v in values]
    out = met.groupBy(*keys, "ty", "tx").agg(*sums)
    return out.select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"), *[F.when(F.col(f"_n_{v}") > 1 - 1e-9, F.col(v)).alias(v) for v in values])


def fill_gaps(df: DataFrame, value: str, along: str, by: list[str]) -> DataFrame:
    """Nulls between two values along an axis are interpolated linearly in its index; ends stay null."""
    back = Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(along).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(along))
    v0, i0 = F.last(value, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(back)
    v1, i1 = F.first(value, ignorenulls=True).over(ahead), F.first(known, ignorenulls=True).over(ahead)
    line = v0 + (v1 - v0) * F.try_divide((F.col(along) - i0).cast("double"), (i1 - i0).cast("double"))
    return df.withColumn(value, F.coalesce(F.col(value), line))


def _inpainted(field: np.ndarray) -> np.ndarray:
    """One field: what is NaN from the Delaunay triangle of valid cells that holds it, outside their hull from the nearest of them."""
    valid = ~np.isnan(field)
    if valid.all() or valid.sum() < 4:
        return field
    # a valid cell among valid ones has only half squares about it, so triangles over gaps have their corners at gaps or borders
    around = np.lib.stride_tricks.sliding_window_view(np.pad(valid, 1, constant_values=False), (3, 3)).all(axis=(2, 3))
    rim, gaps = (np.stack(np.nonzero(m), axis=1) for m in (valid & ~around, ~valid))
    values, out = field[rim[:, 0], rim[:, 1]], field.copy()
    corners = scatter.hull(rim)
    inside, second = scatter.fan(rim[corners].astype(float), gaps.astype(float), 1e-9) if len(corners) > 2 else (np.zeros(len(gaps), bool), None)
    extra = scatter.TIE * scatter.tie_share(rim[:, 0], rim[:, 1])
    for n, (gap, held) in enumerate(zip(gaps, inside, strict=True)):
        y, x = (rim - gap).astype(float).T
        if held:
            found, weights, _ = scatter.facet(y, x, y * y + x * x + extra, [int(corners[c]) for c in (0, second[n], second[n] + 1)])
            out[tuple(gap)] = weights @ values[found]
        else:
            out[tuple(gap)] = values[(y * y + x * x).argmin()]  # the first of equals by y and x
    return out


def inpaint(df: DataFrame, value: str, sizes: dict[str, int], keys: list[str]) -> DataFrame:
    """(keys, axes, value): fields whose missing cells and nulls are filled linearly in index space, by Delaunay triangles of the valid cells, and
    by the nearest valid cell outside their hull. Fields with fewer than 4 valid cells stay as they are; of those on a line the nearest is taken.

    Where valid cells lie on one circle the triangle goes by scatter.TIE; of equally near cells the first by row and column counts.
    """
    return on_fields(df, sizes, keys, [value], lambda fields: [np.stack([_inpainted(f) for f in fields])], sizes, [value], missing=float("nan"))


def _mirrored(sigma: float, n: int) -> np.ndarray:
    """A Gaussian pass along an axis of n cells as a matrix: cut at 4 sigma, edges mirrored."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = np.zeros((n, n))  # target j draws on mirror(j + k)
    for j in range(n):
        at = np.arange(j - radius, j + radius + 1) % (2 * n)
        np.add.at(out[j], np.where(at < n, at, 2 * n - 1 - at), kernel)
    return out


def smooth_each(df: DataFrame, value: str, sigmas: dict[str, float], sizes: dict[str, int], keys: list[str]) -> DataFrame:
    """(keys, axes, a column a sigma, called as it is in sigmas): Gaussians with these standard deviations (in cells), one shuffle for all of
    them. sizes: the two axes and their lengths. Passes are products with small matrices, on batches of whole fields. Missing cells and nulls count as 0.
    """
    passes = [[_mirrored(s, n) for n in sizes.values()] for s in sigmas.values()]
    return on_fields(df, sizes, keys, [value], lambda field: [y @ field @ x.T for y, x in passes], sizes, list(sigmas))


def smooth(df: DataFrame, value: str, sigma: float, sizes: dict[str, int], keys: list[str]) -> DataFrame:
    """smooth_each() for one sigma, in place of the value."""
    return smooth_each(df, value, {value: sigma}, sizes, keys)


def smoothed(df: DataFrame, value: str, radius_km: float, sizes: dict[str, int], keys: list[str], cell_degrees: float = 0.1) -> DataFrame:
    """df's field smoothed over radius_km, under the name that tells radius and deviation (smoothed_name)."""
    name, sigma = smoothed_name(value, radius_km, cell_degrees)
    return smooth(df, value, sigma, sizes, keys).withColumnRenamed(value, name)


def write_smoothed(df: DataFrame, path: str, value: str, radii_km: list[float], sizes: dict[str, int], keys: list[str], cell_degrees: float = 0.1) -> DataFrame:
    """A data set with the field and its smoothings by every radius, side by side, written by year of `t` and read back."""
    sigmas = dict(smoothed_name(value, r, cell_degrees) for r in radii_km)
    out = df.join(smooth_each(df, value, sigmas, sizes, keys), [*keys, *sizes], "left")
    out.withColumn("year", F.year("t")).write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)
    return df.sparkSession.read.parquet(path)


def same_axes(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> bool:
    """Whether two grids have the same cells: equal indices, coordinates within tolerance."""
    cells = [g.select("y", "x", "lat", "lon").distinct() for g in (a, b)]
    met = cells[0].join(cells[1].withColumnsRenamed({"lat": "lat2", "lon": "lon2"}), ["y", "x"], "full")
    apart = F.greatest(F.abs(F.col("lat") - F.col("lat2")), F.abs(wrap(F.col("lon") - F.col("lon2"), 0.0)))
    return met.where(F.coalesce(apart, F.lit(float("inf"))) > tolerance).isEmpty()


def nearest_cells(cells: DataFrame, lat_to: list[float], lon_to: list[float]) -> DataFrame:
    """(ty, tx, y, x, w = 1): of a rectilinear grid, the source cell nearest to each target; ties go to the first. Axis by axis, so
    no target meets all cells."""
    spark = cells.sparkSession

    def axis(c: str, index: str, to: list[float], name: str) -> DataFrame:
        lines = cells.groupBy(index).agg(F.first(c).alias(c))
        targets = spark.createDataFrame(list(enumerate(map(float, to))), f"{name} int, at double")
        away = F.abs(wrap(F.col(c) - F.col("at"), 0.0)) if c == "lon" else F.abs(F.col(c) - F.col("at"))
        return nearest(targets.crossJoin(lines), away, [name], [index], [])  # two axes, not cells

    return axis("lat", "y", lat_to, "ty").crossJoin(axis("lon", "x", lon_to, "tx")).select("ty", "tx", "y", "x", F.lit(1.0).alias("w"))


def smoothed_name(value: str, radius_km: float, cell_degrees: float = 0.1) -> tuple[str, float]:
    sigma = radius_km / (3 * cell_degrees * 111)
    return f"{value}_smoothed_R{radius_km:.1f}_s{sigma:.1f}", sigma


def crop_centre(df: DataFrame, h: int, w: int, height: int, width: int) -> DataFrame:
    top, left = max((h - height) // 2, 0), max((w - width) // 2, 0)
    kept = df.where(F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1))
    return kept.withColumns({"y": (F.col("y") - top).cast("int"), "x": (F.col("x") - left).cast("int")})


def match_size(df: DataFrame, h: int, w: int, height: int, width: int) -> DataFrame:
    """Cropped or padded to height x width; padding repeats the last row and column."""

    def copies(c: str, n: int, want: int) -> Column:
        last = F.sequence(F.lit(n - 1), F.lit(max(want, n) - 1)).cast("array<int>") if want > n else F.array(F.lit(n - 1))
        return F.when(F.col(c) == n - 1, last).otherwise(F.array(F.col(c)))

    out = df.withColumn("y", F.explode(copies("y", h, height))).withColumn("x", F.explode(copies("x", w, width)))
    return out.where((F.col("y") < height) & (F.col("x") < width))


def point_or_range(df: DataFrame, **bounds) -> DataFrame:
    """Selection by labels: None all, a number that label, a pair what lies between."""
    for c, b in bounds.items():
        df = df.where(within(F.col(c), b))
    return df

