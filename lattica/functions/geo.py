"""Longitudes, region predicates and area weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.spec import Region


def wrap(lon: Column | float, centre: float) -> Column:
    """lon in [centre - 180, centre + 180)."""
    lon = lon if isinstance(lon, Column) else F.lit(float(lon))
    return F.pmod(lon - centre + 180.0, F.lit(360.0)) - 180.0 + centre


def to_convention(bound: float, grid_min: float) -> float:
    """A requested longitude in the grid's convention: [0, 360) if the grid has no negative longitudes, else [-180, 180)."""
    return bound % 360 if grid_min >= 0 else (bound + 180) % 360 - 180


def within(value: Column, bounds: None | float | tuple[float, float]) -> Column:
    """None: everything; a number: equal; a pair in either order: between, ends included."""
    if bounds is None:
        return F.lit(True)
    if isinstance(bounds, tuple):
        return value.between(float(min(bounds)), float(max(bounds)))
    return value == F.lit(float(bounds))


def lon_between(lon: Column, west: float, east: float) -> Column:
    """Both ends included; west greater than east runs across the cut."""
    return lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)


def in_region(region: Region, lat: Column, lon: Column, grid_min: float | None = None) -> Column:
    """Ends included. grid_min: the grid's least longitude, which tells its convention; None wraps the longitudes, for any grid."""
    if abs(region.lon[1] - region.lon[0]) >= 360:
        return within(lat, region.lat)
    west, east = (to_convention(b, -180.0 if grid_min is None else grid_min) for b in region.lon)
    return within(lat, region.lat) & lon_between(wrap(lon, 0.0) if grid_min is None else lon, west, east)


def cos_lat(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def nearest(df: DataFrame, distance: Column, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """For each key the row at least distance; ties go to the first in `order`. One partial aggregation, no window."""
    best = df.groupBy(*keys).agg(F.min(F.struct(distance.alias("distance"), *order, *columns)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in columns])
