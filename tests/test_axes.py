"""Axes turned, rolled and cut by number, on hand-made grids."""

import pytest

from lattica.operators import grid


def cells(spark, lats, values=None):
    rows = [(y, x, lat, float(10 * y + x)) for y, lat in enumerate(lats) for x in range(2)]
    return spark.createDataFrame(rows, "y int, x int, lat double, v double")


def test_axes_that_run_down_are_turned(spark):
    got = grid.increasing(cells(spark, [5.0, 3.0, -1.0]), "lat", "y").orderBy("y", "x").collect()
    assert [(r["y"], r["lat"], r["v"]) for r in got] == [(0, -1.0, 20.0), (0, -1.0, 21.0), (1, 3.0, 10.0), (1, 3.0, 11.0), (2, 5.0, 0.0), (2, 5.0, 1.0)]
    up = cells(spark, [1.0, 2.0])
    assert sorted(grid.increasing(up, "lat", "y").collect()) == sorted(up.collect())
    assert grid.increasing(cells(spark, [7.0]), "lat", "y").count() == 2 and grid.increasing(up.limit(0), "lat", "y").count() == 0
    for bad in ([1.0, 3.0, 2.0], [1.0, 1.0]):
        with pytest.raises(Exception, match="neither runs up nor down"):
            grid.increasing(cells(spark, bad), "lat", "y").collect()


def test_a_grid_is_rolled_about_the_cut(spark):
    df = spark.createDataFrame([(x, lon, x * 1.0) for x, lon in enumerate([-180.0, -90.0, 0.0, 90.0])], "x int, lon double, v double")
    got = grid.rolled(df, 0.0).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 2.0), (1, 90.0, 3.0), (2, 180.0, 0.0), (3, 270.0, 1.0)]
    again = grid.rolled(grid.rolled(df, 0.0), -180.0).orderBy("x").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in df.orderBy("x").collect()]


def test_slices_by_number(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("b", 2), ("c", 9), (None, 1)], "t string, k int")
    assert [tuple(r) for r in grid.at_index(df, t=1, k=-1).collect()] == [("b", 2)]
    assert [tuple(r) for r in grid.at_index(df, t=-1).collect()] == [("c", 9)]
    assert grid.at_index(df, t=3).count() == 0 and grid.at_index(df, t=-4).count() == 0
    assert grid.at_index(df.limit(0), t=0).count() == 0
