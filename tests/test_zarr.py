"""Chunked array stores: what is written is read back, chunks are pruned, and stores of others are understood."""

import json
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.registry import SOURCES
from lattica.sources import zarr
from lattica.spec import DataSource, Region, Selection, TimeRange, Variable

CHUNKS = {"t": 4, "y": 2, "x": 3}


def cells(spark, curved=False, members=False):
    t0 = datetime(2020, 1, 1)
    rows = [
        (t0 + timedelta(days=t), m, y, x, 50.0 - y + (0.1 * x if curved else 0), 170.0 + x + (0.2 * y if curved else 0), float(100 * t + 10 * y + x + 1000 * m), None if (t + y + x) % 5 == 0 else 1.0 * t)
        for t in range(10) for m in range(2 if members else 1) for y in range(5) for x in range(7) if not (t >= 8 and y < 2)
    ]
    return spark.createDataFrame(rows, "t timestamp_ntz, realization int, y int, x int, lat double, lon double, u double, w double")


def values(df, *keys):
    return {tuple(r[k] for k in keys): (r["lat"], r["lon"], r["u"], r["w"]) for r in df.collect()}


@pytest.mark.parametrize("curved", [False, True])
@pytest.mark.parametrize("members", [False, True])
def test_round_trip(spark, tmp_path, curved, members):
    df, path = cells(spark, curved, members), str(tmp_path / "store")
    keys = ["t", *(["realization"] if members else []), "y", "x"]
    ledger = zarr.write_zarr(df, path, ["u", "w"], {"t": 4, **({"realization": 1} if members else {}), "y": 2, "x": 3}).collect()
    assert len({(r["variable"], r["chunk"]) for r in ledger}) == len(ledger) and all((tmp_path / "store" / r["variable"] / r["chunk"]).stat().st_size == r["bytes"] for r in ledger)
    back = zarr.read_zarr(spark, f"file://{path}")
    assert dict(back.dtypes)["t"] == "timestamp_ntz" and dict(back.dtypes)["u"] == "double"
    got, want = values(back, *keys), values(df, *keys)
    assert len(got) == 10 * (2 if members else 1) * 5 * 7 and all(got[k] == want[k] for k in want)
    assert all(got[k][2:] == (None, None) for k in got if k not in want)
    assert zarr.read_zarr(spark, path, ["w"]).columns == [*keys, "lat", "lon", "w"]
    with pytest.raises(FileExistsError):
        zarr.write_zarr(df, path, ["u"], CHUNKS)


def test_bounds_prune_chunks(spark, tmp_path):
    """3 x 3 x 3 chunks of 10 times, 5 rows and 7 columns."""
    path = str(tmp_path / "store")
    zarr.write_zarr(cells(spark), path, ["u", "w"], CHUNKS)
    left = lambda **bounds: [c.at for c in zarr.ZarrReader(path, None, bounds).partitions()]
    assert len(left()) == 27
    assert len(left(t=["2020-01-05T00:00:00", "2020-01-08T12:00:00"])) == 9
    assert left(t=["2020-01-10T00:00:00", "2020-01-10T00:00:00"], lat=[45.0, 46.5], lon=[175.5, 180.0]) == [(2, 2, 2)]
    assert left(t=["2020-01-01T00:00:00", "2020-01-02T00:00:00"], y=[4, 4], x=[6, 6]) == [(0, 2, 2)]
    assert left(t=["2021-01-01T00:00:00", "2022-01-01T00:00:00"]) == [()]
    some = zarr.read_zarr(spark, path, bounds={"t": (datetime(2020, 1, 5), datetime(2020, 1, 6)), "lat": (46.0, 47.5)})
    assert {(r["t"].day, r["y"]) for r in some.collect()} == {(d, y) for d in (5, 6) for y in (3, 4)} and some.count() == 28
    assert zarr.read_zarr(spark, path, bounds={"t": (datetime(2021, 1, 1), datetime(2022, 1, 1))}).count() == 0
    df = zarr.read_zarr(spark, path)  # one frame, used with several filters
    assert [df.where("y = 4").count(), df.count(), df.where("y = 1").count(), df.count()] == [70, 350, 70, 350]


def put(folder, name, meta, notes, chunks):
    (folder / name).mkdir(parents=True)
    (folder / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "order": "C", "filters": None, "fill_value": None, "compressor": None} | meta))
    (folder / name / ".zattrs").write_text(json.dumps(notes))
    for at, raw in chunks.items():
        (folder / name / at).write_bytes(raw)


def test_a_store_of_others(spark, tmp_path):
    """Other names, hours since a date, big-endian floats, zlib, Fortran order, a fill value, a missing chunk, no .zmetadata."""
    field = np.arange(24, dtype=">f4").reshape(2, 3, 4)
    put(tmp_path, "time", {"shape": [2], "chunks": [2], "dtype": "<i4"}, {"_ARRAY_DIMENSIONS": ["time"], "units": "hours since 1900-01-01 00:00:00"}, {"0": np.array([1051896, 1051902], "<i4").tobytes()})
    put(tmp_path, "latitude", {"shape": [3], "chunks": [3], "dtype": "<f8"}, {"_ARRAY_DIMENSIONS": ["latitude"]}, {"0": np.array([10.0, 9.0, 8.0]).tobytes()})
    put(tmp_path, "longitude", {"shape": [4], "chunks": [4], "dtype": "<f8"}, {"_ARRAY_DIMENSIONS": ["longitude"]}, {"0": np.array([0.0, 1.0, 2.0, 3.0]).tobytes()})
    first = zlib.compress(field[:1].tobytes(order="F"))
    put(tmp_path, "t2m", {"shape": [2, 3, 4], "chunks": [1, 3, 4], "dtype": ">f4", "order": "F", "compressor": {"id": "zlib", "level": 1}, "fill_value": -1.0}, {"_ARRAY_DIMENSIONS": ["time", "latitude", "longitude"]}, {"0.0.0": first})
    df = zarr.read_zarr(spark, str(tmp_path))
    assert df.columns == ["t", "y", "x", "lat", "lon", "t2m"]
    got = {(r["t"], r["y"], r["x"]): (r["lat"], r["lon"], r["t2m"]) for r in df.collect()}
    for n in range(2):
        for y in range(3):
            for x in range(4):
                assert got[datetime(2020, 1, 1, 6 * n), y, x] == (10.0 - y, float(x), float(field[n, y, x]) if n == 0 else -1.0)


def test_a_source_of_chunks(spark, tmp_path):
    """The selection's period and box, by the registered source; a store without cells is refused."""
    path = str(tmp_path / "store")
    zarr.write_zarr(cells(spark), path, ["u", "w"], CHUNKS)
    chosen = Selection((Variable("u"),), Region("r", (171.0, 173.0), (46.0, 48.0)), TimeRange(datetime(2020, 1, 2), datetime(2020, 1, 3)))
    got = SOURCES["zarr"](spark, DataSource("s", chosen), path).load()
    assert got.count() == 2 * 3 * 3 and got.where(F.col("u").isNull()).count() == 0 and "w" not in got.columns
    with pytest.raises(ValueError):
        zarr.write_zarr(cells(spark).where("false"), str(tmp_path / "none"), ["u"], CHUNKS)
