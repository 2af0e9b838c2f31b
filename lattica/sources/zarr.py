"""Chunked array stores (Zarr, version 2): a data source with a partition per chunk, pruned by bounds, and a writer with a file per chunk.

A store is a folder: for each array `.zarray` and `.zattrs` (JSON) and a file per chunk, and `.zmetadata` with all JSON once the store is
whole. Chunks are compressed by zstd, zlib, gzip or not at all. Files are reached through pyarrow's file systems, so a path may be a URI.
"""

from __future__ import annotations

import gzip
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.functions.store import kept
from lattica.registry import SOURCES
from lattica.sources.base import ALIASES, Source

#: Seconds of the units that time coordinates are counted in.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
SINCE = re.compile(r"(\w+) since (\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}(?::\d{2})?))?")
SPACE = {"lat": "y", "lon": "x"}


def _decompressed(raw: bytes, how: dict | None) -> bytes:
    kind = how and how["id"]
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if kind in (None, "zlib", "gzip"):
        return {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}[kind](raw)
    raise ValueError(f"compressor {kind!r} is not supported")


class Folder:
    """Files below a path or URI."""

    def __init__(self, path: str):
        from pyarrow import fs as files  # where files are reached: it starts threads

        self.files = files
        self.fs, self.root = files.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (files.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def read(self, name: str) -> bytes | None:
        at = f"{self.root}/{name}"
        if self.fs.get_file_info(at).type != self.files.FileType.File:
            return None
        with self.fs.open_input_stream(at) as f:
            return f.read()

    def write(self, name: str, raw: bytes) -> None:
        """Under another name first, so that a reader sees all of it or nothing; a retried task writes the same again."""
        at = f"{self.root}/{name}"
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        aside = f"{at}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(raw)
        self.fs.move(aside, at)


class Store(Folder):
    """Metadata of a store, and its chunks as arrays."""

    def __init__(self, path: str):
        super().__init__(path)
        whole = self.read(".zmetadata")
        if whole:
            entries = json.loads(whole)["metadata"]
        else:
            found = self.fs.get_file_info(self.files.FileSelector(self.root, recursive=True, allow_not_found=True))
            names = [f.path[len(self.root) + 1 :] for f in found if f.base_name in (".zarray", ".zattrs")]
            entries = {n: json.loads(self.read(n)) for n in names}
        self.arrays = {k.rpartition("/")[0]: v for k, v in entries.items() if k.endswith("/.zarray")}
        self.notes = {k: entries.get(f"{k}/.zattrs", {}) for k in self.arrays}

    def dims(self, name: str) -> tuple[str, ...]:
        return tuple(self.notes[name].get("_ARRAY_DIMENSIONS", ()))

    def chunk(self, name: str, at: tuple[int, ...]) -> np.ndarray:
        """A chunk without what lies beyond the array's ends; a chunk without file holds the fill value."""
        meta = self.arrays[name]
        raw = self.read(f"{name}/{meta.get('dimension_separator', '.').join(map(str, at)) or '0'}")
        kind, shape = np.dtype(meta["dtype"]), tuple(meta["chunks"])
        if raw is None:
            fill = meta["fill_value"]
            out = np.full(shape, np.nan if fill in (None, "NaN") and kind.kind == "f" else fill or 0, kind)
        else:
            out = np.frombuffer(_decompressed(raw, meta["compressor"]), kind).reshape(shape, order=meta.get("order", "C"))
        return out[tuple(slice(0, max(n - k * c, 0)) for n, c, k in zip(meta["shape"], shape, at, strict=True))]

    def whole(self, name: str) -> np.ndarray:
        """A coordinate, small beside the variables."""
        meta = self.arrays[name]
        out = np.empty(meta["shape"], np.dtype(meta["dtype"]))
        for at in itertools.product(*(range(-(-n // c)) for n, c in zip(meta["shape"], meta["chunks"], strict=True))):
            out[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, meta["chunks"], strict=True))] = self.chunk(name, at)
        return out


def _times(values: np.ndarray, units: str) -> np.ndarray:
    """Microseconds since 1970."""
    unit, day, clock = SINCE.match(units).groups()
    start = np.datetime64(f"{day}T{clock or '00:00'}", "us").astype(np.int64)
    return start + np.round(values.astype(float) * 1e6).astype(np.int64) * UNITS[unit] if values.dtype.kind == "f" else start + values.astype(np.int64) * (UNITS[unit] * 1_000_000)


class Layout:
    """How the variables of a store become rows: a column per dimension, y and x as indices, lat and lon beside them."""

    def __init__(self, store: Store, variables: list[str] | None = None):
        role = {n: k for k, names in ALIASES.items() for n in names}
        coordinates = {a for a in store.arrays if a in role or a in store.dims(a)}
        self.variables = variables or sorted(a for a in store.arrays if a not in coordinates and store.dims(a))
        self.dims = store.dims(self.variables[0])
        shapes = {(store.dims(v), tuple(store.arrays[v]["shape"]), tuple(store.arrays[v]["chunks"])) for v in self.variables}
        if len(shapes) != 1:
            raise ValueError("the variables of a store differ in dimensions or chunks: name those to read in the option variables")
        _, self.shape, self.chunks = shapes.pop()
        self.names = [SPACE.get(role.get(d, d), role.get(d, d)) for d in self.dims]
        self.axes: dict[str, np.ndarray] = {}
        self.places: dict[str, tuple[tuple[int, ...], np.ndarray]] = {}
        for n, d in enumerate(self.dims):
            if d in store.arrays and self.names[n] not in SPACE.values():
                values = store.whole(d)
                self.axes[self.names[n]] = _times(values, store.notes[d]["units"]) if self.names[n] == "t" else values
        for a in coordinates:
            if role.get(a) in SPACE and all(d in self.dims for d in store.dims(a)):
                self.places[role[a]] = (tuple(self.dims.index(d) for d in store.dims(a)), store.whole(a).astype(float))

    def ddl(self) -> str:
        kind = {"t": "timestamp_ntz", "y": "int", "x": "int"}
        dims = [f"`{n}` {kind.get(n, 'int' if n not in self.axes or self.axes[n].dtype.kind in 'iu' else 'double')}" for n in self.names]
        return ", ".join([*dims, *(f"`{c}` double" for c in ("lat", "lon") if c in self.places), *(f"`{v}` double" for v in self.variables)])

    def window(self, at: tuple[int, ...], dims: tuple[int, ...]) -> tuple[slice, ...]:
        return tuple(slice(at[k] * self.chunks[k], min((at[k] + 1) * self.chunks[k], self.shape[k])) for k in dims)

    def values(self, column: str, at: tuple[int, ...]) -> np.ndarray | None:
        """What a column may hold in a chunk."""
        if column in self.places:
            dims, v = self.places[column]
            return v[self.window(at, dims)]
        if column in self.names:
            k = self.names.index(column)
            (w,) = self.window(at, (k,))
            return self.axes[column][w] if column in self.axes else np.arange(w.start, w.stop)
        return None


class Chunk(InputPartition):
    def __init__(self, at: tuple[int, ...]):
        self.at = at


class ZarrReader(DataSourceReader):
    """A partition per chunk that may hold a row within the bounds (column -> least and greatest value).

    Bounds are options of a read, not filters that Spark pushes down: what a pushed filter has pruned would stay pruned for the next use of the
    same DataFrame (Spark 4.1), which may have another filter or none.
    """

    def __init__(self, path: str, variables: list[str] | None, bounds: dict[str, list]):
        self.path, self.variables = path, variables
        self.bounds = {c: [int(np.datetime64(v, "us").astype(np.int64)) if isinstance(v, str) else v for v in ends] for c, ends in bounds.items()}

    def may_hold(self, layout: Layout, at: tuple[int, ...]) -> bool:
        for column, (least, greatest) in self.bounds.items():
            v = layout.values(column, at)
            if v is not None and not (np.nanmin(v) <= greatest and np.nanmax(v) >= least):
                return False
        return True

    def partitions(self) -> list[Chunk]:
        layout = Layout(Store(self.path), self.variables)
        every = itertools.product(*(range(-(-n // c)) for n, c in zip(layout.shape, layout.chunks, strict=True)))
        return [Chunk(at) for at in every if self.may_hold(layout, at)] or [Chunk(())]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        at = partition.at
        if not at:
            return
        store = Store(self.path)
        layout = Layout(store, self.variables)
        size = [w.stop - w.start for w in layout.window(at, range(len(at)))]
        spread = lambda v, dims: np.broadcast_to(v.reshape([size[k] if k in dims else 1 for k in range(len(size))]), size).ravel()
        columns = {}
        for k, n in enumerate(layout.names):
            v = spread(layout.values(n, at), (k,))
            columns[n] = pa.array(v).cast(pa.timestamp("us")) if n == "t" else pa.array(v.astype(np.int32 if v.dtype.kind in "iu" else float))
        for c in ("lat", "lon"):
            if c in layout.places:
                columns[c] = pa.array(spread(layout.values(c, at), layout.places[c][0]))
        for v in layout.variables:
            columns[v] = pa.array(store.chunk(v, at).astype(float).ravel(), from_pandas=True)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class ZarrDataSource(DataSource):
    """spark.read.format("zarr").load(path). Options: variables (names with commas) and bounds (JSON) of what to read."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _variables(self) -> list[str] | None:
        return self.options["variables"].split(",") if "variables" in self.options else None

    def schema(self) -> str:
        return Layout(Store(self.options["path"]), self._variables()).ddl()

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(self.options["path"], self._variables(), json.loads(self.options.get("bounds", "{}")))


def read_zarr(spark: SparkSession, path: str, variables: list[str] | None = None, bounds: dict[str, tuple] | None = None) -> DataFrame:
    """A row per cell of the arrays; NaN is null. bounds: dimensions, lat or lon -> (least, greatest); only rows within them come, and only chunks that
    may hold such rows are read."""
    spark.dataSource.register(ZarrDataSource)
    told = {c: [v.isoformat() if isinstance(v, datetime) else v for v in ends] for c, ends in (bounds or {}).items()}
    reader = spark.read.format("zarr").option("bounds", json.dumps(told))
    df = (reader.option("variables", ",".join(variables)) if variables else reader).load(path)
    for c, ends in (bounds or {}).items():
        df = df.where(F.col(c).between(*(F.expr(f"timestamp_ntz'{v:%Y-%m-%d %H:%M:%S.%f}'") if isinstance(v, datetime) else v for v in ends)))
    return df


def write_zarr(df: DataFrame, path: str, variables: list[str], chunks: dict[str, int]) -> DataFrame:
    """df's cells (t, other dimensions, y, x, lat, lon, variables) as a store with these chunk lengths; a row per chunk file: (variable, chunk, bytes).

    chunks names the dimensions in order, y and x the last. Each chunk is written whole by one task, after a shuffle by chunk; metadata comes last, so a
    store without .zmetadata is not done. Chunks without a row have no file. Of rows for one cell any may win. Axes, not cells, reach the
    driver; lat and lon are written along y and x where each depends on one of them, else as arrays of both.
    """
    spark, store = df.sparkSession, Store(path)
    if store.arrays:
        raise FileExistsError(path)
    dims = list(chunks)
    if dims[-2:] != ["y", "x"]:
        raise ValueError("the last two dimensions are y and x")
    df = df.where(" and ".join(f"`{d}` is not null" for d in dims))
    lines = [df.groupBy(i).agg(F.min(c).alias("low"), F.max(c).alias("high")).orderBy(i).collect() for i, c in (("y", "lat"), ("x", "lon"))]  # two axes
    if not all(lines):
        raise ValueError("there are no cells")
    shape = {"y": lines[0][-1]["y"] + 1, "x": lines[1][-1]["x"] + 1}
    along = all(r["low"] == r["high"] for line in lines for r in line)
    axes = {d: sorted(r[0] for r in df.select(d).distinct().collect()) for d in dims[:-2]}
    shape = {d: len(axes[d]) if d in axes else shape[d] for d in dims}

    def laid(rows: DataFrame, of: list[str], values: list[str]) -> DataFrame:
        """Chunk files of values whose dimensions are `of`."""
        for d in of:
            if d in axes:
                order = spark.createDataFrame([(v, k) for k, v in enumerate(axes[d])], f"`{d}` {df.schema[d].dataType.simpleString()}, `_i_{d}` int")
                rows = rows.join(order, d)
            else:
                rows = rows.withColumn(f"_i_{d}", F.col(d).cast("int"))
        size = [chunks[d] for d in of]
        place = F.lit(0)
        for d in of:
            place = place * chunks[d] + F.col(f"_i_{d}") % chunks[d]
        key = F.concat_ws(".", *[F.floor(F.col(f"_i_{d}") / chunks[d]).cast("string") for d in of])
        rows = rows.select(key.alias("chunk"), place.cast("int").alias("place"), *[F.col(v).cast("double").alias(v) for v in values])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            target, pack = Folder(path), zstandard.ZstdCompressor(level=3)
            now, held = None, []

            def commit() -> Iterator[pa.RecordBatch]:
                if now is None:
                    return
                t = pa.Table.from_batches(held)
                sizes = []
                for v in values:
                    cells = np.full(int(np.prod(size)), np.nan)
                    cells[t.column("place").to_numpy()] = t.column(v).to_numpy()
                    raw = pack.compress(cells.astype("<f8").tobytes())
                    target.write(f"{v}/{now}", raw)
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([now] * len(values)), pa.array(sizes, pa.int64())], names=["variable", "chunk", "bytes"])

            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if names[a] != now:
                        yield from commit()
                        now, held = names[a], []
                    held.append(batch.slice(a, b - a))
            yield from commit()

        return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "variable string, chunk string, bytes long")

    done = laid(df, dims, variables)
    if not along:
        done = done.union(laid(df.groupBy("y", "x").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")), ["y", "x"], ["lat", "lon"]))
    done = kept(done)  # runs it once
    metadata: dict[str, dict] = {".zgroup": {"zarr_format": 2}}

    def describe(name: str, of: list[str], lengths: list[int], kind: str, compressor: dict | None, notes: dict) -> None:
        metadata[f"{name}/.zarray"] = {"zarr_format": 2, "shape": [shape[d] for d in of], "chunks": lengths, "dtype": kind, "compressor": compressor, "fill_value": "NaN" if kind == "<f8" else None, "order": "C", "filters": None}
        metadata[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": of} | notes

    packed = {"id": "zstd", "level": 3}
    for v in variables:
        describe(v, dims, [chunks[d] for d in dims], "<f8", packed, {})
    for d, values in axes.items():
        if d == "t":
            raw, kind, notes = [int(np.datetime64(v, "s").astype(np.int64)) for v in values], "<i8", {"units": "seconds since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"}
        else:
            raw, kind, notes = values, "<i8" if isinstance(values[0], int) else "<f8", {}
        store.write(f"{d}/0", np.array(raw, kind).tobytes())
        describe(d, [d], [shape[d]], kind, None, notes)
    for c, i, line in zip(("lat", "lon"), ("y", "x"), lines, strict=True):
        if along:
            values = np.full(shape[i], np.nan)
            values[[r[i] for r in line]] = [r["low"] for r in line]
            store.write(f"{c}/0", values.astype("<f8").tobytes())
            describe(c, [i], [shape[i]], "<f8", None, {})
        else:
            describe(c, ["y", "x"], [chunks["y"], chunks["x"]], "<f8", packed, {})
    for name, entry in metadata.items():
        store.write(name, json.dumps(entry).encode())
    store.write(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": metadata}).encode())
    return done


@SOURCES.register("zarr")
class ZarrSource(Source):
    """A store of chunked arrays; the selection's period and latitudes decide which chunks are read."""

    def __init__(self, spark: SparkSession, source, path: str):
        super().__init__(spark, source)
        self.path = path

    def read(self) -> DataFrame:
        chosen = self.source.selection
        return read_zarr(self.spark, self.path, bounds={"t": (chosen.period.start, chosen.period.end), "lat": tuple(map(float, sorted(chosen.region.lat)))})
