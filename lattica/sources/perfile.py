"""Archives with a file per date and member, read file by file inside tasks: each file is projected, cut to a lead time, given its member's number and
passed through the user's step before its rows leave the task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources.base import ALIASES, find
from lattica.sources.staged import Staged

#: Rows that a reader holds at once.
BATCH = 65_536
PLACE = {"level": "double", "y": "int", "x": "int", "lat": "double", "lon": "double"}


class Opened(Protocol):
    """A file that is open: its columns' names, and the rows of some columns, batch by batch and as often as asked."""

    names: list[str]

    def batches(self, columns: list[str]) -> Iterator[pd.DataFrame]: ...


def located(path: str):
    """pyarrow's file system for a path or URI, and the path in it. Paths from Spark's listings are not percent-encoded."""
    from pyarrow import fs as files  # where files are reached: it starts threads

    if found := re.match(r"(?!file:)(\w+://[^/]*)(/.*)", path):
        return files.FileSystem.from_uri(found[1] + "/")[0], found[2].lstrip("/") if found[1].startswith("s3") else found[2]
    return files.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


class ParquetFile:
    def __init__(self, path: str):
        from pyarrow import parquet

        where, at = located(path)
        self.file = parquet.ParquetFile(where.open_input_file(at))
        self.names = self.file.schema_arrow.names

    def batches(self, columns: list[str]) -> Iterator[pd.DataFrame]:
        for batch in self.file.iter_batches(BATCH, columns=columns):
            yield batch.to_pandas()


class CsvFile:
    def __init__(self, path: str):
        self.path = path
        self.names = self._open(None).schema.names

    def _open(self, columns: list[str] | None):
        from pyarrow import csv

        where, at = located(self.path)
        return csv.open_csv(where.open_input_stream(at), convert_options=csv.ConvertOptions(include_columns=columns))

    def batches(self, columns: list[str]) -> Iterator[pd.DataFrame]:
        for batch in self._open(columns):
            yield batch.to_pandas()


def hours(lead: pd.Series) -> pd.Series:
    """Lead times as hours, from durations or from numbers that are hours."""
    return lead / pd.Timedelta(hours=1) if lead.dtype.kind == "m" else lead.astype(float)


def nearest(opened: Opened, column: str, target: float) -> float | None:
    """The lead time of the file that is closest to target hours, the first in the file of equals; None where the file has none."""
    best = None
    for batch in opened.batches([column]):
        for lead in hours(batch[column]).dropna().drop_duplicates():
            if best is None or abs(lead - target) < abs(best - target):
                best = float(lead)
    return best


def file_fetch(variables: list[str], lead: float | None, step: Callable[[pd.DataFrame, dict], pd.DataFrame] | None, opener: Callable[[str], Opened]) -> Callable[[dict], Iterator[pd.DataFrame]]:
    """A fetch of one file: request is its path, with its date `t` and member `realization`.

    Columns are found by their usual names (`base.ALIASES`). A file without time column has its request's date. A file with several
    lead times gives the one nearest to `lead` hours. A variable that the file lacks is null; a file with none of them gives no rows.
    """

    def fetch(request: dict) -> Iterator[pd.DataFrame]:
        opened = opener(request["request"])
        has = [v for v in variables if v in opened.names]
        if not has:
            return
        roles = {name: c for name in [*ALIASES, "y", "x"] if name != "realization" and (c := find(opened.names, name)) and c not in has}
        only = nearest(opened, roles["lead"], lead) if lead is not None and "lead" in roles else None
        for batch in opened.batches([*roles.values(), *has]):
            out = batch.rename(columns={c: name for name, c in roles.items()})
            if "lead" in out:
                out["lead"] = hours(out["lead"])
                out = out[out["lead"] == only] if only is not None else out
            if "t" in out:
                out["t"] = pd.to_datetime(out["t"])
            else:
                out = out.assign(t=request["t"])
            out = out.assign(realization=request["realization"])
            yield step(out, request) if step else out

    return fetch


def numbered(files: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(request, t, realization): each date's files are its members, numbered from 0 in the order given, else the newest first and by path. A
    window holds the files of one date, no rows of theirs."""
    by = [F.col(c) for c in order] if order else [F.desc("mtime"), F.col("path")]
    number = F.row_number().over(Window.partitionBy("t").orderBy(*by)) - 1
    return files.select(F.col("path").alias("request"), F.col("t").cast("timestamp_ntz").alias("t"), number.cast("int").alias("realization"))


def read_members(spark: SparkSession, requests: DataFrame, path: str, variables: list[str], lead: float | None = None, step: Callable[[pd.DataFrame, dict], pd.DataFrame] | None = None, opener: Callable[[str], Opened] = ParquetFile, files_per_task: int = 8, tries: int = 3) -> Staged:
    """The files of `numbered` read once into the folder `path`. rows() are (request, t, realization, lead, level, y, x, lat, lon, variables); the
    ledger tells which files were read, held none of the variables or could not be read, and missed() the dates without any member.
    A task holds one batch of one file. step: (rows of a file, its request) -> rows, run in the task."""
    ddl = ", ".join(["t timestamp_ntz", "realization int", "lead double", *[f"{c} {kind}" for c, kind in PLACE.items()], *[f"`{v}` double" for v in variables]])
    staged = Staged(spark, path, file_fetch(variables, lead, step, opener), ddl, tries, errors=(OSError, ValueError))
    return staged.run(requests, files_per_task)
