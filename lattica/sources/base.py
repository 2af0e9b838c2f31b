"""Sources: lazily read, cached once, with a date spine and the dates that are missing."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.geo import wrap
from lattica.functions.timeaxis import spine
from lattica.operators import align, grid
from lattica.registry import SOURCES
from lattica.spec import DataSource, Leadtime, Selection

KEYS = ["t", "realization", "level", "y", "x"]
# Names under which archives publish the canonical columns.
ALIASES = {
    "t": ("t", "time", "valid_time", "time_counter", "source_time"),
    "lat": ("lat", "latitude", "nav_lat"),
    "lon": ("lon", "longitude", "nav_lon"),
    "level": ("level", "z", "isobaricInhPa"),
    "realization": ("realization", "number", "member"),
    "lead": ("lead", "leadtime", "step"),
}


def find(columns: Iterable[str], name: str) -> str | None:
    """The column that plays a canonical role, if there is one."""
    columns = list(columns)
    return next((c for c in (*ALIASES.get(name, ()), name) if c in columns), None)


def canonical(df: DataFrame) -> DataFrame:
    """Canonical names, times without zone, and null for NaN and infinities."""
    for name in ALIASES:
        if (c := find(df.columns, name)) and c != name:
            df = df.withColumnRenamed(c, name)
    if "t" in df.columns:
        df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    floats = [c for c, kind in df.dtypes if kind in ("float", "double")]
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in floats}) if floats else df


#: Hours of a lead time's unit.
HOURS = {"hour": 1, "hours": 1, "h": 1, "day": 24, "days": 24, "d": 24, "week": 168, "weeks": 168}


def lead_hours(lead: Leadtime) -> int:
    return lead.value * HOURS[lead.unit.lower()]


def selected(df: DataFrame, selection: Selection, curvilinear: bool = False, one_lead: bool | None = None) -> DataFrame:
    """Canonical rows within the selection: its period, region, and its variables' levels and lead times, where the rows have such columns.

    Regions are met in the longitudes -180 to 180, whichever the grid uses, with both ends; on curvilinear grids in half-open boxes,
    where rows and columns that a box touches stay and other cells are null. A variable with a level is null on the levels of
    others. A lead time is not asked for where the rows have one lead only; one_lead tells so, as None costs another scan of the column. `lead` is in hours.
    """
    p, variables = selection.period, [v for v in selection.variables if v.name in df.columns]
    keep = [c for c in df.columns if c in KEYS or c in ("lat", "lon", "lead") or c in [v.name for v in variables]]
    df = df.select(*keep)
    if "t" in keep:
        # literals without zone: a datetime's would be taken into the session's zone
        df = df.where(F.col("t").between(*(F.expr(f"timestamp_ntz'{end:%Y-%m-%d %H:%M:%S.%f}'") for end in (p.start, p.end))))
    levels = {v.name: float(v.levhpa if v.levhpa is not None else v.levm) for v in variables if v.levhpa is not None or v.levm is not None}
    if "level" in keep and levels:
        if len(levels) == len(variables):
            df = df.where(F.col("level").isin(*sorted(set(levels.values()))))
        df = df.withColumns({k: F.when(F.col("level") == at, F.col(k)) for k, at in levels.items()}) if len(set(levels.values())) > 1 or len(levels) < len(variables) else df
    leads = sorted({lead_hours(v.leadtime) for v in variables if v.leadtime is not None})
    if "lead" in keep and leads and not one_lead:
        asked = F.col("lead").isin(*leads)
        df = df.where(asked if one_lead is False else asked | df.agg((F.min("lead") == F.max("lead")).alias("only")).scalar())
    if "lat" in keep and "lon" in keep:
        if curvilinear:
            df = grid.subset_curvilinear(df.withColumn("lon", wrap(F.col("lon"), 0.0)), selection.region, [v.name for v in variables])
        else:
            df = grid.subset(df, selection.region, None)
    return df


class Source:
    """read() is what subclasses give; load() builds the plan once, subset to the selection, without running it."""

    #: Whether lat and lon vary along both axes.
    curvilinear = False
    #: Whether all rows have one lead time; None where the rows have to be asked.
    one_lead: bool | None = None

    def __init__(self, spark: SparkSession, source: DataSource):
        self.spark, self.source, self._loaded = spark, source, None

    def read(self) -> DataFrame:
        raise NotImplementedError

    def spine(self) -> DataFrame:
        p = self.source.selection.period
        return spine(self.spark, p.start, p.end, p.freq)

    def plan(self) -> DataFrame:
        return selected(canonical(self.read()), self.source.selection, self.curvilinear, self.one_lead)

    def load(self, persist: bool = False) -> DataFrame:
        if self._loaded is None:
            df = self.plan()
            self._loaded = df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df
        return self._loaded

    def reload(self) -> DataFrame:
        if self._loaded is not None:
            self._loaded.unpersist()
        self._loaded = None
        return self.load()

    def missed(self) -> DataFrame:
        return align.missing(self.spine(), self.load())

    def save(self, path: str) -> DataFrame:
        """Write by year and read back; a later run takes what is there (`saved_or`)."""
        self.load().withColumn("year", F.year("t")).write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)
        return self.spark.read.parquet(path)

    def __add__(self, other: Source) -> Source:
        return SumSource([self, other])


@SOURCES.register("parquet")
class ParquetSource(Source):
    """A store written by save() or alike; `year` directories are pruned from the period."""

    def __init__(self, spark: SparkSession, source: DataSource, path: str, missed: DataFrame | None = None):
        super().__init__(spark, source)
        self.path, self._missed = path, missed

    def read(self) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        p = self.source.selection.period
        if "year" in df.columns:
            df = df.where(F.col("year").between(p.start.year, p.end.year)).drop("year")
        return align.without(canonical(df), self._missed) if self._missed is not None else df


@SOURCES.register("frame")
class FrameSource(Source):
    """Any DataFrame factory."""

    def __init__(self, spark: SparkSession, source: DataSource, make: Callable[[], DataFrame]):
        super().__init__(spark, source)
        self._make = make

    def read(self) -> DataFrame:
        return self._make()


@SOURCES.register("sum")
class SumSource(Source):
    """Sources merged on their cells, with the variables that all have."""

    def __init__(self, parts: list[Source]):
        super().__init__(parts[0].spark, reduce(lambda a, b: a + b, [p.source for p in parts]))
        self.parts = parts

    def plan(self) -> DataFrame:
        frames = [p.load() for p in self.parts]
        keys = [k for k in [*KEYS, "lat", "lon"] if all(k in f.columns for f in frames)]
        return reduce(lambda a, b: align.merge(a, b, keys), frames)

    def reload(self) -> DataFrame:
        for p in self.parts:
            p.reload()
        return super().reload()


def saved_or(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The store at path if there is one, else build it, write it and read it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
