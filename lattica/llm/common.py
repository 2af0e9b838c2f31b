"""What the text operators share: words, staged tables, the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs of everything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where unset, as in tests) a new one on a local master.

    A cluster without the setting is refused, as a machine's own folder would lose what executors write."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage(df: DataFrame, files: int | None = None, compression: str = "zstd", rows_a_file: int = 0) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    files: coalesce to so many files; only for results known to be small (a row per source, per shard). compression: "uncompressed"
    for bytes that are dense already. rows_a_file: 0 for any number.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", compression).option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for tables in _SCRATCH:
        tables.append(out)
    return out


#: Lists that scratch() collects staged tables in.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables staged inside, but for those the block takes off the list it is given."""
    tables: list[DataFrame] = []
    _SCRATCH.append(tables)
    try:
        yield tables
    finally:
        _SCRATCH.pop()
        for t in tables:
            drop_staged(t)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark, at = df.sparkSession, getattr(df, "_staged_at", None)
    if at:
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete shuffle files of plans that are done with now, rather than at the driver's next collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def word_count(text: Column) -> Column:
    """Number of words as a long; null and blank texts have 0."""
    t = trimmed(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE_RUN))).cast("long")


def words(text: Column) -> Column:
    """The words in order; null and blank texts have none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def unit_hash(*cols: Column, seed: int) -> Column:
    """Uniform in (0, 1), the same on every run: the top 53 bits of a 64-bit hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once a row; a literal in it is sent to the tasks once. A fold over nothing: the cheapest way to name a value."""
    return F.aggregate(F.array(), value, lambda a, _: a, body)
