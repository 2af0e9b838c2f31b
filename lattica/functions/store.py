"""The folder that driver and executors share, and cutting the lineage of tables that later steps read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. Where spark.checkpoint.dir is unset, a local master gets a folder of its own and a cluster is refused."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lattica-"))
    return context.getCheckpointDir().rstrip("/")


def kept(df: DataFrame, files: int | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so that its size is known to later joins. files: coalesce to so many, for tables known to
    be small."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
