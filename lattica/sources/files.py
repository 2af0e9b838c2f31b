"""Archives of files: which files hold which dates, from a listing that Spark makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import align


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, mtime, name) of the files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def index(spine: DataFrame, files: DataFrame, header: str, date_format: str, lead_hours: int, both_dates: bool, realizations: int | None = None, minus_hours: int | None = None, plus_hours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(t, path, mtime, kind) and the dates without files.

    A name is the header, the date of the run (t less the lead time), and with both_dates t itself. Where a date has no file, one
    for t - minus_hours counts (kind 1), else one for t + plus_hours (kind 2), if both are given. realizations: newest files per date.
    """
    if realizations is not None and realizations <= 0:
        raise ValueError("realizations has to be positive")
    run = F.col("t") - F.expr(f"interval {lead_hours} hours")
    shifts = [(0, 0)] + ([(1, -minus_hours), (2, plus_hours)] if both_dates and minus_hours is not None and plus_hours is not None else [])
    wanted = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(header), F.date_format(run, date_format), F.date_format(F.col("t") + F.expr(f"interval {h} hours"), date_format) if both_dates else F.lit("")).alias("stem")) for kind, h in shifts])
    asked = spine.select("t", F.explode(wanted).alias("w")).select("t", "w.kind", "w.stem")
    length = F.length("stem")
    n = asked.agg(F.max(length)).first()[0] or 0  # stems of one archive are equally long
    met = asked.join(files.withColumn("stem", F.substring("name", 1, n)), "stem")
    best = met.groupBy("t").agg(F.min("kind").alias("kind"))
    found = met.join(best, ["t", "kind"]).select("t", "path", "mtime", "kind")
    if realizations is not None:
        exact = align.newest(found.where("kind = 0"), realizations).drop("rank")
        found = exact.union(found.where("kind > 0"))
    return found, align.missing(spine, found)
