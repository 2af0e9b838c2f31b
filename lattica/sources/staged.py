"""Fetches that are kept: requests run in tasks, and what they give and how they ended is written as Parquet, so that a later run fetches only what is lacking.

An attempt is one Spark write of rows and of a status row per request; it counts once the write has committed. Tasks that are lost
are run again by Spark and leave nothing behind. A try that fails halfway leaves rows that its request's status doesn't name; they are never read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

STATUS = "request string, attempt long, try int, status string, n_rows long, error string"
#: Characters of an error's text that the ledger keeps.
ERROR_LENGTH = 500


class Staged:
    """Requests and their results below a folder that driver and executors share.

    fetch: a request's row as a dict -> pandas frames with columns of ddl (those that a frame lacks are null). Errors of the kinds named are tried
    again, up to `tries` times with doubled waits, and then noted as the request's status; others fail the job.
    """

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[dict], Iterator[pd.DataFrame]], ddl: str, tries: int = 1, base_sleep: float = 1.0, errors: tuple[type[Exception], ...] = (OSError,)):
        self.spark, self.path, self.fetch, self.ddl = spark, path.rstrip("/"), fetch, StructType.fromDDL(ddl)
        self.tries, self.base_sleep, self.errors = tries, base_sleep, errors

    def _written(self, part: str) -> DataFrame:
        """Rows or status rows of all attempts that have committed."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path

        def under(name: str) -> dict[str, str]:
            at = hadoop(f"{self.path}/*/{name}")
            found = [f.getPath() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []]
            return {p.getParent().toString(): p.toString() for p in found}

        done, parts = under("_SUCCESS"), under(f"part={part}")
        schema = StructType([f for f in self._schema() if f.name != "part"])
        paths = [parts[attempt] for attempt in sorted(done.keys() & parts.keys())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _schema(self) -> StructType:
        return StructType([*StructType.fromDDL(STATUS), *self.ddl, *StructType.fromDDL("part string")])

    def ledger(self) -> DataFrame:
        """(request, attempt, try, status, n_rows, error): how each request that was ever made ended last. Status: ok, empty (no rows) or failed."""
        names = StructType.fromDDL(STATUS).names
        last = self._written("status").groupBy("request").agg(F.max_by(F.struct(*names[1:]), "attempt").alias("s"))
        return last.select("request", *[F.col(f"s.{n}").alias(n) for n in names[1:]])

    def lacking(self, requests: DataFrame) -> DataFrame:
        """Requests that were never made or have failed."""
        return requests.join(self.ledger().where(F.col("status") != "failed"), "request", "left_anti")

    def rows(self) -> DataFrame:
        """What the requests gave, with the request."""
        ok = self.ledger().where(F.col("status") == "ok").select("request", "attempt", "try")
        return self._written("rows").join(ok, ["request", "attempt", "try"], "left_semi").select("request", *self.ddl.names)

    def missed(self, requests: DataFrame, key: str = "t") -> DataFrame:
        """Labels of the requests none of which gave a row."""
        given = requests.join(self.ledger().where(F.col("status") == "ok"), "request", "left_semi")
        return requests.select(key).distinct().join(given.select(key).distinct(), key, "left_anti")

    def run(self, requests: DataFrame, per_task: int = 1) -> Staged:
        """One attempt at what is lacking. requests: a row each, with an id of its own (`request`) and what fetch needs; per_task of them run in a task."""
        todo = self.lacking(requests)
        n = todo.count()
        if not n:
            return self
        last = self._written("status").agg(F.max("attempt")).first()[0]
        attempt, schema = 0 if last is None else last + 1, self._schema()
        fetch, tries, base_sleep, errors, layout = self.fetch, self.tries, self.base_sleep, self.errors, to_arrow_schema(schema)

        def asked(request: dict) -> Iterator[pd.DataFrame]:
            for k in range(tries):
                rows, error = 0, None
                try:
                    for frame in fetch(request):
                        rows += len(frame)
                        yield frame.assign(**{"request": request["request"], "attempt": attempt, "try": k, "part": "rows"})
                    break
                except errors as e:
                    error = f"{type(e).__name__}: {e}"[:ERROR_LENGTH]
                    if k + 1 < tries:
                        time.sleep(base_sleep * 2**k)
            status = "failed" if error else "ok" if rows else "empty"
            yield pd.DataFrame([{"request": request["request"], "attempt": attempt, "try": k, "status": status, "n_rows": rows, "error": error, "part": "status"}])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for request in batch.to_pylist():
                    for frame in asked(request):
                        columns = [pa.array(frame[f.name], f.type, from_pandas=True) if f.name in frame else pa.nulls(len(frame), f.type) for f in layout]
                        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                        yield pa.RecordBatch.from_arrays(columns, schema=layout)

        dealt = todo.repartition(-(-n // per_task), "request")
        dealt.mapInArrow(task, schema).write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{attempt:06d}-{uuid.uuid4().hex}")
        return self
