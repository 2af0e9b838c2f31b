"""Remote archives: requests planned as partitions of a Python data source, fetched by a transport that the user supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.functions.timeaxis import request_chunks
from lattica.spec import Region, Variable


def area(region: Region) -> list[float]:
    """[north, west, south, east]."""
    return [max(region.lat), region.lon[0], min(region.lat), region.lon[1]]


def common_leadtime(variables: tuple[Variable, ...]):
    leads = {(v.leadtime.name, v.leadtime.unit, v.leadtime.value) if v.leadtime else None for v in variables}
    if len(leads) > 1:
        raise ValueError("variables differ in lead time")
    return leads.pop()


def expected_missing(months: list[datetime], lead_months: int, skip: frozenset[str]) -> list[datetime]:
    """Months whose run (lead_months before) falls in a month that is never requested."""
    return [t for t in months if f"{(t.month - 1 - lead_months) % 12 + 1:02d}" in skip]


def with_retries(call: Callable, tries: int = 5, base_sleep: float = 1.0, sleep: Callable = time.sleep):
    """call() again after errors, waiting base_sleep, twice that, and so on. Nothing of the user's is deleted."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            sleep(base_sleep * 2**k)


class Chunk(InputPartition):
    def __init__(self, request: dict):
        self.request = request


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict, schema, transport: Callable[[dict], Iterator[tuple]]):
        self.options, self.schema, self.transport = options, schema, transport

    def partitions(self) -> list[Chunk]:
        """A request for each year, or for each run of split_month months."""
        start, end = (datetime.fromisoformat(self.options[k]) for k in ("start", "end"))
        months = int(self.options["split_month"]) if "split_month" in self.options else None
        skip = frozenset(filter(None, self.options.get("split_month_jump", "").split(",")))
        return [Chunk(c) for c in request_chunks(start, end, months, skip)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        yield from with_retries(lambda: list(self.transport(partition.request)), int(self.options.get("tries", 5)), float(self.options.get("base_sleep", 1)))


def remote_source(name: str, ddl: str, transport: Callable[[dict], Iterator[tuple]]) -> type[DataSource]:
    """A data source class to register: spark.dataSource.register(remote_source("cds", "t timestamp_ntz, ...", fetch))."""

    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> RemoteReader:
            return RemoteReader(dict(self.options), schema, transport)

    return Remote
