"""A batch source over a paged search API: time ranges are halved until each fits the pages that a query returns.

The client is injected (`fetch(start, stop, page) -> (rows, pages)`), as is its most pages. Planning runs
on the driver and yields one partition per range; executors fetch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[int, int, int], tuple[list[tuple], int]]


@dataclass
class TimeRange(InputPartition):
    start: int
    stop: int


def bisect(start: int, stop: int, pages: Callable[[int, int], int], most: int) -> Iterator[TimeRange]:
    """Ranges, in order, of at most `most` pages each; one second can't be halved."""
    if stop - start <= 1 or pages(start, stop) <= most:
        yield TimeRange(start, stop)
        return
    middle = (start + stop) // 2
    yield from bisect(start, middle, pages, most)
    yield from bisect(middle, stop, pages, most)


def ranged_source(name: str, schema: str, fetch: Fetch, most: int = 1) -> type[DataSource]:
    """A data source class to register: options start and stop in epoch seconds; rows begin with (id, time)."""

    class Reader(DataSourceReader):
        def __init__(self, start: int, stop: int):
            self.start, self.stop = start, stop

        def partitions(self) -> list[InputPartition]:
            return list(bisect(self.start, self.stop, lambda a, b: fetch(a, b, 0)[1], most))

        def read(self, partition: TimeRange) -> Iterator[tuple]:
            seen, page, pages = set(), 0, 1
            while page < pages:
                rows, pages = fetch(partition.start, partition.stop, page)
                for row in rows:
                    if row[0] not in seen and partition.start <= row[1] < partition.stop:  # a search may return neighbours
                        seen.add(row[0])
                        yield row
                page += 1

    class Ranged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002 - named by the interface
            return Reader(int(self.options["start"]), int(self.options["stop"]))

    return Ranged
