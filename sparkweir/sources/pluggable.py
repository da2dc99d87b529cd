"""Sources of one's own: a class that fetches pages becomes a format of spark.read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """A source that gives its rows by pages.

    A subclass names itself in name(), its columns in schema(), and has
    shards(), the parts that tasks read apart, and fetch(shard, cursor), which
    returns rows as tuples and the cursor of the next page, None after the last.
    The first cursor is None. Options are in self.options. A task that is lost
    reads its shard again from the first page.
    """

    def shards(self) -> list[str]:
        return ["all"]

    def fetch(self, shard: str, cursor: str | None) -> tuple[list[tuple], str | None]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self)


class _Pages(DataSourceReader):
    def __init__(self, source: PagedSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(shard) for shard in self.source.shards()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor, seen = None, set()
        while True:
            rows, cursor = self.source.fetch(partition.value, cursor)
            yield from rows
            if cursor is None:
                return
            if cursor in seen:
                raise ValueError(f"the source gives the cursor {cursor} twice")
            seen.add(cursor)


def read(spark: SparkSession, source: type[PagedSource], **options):
    """Registers the source with the session and reads it."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()
