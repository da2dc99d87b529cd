"""A file of JSON lines as a stream that is bound to the file's content.

Offsets carry the digest of the file and a row. A run goes on at the row after
the last one that was committed; each batch holds the file against the digest
that the batch before has seen, on the driver and in the tasks that read it,
and stops if it has changed: the stream never goes on in another file of that
name. Blank lines are skipped. The file may have so many bytes; a larger one is
refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file, rows that a task reads.
MOST, PAGE = 10 << 20, 1000


class Changed(ValueError):
    """The file isn't the one that the stream began with."""


@dataclass
class Page(InputPartition):
    digest: str
    first: int
    last: int


class PinnedFile(DataSource):
    """Options: path, most (bytes), page (rows)."""

    @classmethod
    def name(cls) -> str:
        return "pinned_file"

    def schema(self) -> str:
        return "row long, record string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Pages(self.options["path"], int(self.options.get("most", MOST)), int(self.options.get("page", PAGE)))


class _Pages(DataSourceStreamReader):
    def __init__(self, path: str, most: int, page: int):
        self.path, self.most, self.page = path, most, page

    def _lines(self) -> tuple[str, list[bytes]]:
        system, path = fs.FileSystem.from_uri(self.path)
        size = system.get_file_info(path).size
        if size is None or size > self.most:
            raise ValueError(f"a file of {size} bytes; {self.most} are allowed")
        with system.open_input_stream(path) as file:
            content = file.read()
        return hashlib.sha256(content).hexdigest(), [line for line in content.splitlines() if line.strip()]

    def initialOffset(self) -> dict:
        return {"digest": self._lines()[0], "row": 0}

    def latestOffset(self) -> dict:
        digest, lines = self._lines()
        return {"digest": digest, "row": len(lines)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if start["digest"] != end["digest"]:
            raise Changed(f"{self.path} has changed since row {start['row']}")
        return [Page(end["digest"], at, min(at + self.page, end["row"])) for at in range(start["row"], end["row"], self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        digest, lines = self._lines()
        if digest != partition.digest:
            raise Changed(f"{self.path} has changed at row {partition.first}")
        for row in range(partition.first, partition.last):
            yield row, lines[row].decode("utf-8")


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """(row, record) of the file, from row 0 or from where the checkpoint of the query stands."""
    spark.dataSource.register(PinnedFile)
    return spark.readStream.format(PinnedFile.name()).options(path=path, **options).load()
