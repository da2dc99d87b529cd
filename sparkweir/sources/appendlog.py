"""A log that only grows: a sink of Spark's with commit and abort.

A batch of rows is written by tasks to files of their own, which count once the
batch's commit names them; readers see committed files alone. A task that fails
leaves nothing that is read, and the batch's abort deletes what other tasks
have staged. A batch that is committed already is dropped when it comes again.
Rows without a key are refused, with their whole batch, and so is overwriting.
One batch of a log is committed at a time.

path: a folder of a file system that driver and executors share and that
pyarrow reaches, as a path or an address.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import Refused


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    rows: int


class AppendLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "append_log"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise Refused("a log is only appended to")
        return _Appender(self.options["path"], self.options["batch"], [k for k in self.options.get("keys", "").split(",") if k])


class _Appender(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, keys: list[str]):
        self.path, self.batch, self.keys = path, batch, keys

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, folder = self._open()
        system.create_dir(f"{folder}/rows", recursive=True)
        file, out, rows = f"{folder}/rows/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                for key in self.keys:
                    if batch.column(batch.schema.get_field_index(key)).null_count:
                        raise Refused(f"rows without {key}")
                out = out or pq.ParquetWriter(file, batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out:
                out.close()
                system.delete_file(file)
            raise
        if out:
            out.close()
        return Staged(posixpath.basename(file) if out else None, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        system, folder = self._open()
        name = f"{folder}/commits/{self.batch}.json"
        if system.get_file_info(name).type != fs.FileType.NotFound:
            return self.abort(messages)
        system.create_dir(f"{folder}/commits", recursive=True)
        draft = f"{folder}/{uuid.uuid4().hex}.draft"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": self.batch, "files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}).encode())
        system.move(draft, name)

    def abort(self, messages: list[Staged | None]) -> None:
        system, folder = self._open()
        for m in messages:
            if m and m.file:
                system.delete_file(f"{folder}/rows/{m.file}")


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits, by batch; as many as there are batches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return []
    return [r.asDict() for r in spark.read.schema("batch string, files array<string>, rows long").json(f"{path}/commits").orderBy("batch").collect()]


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The committed rows; none of a log that has no commit yet."""
    found = [f"{path}/rows/{name}" for c in commits(spark, path) for name in c["files"]]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, batch: str, keys: list[str]) -> None:
    """Appends a batch as it is."""
    df.sparkSession.dataSource.register(AppendLog)
    df.write.format(AppendLog.name()).mode("append").options(path=path, batch=batch, keys=",".join(keys)).save()


def append_once(df: DataFrame, path: str, batch: str, keys: list[str]) -> None:
    """Appends the rows whose key the log doesn't have; of rows of a batch with one key any one. Rows without a key are refused."""
    there = read(df.sparkSession, path, df.schema).select(*keys)
    with_key = F.lit(True)
    for k in keys:
        with_key = with_key & F.col(k).isNotNull()
    new = df.where(with_key).dropDuplicates(keys).join(there, keys, "left_anti").select(*df.columns)
    append(new.unionByName(df.where(~with_key)), path, batch, keys)
