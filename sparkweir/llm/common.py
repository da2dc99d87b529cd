"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import hashlib
import pickle
import re
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
WORD_BREAK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that df doesn't have, made from these."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what spark.checkpoint.dir names. Where that is unset and all runs in
    one process, as in tests, a temporary folder is made and set; on a cluster
    it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            folder = made.get()
        elif re.match(r"local($|\[)", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The tables that stored() has written within the innermost scratch().
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    The lineage ends there, every executor can read the files, and columns
    that a later step leaves out are not read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A function that deletes the tables written by stored() since the block began, but for the last one; what is left lazy must not read the others."""
    paths: list[str] = []
    token = _written.set(paths)

    def clear() -> None:
        for path in paths[:-1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del paths[:-1]

    try:
        yield clear
    finally:
        _written.reset(token)


#: Things of one kind that a Python worker keeps from task to task.
KEPT = 4


def once_per_process(kind: str, key: str, build):
    """build(), kept for the life of a Python worker, over its tasks: the last KEPT of a kind, until the worker turns to another kind."""
    registry = sys.modules.setdefault("_kept_by_llm_operators", types.ModuleType("_kept_by_llm_operators"))
    held = registry.__dict__.setdefault("held", {})
    for other in [x for x in held if x[0] != kind]:
        del held[other]
    if (kind, key) not in held:
        while len(held) >= KEPT:
            del held[next(iter(held))]
        held[kind, key] = build()
    return held[kind, key]


#: Bytes of rows that Spark sends to a Python worker at a time, where the session allows more.
BATCH_BYTES = 4_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's batches for Python workers are held to BATCH_BYTES, or one row, whatever the rows' number.

    The bound on rows alone, and the 64 MB of Spark's own bound on bytes, would let
    each task hold that much several times over: in the JVM and in its worker.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Memory that was freed in this Python worker goes back to the system, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such function in this C library
        pass


def slices(batches, column: int, size: int = 4_000_000):
    """Record batches of at most so many bytes in a column of texts, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(first, last - first)
            first = last
    give_back()


@dataclass(frozen=True)
class Sent:
    """A broadcast model and the names that workers know it by."""

    kind: str
    key: str
    content: Broadcast


def send(spark: SparkSession, model) -> Sent:
    """A model for the executors, whose workers need not be able to import its class."""
    raw = cloudpickle.dumps(model)
    kind = f"{type(model).__module__}.{type(model).__name__}"
    return Sent(kind, hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw))


def received(sent: Sent):
    raw = sent.content.value
    return once_per_process(sent.kind, sent.key, lambda: pickle.loads(raw))


def id_bucket(id_col: str | Column, modulus: int = 3) -> Column:
    """crc32 of an id as text, modulo: the fold of a row."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string")) % modulus


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(id_bucket(id_col) == 1, F.lit(False))


def sample_share(id_col: str, share: Column) -> Column:
    """True for a share of the ids, the same ones in every run."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1 << 30)) < share * float(1 << 30)
