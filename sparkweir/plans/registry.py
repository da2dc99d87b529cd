"""Where queries register: a name, the inventory rows it exercises, the Spark plan and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame. ids: inventory rows, parted by spaces; A01-A03 stands for a range."""

    def register(f):
        REGISTRY[f.__name__] = Query(f.__name__, tuple(expand(ids)), f, sql)
        return f

    return register


def expand(ids: str):
    for part in ids.split():
        first, _, last = part.partition("-")
        for n in range(int(first[1:]), int((last or first)[1:]) + 1):
            yield f"{first[0]}{n:02d}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
