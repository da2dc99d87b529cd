"""Rewrites of tables by key: plain files take no MERGE, so each gives the whole new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column] | None = None, reset: dict[str, Column] | None = None) -> DataFrame:
    """target with rows put in their keys' place. order: which of several new rows of a key counts; reset: columns set anew on written rows."""
    new = latest(rows, keys, order) if order else rows
    new = new.withColumns(reset or {})
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_once(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """target with rows whose key it doesn't have."""
    new = latest(rows, keys, order) if order else rows.dropDuplicates(keys)
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_kind(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All of target's rows under rows' keys go, and rows come: several rows of a key stay several."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(target: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def set_column(target: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """target with column taken from values where they have the key."""
    new = values.select(F.col(key), F.col(column).alias("_new"))
    return target.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*target.columns)


def counters(target: DataFrame, bumps: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counters by key with one added for each bump."""
    every = target.select(*keys, count).unionAll(bumps.select(*keys, F.lit(1).cast(target.schema[count].dataType)))
    return every.groupBy(*keys).agg(F.sum(count).alias(count))


def write_partition(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
