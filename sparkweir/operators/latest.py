"""The latest, first or preferred row of each key.

Orders should end in a unique column, so that ties have one result; null order
values are placed as the caller's columns say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Spark keeps the best rows per task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def join_latest(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], how: str = "left", where: Column | None = None) -> DataFrame:
    """left with the latest row of right by key; where filters right before the latest is taken."""
    rows = right if where is None else right.where(where)
    return left.join(latest(rows, keys, order), keys, how)


def latest_of_kinds(df: DataFrame, keys: list[str], kinds: dict[str, Column], order: list[str], values: list[str]) -> DataFrame:
    """One row per key with a struct per kind: the values of its latest row of that kind, in one aggregate instead of a join for each."""
    by = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(F.struct(*values), F.when(condition, by)).alias(name) for name, condition in kinds.items()])


def first_and_last(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    by = F.struct(*order)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_values"), F.min_by(value, by).alias("first_value"), F.max_by(value, by).alias("last_value"))


def preferred(df: DataFrame, keys: list[str], preference: list[Column], position: str) -> DataFrame:
    """The best row of each key by preference, the earlier in a tie, at the place where the key was first seen."""
    best = Window.partitionBy(*keys).orderBy(*preference, F.col(position).asc())
    seen = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.row_number().over(best)).withColumn("first_position", F.min(position).over(seen))
    return ranked.where("_rank = 1").drop("_rank")


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null so far, within a key."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))
