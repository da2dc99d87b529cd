"""Constraints as queries: each gives what breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows for which a rule doesn't hold; null counts as holding, as in a CHECK."""
    counts = df.agg(*[F.count_if(~F.coalesce(condition, F.lit(True))).alias(name) for name, condition in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    return counts.select(F.inline(pairs))


def duplicates(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys held by several of the rows that the condition picks: a partial unique index, checked."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def without_parent(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def missing(declared: list[str], found: list[str]) -> Column:
    """Declared names that weren't found, sorted."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, declared)), F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")))
