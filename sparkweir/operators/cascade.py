"""Ordered rules of which the first that holds decides, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds; null conditions don't."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def all_matches(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def null_or(column: Column, condition: Column) -> Column:
    """Rows without a value pass."""
    return column.isNull() | condition


def shown_or_hidden(df: DataFrame, reason: Column, order: list[Column], limit: int) -> DataFrame:
    """All rows with hidden_reason: the rule that hides them, over_limit, or null for the first `limit` eligible ones.

    The eligible rows are ranked by a top-k that meets in one task with at
    most `limit` rows from each, not by a window over the table.
    """
    marked = df.withColumn("hidden_reason", reason)
    key = df.columns[0]
    top = marked.where(F.col("hidden_reason").isNull()).orderBy(*order).limit(limit).select(F.col(key).alias("_top"))
    joined = marked.join(F.broadcast(top), F.col(key) == F.col("_top"), "left")  # at most `limit` rows
    hidden = F.when(F.col("hidden_reason").isNotNull(), F.col("hidden_reason")).when(F.col("_top").isNull(), F.lit("over_limit"))
    return joined.withColumn("hidden_reason", hidden).drop("_top")


def reason_counts(df: DataFrame, reason: str = "hidden_reason", shown: str = "shown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit(shown)).alias("reason")).agg(F.count("*").alias("n"))


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """Each row with the number of all; the count meets in one task as partial counts, without a window over the table."""
    counted = df.agg(F.count("*").alias(name))
    return df.join(F.broadcast(counted))  # one row


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Row numbers from 1 over a result that has been cut to what one task holds, such as a top-k."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
