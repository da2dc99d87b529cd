"""Quality tables and other aggregates of judged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole; null where whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def percent_text(part: Column, whole: Column) -> Column:
    """One decimal with a percent sign, `n/a` where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) <= 0, F.lit("n/a")).otherwise(F.format_string("%.1f%%", 100.0 * part / F.nullif(whole, F.lit(0))))


def quality_table(df: DataFrame, group: Column, positive: Column, negative: Column) -> DataFrame:
    return (
        df.groupBy(group.alias("group_key"))
        .agg(F.count("*").alias("n"), F.count_if(positive).alias("positive"), F.count_if(negative).alias("negative"))
        .withColumn("positive_rate", rate(F.col("positive"), F.col("positive") + F.col("negative")))
    )


def count_in_order(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Counts with a place: declared values first as declared, others after them by name."""
    place = F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(declared)], F.lit(len(declared)))
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("place", place)


def price_band(price: Column, edges: list[float], names: list[str]) -> Column:
    """names has one more than edges; `unknown` where the price is null, not a number or not above 0."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(price < edge, F.lit(name)).otherwise(out)
    return F.when(price.isNull() | F.isnan(price) | (price <= 0), F.lit("unknown")).otherwise(out)


def groups_above(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups of more than `least` rows, each with the number of such groups."""
    from .cascade import with_total

    return with_total(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > least), "n_groups")


def rolled_up(df: DataFrame, group: str, sums: list[str], ids: str) -> DataFrame:
    """Sums, and the number of distinct ids, for each group and for all; ids is an array column and overlaps count once."""
    exploded = df.select(group, F.explode(ids).alias("_id")).distinct()
    numbers = df.groupBy(F.col(group)).agg(*[F.sum(s).alias(s) for s in sums])
    distinct = exploded.groupBy(group).agg(F.count("*").alias("n_ids"))
    whole = df.agg(*[F.sum(s).alias(s) for s in sums]).join(F.broadcast(exploded.agg(F.count_distinct("_id").alias("n_ids"))))  # one row each
    each = numbers.join(distinct, group, "left").withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))
    return each.unionByName(whole.withColumn(group, F.lit(None).cast(df.schema[group].dataType)))
