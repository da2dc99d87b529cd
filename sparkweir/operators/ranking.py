"""Orders, top-k, pages and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .folds import fold


def rank_of(column: Column, values: list[str]) -> Column:
    """Place of a value in a list; others come last."""
    return F.coalesce(*[F.when(column == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))


def top(df: DataFrame, order: list[Column], k: int, skip: int = 0) -> DataFrame:
    """A page of an order that a unique column ends; at most skip + k rows of each task meet."""
    sorted_ = df.orderBy(*order)
    return sorted_.limit(skip + k).offset(skip) if skip else sorted_.limit(k)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with next_offset, null after the last."""
    from .cascade import with_total

    counted = df.agg(F.count("*").alias("_total"))
    rows = top(df, order, limit, offset)
    after = F.when(F.col("_total") > offset + limit, F.lit(offset + limit).cast("long"))
    return rows.join(F.broadcast(counted)).withColumn("next_offset", after).drop("_total") if df.columns else with_total(df)


def merged_lists(lists: list[DataFrame], key: str, position: str, budget: int) -> DataFrame:
    """The first `budget` keys of ordered lists one after another, each key where it is first seen."""
    every = None
    for i, part in enumerate(lists):
        rows = part.select(key, F.struct(F.lit(i).alias("list"), F.col(position).cast("long").alias("position")).alias("at"))
        every = rows if every is None else every.unionAll(rows)
    return every.groupBy(key).agg(F.min("at").alias("at")).select(key, "at.list", "at.position").orderBy("list", "position", key).limit(budget)


def text_pages(text: Column, size: int) -> Column:
    """Pages of a text by characters, as (offset, page)."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)))
    return F.transform(starts, lambda at: F.struct(at.alias("offset"), F.substring(text, at + 1, F.lit(size)).alias("page")))


def packed(df: DataFrame, keys: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """df with `bin`: rows of a key in order fill bins of a limited size, one after another; a larger row has a bin of its own."""
    columns = df.columns

    def step(state: list, row: dict):
        if state[1] > 0 and state[1] + row["_size"] > limit:
            state[:] = state[0] + 1, 0
        state[1] += row["_size"]
        return ((*(row[c] for c in columns), state[0]),)

    rest = [c for c in columns if c not in (*order, *keys)]
    return fold(df.withColumn("_size", size.cast("long")), keys, [*order, *rest], StructType([*df.schema.fields, StructField("bin", IntegerType())]), lambda key: [0, 0], step)
