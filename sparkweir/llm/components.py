"""Connected components over tables of links, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the same root throughout a component.

    Each round every node goes to its smallest neighbour, or to where that one
    goes, and the links between what is left are carried on; the nodes shrink
    by a factor each round, so that rounds are few. Hubs are no trouble: their
    links meet in partial aggregates and in joins that Spark can split. Null
    ends and links of a node to itself are left out.
    """
    left = stored(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    rounds = []
    while not left.isEmpty():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        first = stored(first)
        further = first.select(F.col("node").alias("_at"), F.col("to").alias("_to"))
        moved = stored(first.join(further, F.col("to") == F.col("_at")).select("node", F.col("_to").alias("to")))
        rounds.append(moved)
        ends = moved.select(F.col("node").alias("_a"), F.col("to").alias("_ta")), moved.select(F.col("node").alias("_b"), F.col("to").alias("_tb"))
        mapped = left.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b"))
        left = stored(mapped.where("_ta <> _tb").select(F.least("_ta", "_tb").alias("a"), F.greatest("_ta", "_tb").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select("node", F.col("to").alias("root"))
    for further in rounds[1:]:
        step = further.select(F.col("node").alias("_at"), F.col("to").alias("_to"))
        out = out.join(step, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_to", "root").alias("root"))
    return out
