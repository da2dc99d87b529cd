"""The join that digests are made of: entities, the latest row of each kind of their events, and counts of their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_of_kinds


def base(entities: DataFrame, events: DataFrame, documents: DataFrame, key: str, kinds: dict[str, Column], order: list[str], values: list[str], counts: dict[str, Column], inner: str | None = None) -> DataFrame:
    """entities with a struct per kind, null without such an event, and the counts, 0 without documents.

    events and documents have the key. One aggregate over events gives all
    kinds; inner names a kind without which an entity is left out, before the
    join. Entities without a key have neither events nor documents.
    """
    newest = latest_of_kinds(events, [key], kinds, order, values)
    if inner:
        newest = newest.where(F.col(inner).isNotNull())
    counted = documents.groupBy(key).agg(*[c.alias(name) for name, c in counts.items()])
    joined = entities.join(newest, key, "inner" if inner else "left").join(counted, key, "left")
    return joined.select(*entities.columns, *kinds, *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts])
