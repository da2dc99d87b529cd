"""Audit of how filters interact: what each removes in every order of them.

A document's failures are a mask with one bit for each filter. The documents of
a part are counted by mask: all of them, the good and the toxic ones. These
histograms, stacked as rows, are multiplied by integer incidence matrices with
a row for each mask and a column for each step of each order (32 by 600 for
five filters), one matrix for each outcome: kept, removed, redundant (fails, but
is gone already), and unique (fails nothing else). So the texts are read once,
whatever the number of orders, and only histograms are multiplied.

A copy is a text with the same bytes as one of a smaller id anywhere in the
table. Copies are counted by (text's digest, part, mask, labels) in each task
before they are shuffled, so that a large group of copies is no hot key.

Texts: null counts as empty; long ones are read whole. Null ids are neither
smaller nor larger than others: such a row is no copy and makes none. Rows with
one id are no copies of each other. A document is good or toxic if any of its
labels says so; null labels say nothing. A null part is the part ''. An empty
table has no parts, and gives no rows. Only the named columns are read, so that
others cannot clash.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK

#: Fixed by the contract: the signs that filter D looks for.
SIGNS = r"[#$%&*|]"
FILTERS = "ABCDE"


def failures(text: Column, words: Column) -> list[Column]:
    """The conditions of failure of A to D."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text).cast("long"), text.rlike(SIGNS)]


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, mask): the failures within each text as bits, the digest to find copies by."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = read.withColumn("words", F.array_remove(F.split("text", f"{WORD_BREAK}+"), ""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text"), F.col("words")))]
    return split.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).cast("int").alias("mask"))


def histograms(marked: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, n_good, n_toxic), with the bit of copies after those of masks()."""
    known = labels.where(F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("id")).agg(F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    flag = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    each = marked.join(known, "id", "left").select("id", "part", "digest", "mask", flag("good"), flag("toxic"))
    keys = ["digest", "part", "mask", "good", "toxic"]
    by_id = each.groupBy("id", *keys).agg(F.count("*").alias("n"))
    # Of each kind of row of one text: how many, and how many have its smallest id or none.
    kinds = by_id.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    first = F.min("least.id").over(Window.partitionBy("digest"))
    own = kinds.withColumn("firsts", F.col("without") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    copy = 1 << (len(FILTERS) - 1)
    two = F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    dealt = own.select("part", "good", "toxic", F.explode(two).alias("x"))
    return dealt.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("n_good"), F.sum(F.col("x.n") * F.col("toxic")).alias("n_toxic"))


def incidence(filters: str = FILTERS) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders, and for each outcome a matrix of a row by mask and a column by (order, step)."""
    orders = ["".join(p) for p in permutations(filters)]
    bit = np.array([[1 << filters.index(f) for f in order] for order in orders], np.int64)
    through = np.cumsum(bit, 1)  # the filters up to a step, itself included
    mask = np.arange(1 << len(filters), dtype=np.int64)[:, None]
    own, until = bit.reshape(1, -1), through.reshape(1, -1)
    fails, gone = (mask & own) > 0, (mask & (until - own)) > 0
    outcomes = {"kept": (mask & until) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    return orders, {name: m.astype(np.int64) for name, m in outcomes.items()}


OUTCOMES = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcomes(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step. A part has one row per mask at most, so that its counts fit in one row."""

    def run(batches):
        orders, matrices = incidence(filters)
        steps = len(filters)
        of = np.array([[filters.index(f) for f in order] for order in orders]).ravel()
        names = np.repeat(np.array(orders, object), steps)
        numbers = np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stack = np.zeros((3, 1 << steps), np.int64)
                for r in rows:
                    stack[:, r["mask"]] = r["n"], r["n_good"], r["n_toxic"]
                removed = stack @ matrices["removed"]
                shapley = np.array([removed[0][of == f].sum() for f in range(steps)])[of]
                kept, redundant, unique = (stack[0] @ matrices[name] for name in ("kept", "redundant", "unique_fails"))
                columns = [pa.array([part] * len(of), pa.string()), pa.array(names, pa.string()), *map(pa.array, (numbers, kept, removed[0], redundant, unique, removed[1], removed[2], shapley))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUTCOMES.split(", ")])

    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("rows"))
    return rows.mapInArrow(run, OUTCOMES)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """What each of the five filters does at each step of each order, by part."""
    return outcomes(histograms(masks(docs, id_col, text_col, part_col), labels, label_id_col, good, toxic))
