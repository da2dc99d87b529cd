"""Near texts within groups: a set-similarity join, and lists without what repeats.

Two texts are near if they agree but for case and blanks, if the one holds the
other and that has 24 characters or more, or if twice the characters of their
matching blocks are 0.86 of the characters of both. Matching blocks are the
longest common run, and those to its left and right, again and again.

A group's texts are compared in one task, those of a large group in blocks, each
two of which are a task's work: a task holds two blocks, whatever the group's
size, and only large groups are sent more than once. Within a task most pairs
are told apart by counts of characters, which bound what matches and what one
text can hold of the other, then by counts of neighbouring characters: if a
ratio r of T characters matches, at most (1-r)T characters don't, which cut the
matches into one block more at most, so that (1.5r-1)T-1 pairs of neighbours are
in both. A longest common subsequence, of which matching blocks are one, bounds
what is left, and only then texts are matched. Work grows with the square of a
group's texts, as all pairs are asked for.

Null texts count as empty; empty ones are near each other only. Null groups are
groups. Texts that agree are matched once, whatever their number.

Joins sort and merge both sides, so that no table goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folds import fold

#: Characters from which a text within another is near it; ratio of matching characters.
CONTAINED, RATIO = 24, 0.86
#: Texts and characters of a block of a large group, one text at least.
TEXTS, CHARACTERS = 512, 1 << 20

BLANKS = r"[\s\x1c-\x1f\x85\xa0  -     　]+"


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANKS, " "))


def matching(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts; of longest runs the first in a, then in b."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    total, parts = 0, [(0, len(x), 0, len(y))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        best, end_i, end_j, run = 0, 0, 0, np.zeros(j1 - j0 + 1, np.int32)
        for i in range(i0, i1):
            run[1:] = np.where(y[j0:j1] == x[i], run[:-1] + 1, 0)
            longest = int(run.max())
            if longest > best:
                best, end_i, end_j = longest, i + 1, j0 + int(run.argmax())
        if best:
            total += best
            parts += [(i0, end_i - best, j0, end_j - best), (end_i, i1, end_j, j1)]
    return total


def alike(a: str | None, b: str | None, contained: int = CONTAINED, ratio: float = RATIO) -> bool:
    """The same for one pair, outside Spark; of two texts the shorter, then the smaller, is matched against the other."""
    x, y = sorted((" ".join((t or "").lower().split()) for t in (a, b)), key=lambda t: (len(t), t))
    return x == y or len(x) >= contained and x in y or bool(x) and 2 * len(x) >= ratio * (len(x) + len(y)) and 2 * matching(x, y) >= ratio * (len(x) + len(y))


def _merged(df: DataFrame) -> DataFrame:
    """df, to be joined without being sent to the driver."""
    return df.hint("merge")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _common(masks: dict[str, int], n: int, other: str) -> int:
    """Characters of the longest common subsequence of a text of n characters, given by its places of each character as bits, and another."""
    every = left = (1 << n) - 1
    for c in other:
        both = left & masks.get(c, 0)
        left = (left + both | left - both) & every
    return n - left.bit_count()


def near_pairs(texts: list[str], blocks: list[int], contained: int = CONTAINED, ratio: float = RATIO) -> Iterator[tuple[int, int]]:
    """Places of near texts among different plain ones that aren't empty; of two blocks, pairs of one text of each only."""
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i]))
    length, block = np.array([len(texts[i]) for i in order]), np.array([blocks[i] for i in order])
    two = len(set(blocks)) > 1
    codes = [_codes(texts[i]) for i in order]
    # Counts of characters, and of pairs of neighbours, some of which fall together: what texts share of these is no less.
    ones = np.array([np.bincount(x & 63, minlength=64) for x in codes], np.int32)
    pairs = np.array([np.bincount(x[:-1] * np.uint32(37) + x[1:] & 255, minlength=256) for x in codes], np.int32)
    for last in range(1, len(order)):
        b, both = texts[order[last]], length[:last] + length[last]
        shared = np.minimum(ones[:last], ones[last]).sum(1)
        held = (shared == length[:last]) & (length[:last] >= contained)
        may = np.flatnonzero((held | (2 * shared >= ratio * both)) & ((block[:last] != block[last]) | (not two)))
        if not len(may):
            continue
        needed = both[may] * (1.5 * ratio - 1) - 1
        alike = (2 * shared[may] >= ratio * both[may]) & (np.minimum(pairs[may], pairs[last]).sum(1) >= np.ceil(needed - 1e-6))
        masks: dict[str, int] = {}
        for first, holds, matches in zip(may.tolist(), held[may].tolist(), alike.tolist()):
            a = texts[order[first]]
            if holds and a in b:
                yield order[first], order[last]
            elif matches:
                least = math.ceil(ratio * (len(a) + len(b)) / 2 - 1e-6)
                if not masks:
                    for at, c in enumerate(b):
                        masks[c] = masks.get(c, 0) | 1 << at
                if _common(masks, len(b), a) >= least and 2 * matching(a, b) >= ratio * (len(a) + len(b)):
                    yield order[first], order[last]


def near_texts(texts: DataFrame, contained: int = CONTAINED, ratio: float = RATIO) -> DataFrame:
    """(k, p): the p of each text that is near the one of key k. texts: (g, k, p, t), of each group different plain texts that aren't empty."""
    size = texts.groupBy(F.col("g").alias("sg")).agg(F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum(F.length("t")) / CHARACTERS)).cast("int").alias("blocks"))
    placed = texts.join(_merged(size), F.col("g").eqNullSafe(F.col("sg"))).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    dealt = placed.select("g", "k", "p", "t", "block", F.inline(every))

    def step(held: list, row: dict):
        held.append(row)
        return ()

    def end(held: list):
        if held[0]["i"] != held[0]["j"] and len({row["block"] for row in held}) < 2:
            return
        for x, y in near_pairs([row["t"] for row in held], [row["block"] for row in held], contained, ratio):
            yield held[x]["k"], held[y]["p"]
            yield held[y]["k"], held[x]["p"]

    kind = dict(texts.dtypes)["p"]
    return fold(dealt, ["g", "i", "j"], [], StructType.fromDDL(f"k binary, p {kind}"), lambda key: [], step, end)


def without_near(df: DataFrame, group: str, place: str, text: str, contained: int = CONTAINED, ratio: float = RATIO) -> DataFrame:
    """(group, place, kept, near): rows of a group in order of place; a row is kept unless a kept one before it is near. near: the places before it of rows near it."""
    rows = df.select(F.col(group).alias("g"), F.col(place).alias("p"), plain(F.col(text)).alias("t")).withColumn("k", F.unhex(F.md5(F.to_json(F.struct("g", "t")).cast("binary"))))
    # Of rows that agree only the first can be kept, so that it stands for all of them.
    first = rows.groupBy("g", "k").agg(F.min("p").alias("p"), F.any_value("t").alias("t"))
    before = near_texts(first.where("t <> ''"), contained, ratio).groupBy(F.col("k").alias("yk")).agg(F.array_sort(F.collect_set("p")).alias("others"))
    joined = rows.select("g", "p", "k").join(_merged(first.select(F.col("k").alias("fk"), F.col("p").alias("fp"))), F.col("k") == F.col("fk")).join(_merged(before), F.col("k") == F.col("yk"), "left")
    same = F.when(F.col("fp") < F.col("p"), F.array("fp"))
    others = F.filter(F.coalesce("others", F.array().cast(before.schema["others"].dataType)), lambda o: o < F.col("p"))
    ready = joined.select("g", "p", F.array_sort(F.concat(F.coalesce(same, F.array().cast(before.schema["others"].dataType)), others)).alias("near"))

    def step(kept: set, row: dict):
        stays = not any(p in kept for p in row["near"])
        if stays:
            kept.add(row["p"])
        return ((row["g"], row["p"], stays, row["near"]),)

    kinds = dict(ready.dtypes)
    out = fold(ready, ["g"], ["p"], StructType.fromDDL(f"g {kinds['g']}, p {kinds['p']}, kept boolean, near {kinds['near']}"), lambda key: set(), step)
    return out.select(F.col("g").alias(group), F.col("p").alias(place), "kept", "near")
