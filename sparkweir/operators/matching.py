"""Matches between texts: one within the other, and documents known by address, id or name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the stretches that texts are looked up by.
GRAM = 12
#: Bits that tell which stretches some inner text has, in a power of two: 16 MB, half of them for stretches of GRAM characters, half for shorter ones.
BITS = 1 << 27


def _marks(own: DataFrame) -> tuple[list[int], np.ndarray]:
    """Of stretches (n, h) the sizes n, up to 62, and words of 64 bits in which those of h are set. They come to the driver by 4 kB, never more than BITS has."""
    spot = F.col("h").bitwiseAND(F.lit(BITS - 1))
    parts = own.groupBy(F.shiftright(spot, 15).alias("part")).agg(F.bitmap_construct_agg(spot.bitwiseAND(F.lit(32767))).alias("b"), F.bit_or(F.expr("shiftleft(1L, n)")).alias("n")).toArrow()
    mark = np.zeros(BITS // 64, np.int64)
    for part, b in zip(parts["part"].to_pylist(), parts["b"]):
        mark[part * 512 : part * 512 + 512] = np.frombuffer(b.as_buffer(), "<i8")
    # Few bits need few words: halves are laid over each other while under one bit in 256 is set.
    while len(mark) > 1 and 4 * int(np.bitwise_count(mark).sum()) < len(mark):
        mark = mark[: len(mark) // 2] | mark[len(mark) // 2 :]
    sizes = int(np.bitwise_or.reduce(parts["n"].to_numpy(), initial=0))
    return [n for n in range(63) if sizes >> n & 1], mark


def _marked(mark: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (k, h: array) a row (k, h) for each stretch whose bit is set: for all that some inner text has, and few others."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, stretches = batch.columns
            h = stretches.flatten().to_numpy()
            has = (mark[h >> 6 & len(mark) - 1] >> (h & 63) & 1).astype(bool)
            rows = np.repeat(np.arange(len(k)), np.diff(stretches.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([k.take(pa.array(rows[has])), pa.array(h[has])], ["k", "h"])

    return kept


def within(outer: DataFrame, inner: DataFrame, group: str = "g", text: str = "t", gram: int = GRAM) -> DataFrame:
    """(group, outer, inner): distinct texts of one group where the one holds the other.

    Each inner text is looked up by its rarest stretch of `gram` characters, or
    as a whole if it is shorter: texts that only share what many have, such as
    the beginning or the tail of addresses, make no pairs. An inner text meets
    as many outer ones as have that stretch, and is compared with them. Null
    groups and texts match nothing; an empty text is within every text. For
    texts such as addresses and names, as each gives a row for each stretch; for
    these rows joins sort and merge, as Spark would take them for as few as the
    texts, and send them through the driver. Outer stretches that no inner text
    has are left out before they are shuffled: bits of a fixed number tell most
    of them, and the joins the rest.
    """
    known = lambda df: df.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(group).alias("g"), F.col(text).alias("t")).distinct().withColumn("k", F.unhex(F.md5(F.to_json(F.struct("g", "t")).cast("binary"))))
    outer, inner = known(outer), known(inner)
    size = F.least(F.length("t"), F.lit(gram))

    def stretches(q: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length("t") - q + 1, F.lit(1)))
        # The lowest bit parts the short ones from the others, so that each have bits of their own.
        return F.transform(at, lambda i: F.shiftleft(F.xxhash64("g", q, F.substring(F.col("t"), i, q)), 1) + (q < gram).cast("long"))

    own = inner.select("k", size.alias("n"), F.explode(F.array_distinct(stretches(size))).alias("h"))
    sizes, mark = _marks(own)
    lengths = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda q: q <= F.length("t"))
    held = outer.select("k", F.array_distinct(F.flatten(F.transform(lengths, stretches))).alias("h")).mapInArrow(_marked(mark), "k binary, h bigint")
    count = held.groupBy("h").agg(F.count("*").alias("n"))
    rarest = own.drop("n").join(count.hint("merge"), "h").groupBy("k").agg(F.min(F.struct("n", "h")).alias("least")).select(F.col("k").alias("inner_k"), F.col("least.h").alias("h"))
    met = held.join(rarest.hint("merge"), "h").select("k", "inner_k")
    pairs = met.join(outer.select("k", "g", F.col("t").alias("outer")).hint("merge"), "k").join(inner.select(F.col("k").alias("inner_k"), F.col("g").alias("inner_g"), F.col("t").alias("inner")).hint("merge"), "inner_k")
    return pairs.where((F.col("g") == F.col("inner_g")) & F.contains("outer", "inner")).select(F.col("g").alias(group), "outer", "inner")


def compact(name: Column) -> Column:
    """A name in lower case, without endings such as .pdf, and only its letters and digits, one blank between runs."""
    plain = F.regexp_replace(F.translate(F.lower(name), "ё", "е"), r"\.[a-z0-9]{1,8}(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def _before(text: Column, signs: tuple[str, ...]) -> Column:
    """What stands before each of the signs in a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(F.filter(at, lambda i: F.substring(text, i, F.lit(1)).isin(*signs)), lambda i: F.left(text, i - 1))


def document_matches(stored: DataFrame, wanted: DataFrame, group: str) -> DataFrame:
    """(stored_id, wanted_id, rule): which stored files are which wanted documents, by the first rule that holds.

    stored: (group, stored_id, url, filename, path). wanted: (group, wanted_id,
    id, url, names: array). Rules: 1 equal addresses, of documents that have an
    id; 2 the file's name begins with the id and `_` or `-`; 3 a part of the
    path begins with the id and `_`; 4 of the compact names of both, one holds
    the other. Each rule is an equality of what the rows give, so that no rule
    pairs the rows of a group. Null and empty fields match nothing; addresses,
    ids, names and paths are trimmed. Repeated rows give one pair for each pair of ids.
    """
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    s = stored.select(F.col(group).alias("g"), "stored_id", clean("url").alias("url"), clean("filename").alias("filename"), F.translate(clean("path"), "\\", "/").alias("path"))
    w = wanted.select(F.col(group).alias("g"), "wanted_id", clean(F.col("id").cast("string")).alias("id"), clean("url").alias("url"), "names")
    ids = w.where(F.col("id").isNotNull()).select("g", "wanted_id", "id", "url")
    found = lambda df, rule: df.select("stored_id", "wanted_id", F.lit(rule).alias("rule"))
    by_url = found(s.join(ids.drop("id"), ["g", "url"]), 1)
    begins = s.select("g", "stored_id", F.explode(F.array_distinct(_before(F.col("filename"), ("_", "-")))).alias("id"))
    by_name = found(begins.join(ids, ["g", "id"]), 2)
    parts = F.slice(F.split("path", "/"), F.lit(2), F.greatest(F.size(F.split("path", "/")), F.lit(1)))
    placed = s.select("g", "stored_id", F.explode(F.array_distinct(F.flatten(F.transform(parts, lambda p: _before(p, ("_",)))))).alias("id"))
    by_path = found(placed.join(ids, ["g", "id"]), 3)
    named = lambda df, key, names: df.select("g", key, F.explode(F.filter(F.transform(names, compact), lambda n: n != "")).alias("t")).distinct()
    have = named(s, "stored_id", F.array_compact(F.array("filename", "path")))
    want = named(w, "wanted_id", F.array_compact("names"))
    outer_have = within(have, want, "g", "t").select("g", F.col("outer").alias("h"), F.col("inner").alias("n"))
    outer_want = within(want, have, "g", "t").select("g", F.col("inner").alias("h"), F.col("outer").alias("n"))
    texts = outer_have.unionByName(outer_want).distinct()
    by_text = found(texts.join(have.withColumnRenamed("t", "h"), ["g", "h"]).join(want.withColumnRenamed("t", "n"), ["g", "n"]), 4)
    every = reduce(DataFrame.unionByName, [by_url, by_name, by_path, by_text])
    return every.groupBy("stored_id", "wanted_id").agg(F.min("rule").alias("rule"))
