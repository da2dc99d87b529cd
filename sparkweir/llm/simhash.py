"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: each shingle of consecutive words is hashed to 64 bits; a bit of
the fingerprint is 1 if it is set in over half of the hashes. Two texts are
linked if their fingerprints differ in RADIUS bits or fewer.

Search: each of the 64 bits gets a non-zero vector of RADIUS + 1 bits, and
each non-zero vector v of that length makes a table whose mask holds the bits
that aren't orthogonal to v. Any RADIUS bits leave some v orthogonal to all of
their vectors, so a pair within the radius agrees on the whole mask of some
table: no link is lost. Equal fingerprints are one point. Within a bucket a
spanning forest of the links is made, point by point against those not yet
reached, so that a bucket of n points gives at most n - 1 links. Buckets over
BLOCK points are dealt out in blocks, one task for each pair of blocks.

Texts: null, empty and wordless ones have the fingerprint zero, linked like
any other; texts of fewer words than a shingle are one shingle; long ones are
taken whole. Rows come one to one; repeated ids keep their rows, and share
their smallest id as any copies do. Rows without an id get the smallest id of
their component, or null if no row of it has one. Empty tables give empty
results. Only the named columns are read, so that other columns cannot clash.
A bucket of n points over BLOCK makes about n * n / BLOCK rows for its blocks:
twice n at 4,096 points, 49 times n at 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, stored, unused
from .components import connected_components

#: Words of a shingle, bits in which linked fingerprints may differ, points of a bucket that one task compares with each other.
WORDS, RADIUS, BLOCK = 4, 4, 2048
#: Fixed value: seed of the hash.
SEED = 42

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def masks(radius: int = RADIUS) -> list[int]:
    """One mask of 64 bits for each non-zero vector of radius + 1 bits."""
    n = (1 << (radius + 1)) - 1
    of_bit = [i % n + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (of_bit[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    parts = text.translate(_LOWER).split() if text else []
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(parts) - words + 1]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), 65536):
        ranges = zip(starts[i : i + 65536].tolist(), ends[i + words - 1 :][:65536].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in ranges], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprinter(words: int):
    def run(batches):
        for batch in slices(batches, 1):
            found = np.array([fingerprint(text.as_py(), words) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return run


def fingerprint_column(text_col: str = "text", words: int = WORDS) -> Column:
    """The fingerprint's bits as a signed integer."""

    @F.arrow_udf("long")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(np.array([fingerprint(text.as_py(), words) for text in part], np.uint64).view(np.int64))
        give_back()

    return run(F.col(text_col).cast("binary"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, fp): the fingerprint's bits as a signed integer."""
    read = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return read.mapInArrow(_fingerprinter(words), f"id {dict(read.dtypes)['id']}, fp long").withColumnRenamed("id", id_col)


def forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the points within the radius of each other."""
    rest, links = points.copy(), []
    while len(rest) > 1:
        reached = [rest[0]]
        rest = rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(at, x) for x in found]
                reached += list(found)
    return links


def _linker(radius: int):
    def close(keys, fps):
        """keys: group keys in order, one row per point."""
        fps = fps.view(np.uint64)
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        sizes = np.diff(np.append(starts, len(fps)))
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        links = [np.column_stack([fps[near], fps[near + 1]])]
        for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found = forest(fps[i : i + n], radius)
            if found:
                links.append(np.array(found, np.uint64))
        links = np.concatenate(links)
        links.sort(axis=1)
        return np.unique(links, axis=0).view(np.int64)

    def run(batches):
        held_keys, held_fps = np.empty((0, 2), np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in (0, 1)])
            held_keys, held_fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, batch.column(2).to_numpy()])
            if len(held_fps) < 200_000:
                continue
            open_ = np.flatnonzero((held_keys[:-1] != held_keys[-1]).any(axis=1))
            n = open_[-1] + 1 if len(open_) else 0  # the last group may go on in the next batch
            if n:
                links = close(held_keys[:n], held_fps[:n])
                held_keys, held_fps = held_keys[n:], held_fps[n:]
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
        if len(held_fps):
            links = close(held_keys, held_fps)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def links(points: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints, points(fp)."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = points.select("fp", F.inline(tables))
    large = stored(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    pair = lambda j: (F.least("own", j) * 65536 + F.greatest("own", j)).cast("long")
    salted = (
        keyed.join(large, ["t", "key"], "left")
        .select("t", "key", "fp", F.coalesce(blocks, F.lit(1)).alias("blocks"))
        .select("t", "key", "fp", "blocks", own.alias("own"))
        .select("t", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("pair"))
        .select(F.xxhash64("t", "pair").alias("part"), "key", "fp")
    )
    # Bucket keys of different tables or blocks keep apart by part; should two parts ever have one hash, their points are compared too, which makes no false link.
    grouped = salted.repartition("part", "key").sortWithinPartitions("part", "key")
    return grouped.mapInArrow(_linker(radius), "a long, b long")


def components(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id) of (id_col, fp): the smallest id that links lead to."""
    points = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = connected_components(links(points.select("fp"), radius))
    placed = stored(points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def hexadecimal(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id) of every row."""
    return components(stored(fingerprints(df, id_col, text_col, words)), id_col, radius)


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of df from each component: that of the smallest id, where null is larger than any other.

    Among rows of that id the smallest fingerprint decides, and any one of
    rows that share both. Rows are found by id where that is their own; texts
    are fingerprinted again only for ids of several rows.
    """
    marked = stored(fingerprints(df, id_col, text_col, words))
    points = stored(marked.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))).alias("first")))
    roots = connected_components(links(points.select("fp"), radius))
    placed = points.join(roots, F.col("fp") == F.col("node"), "left").select(F.struct("first.none", "first.id", "fp").alias("row"), F.coalesce("root", "fp").alias("root"))
    chosen = stored(placed.groupBy("root").agg(F.min("row").alias("row")).select("row.id", "row.fp"))
    # A row per chosen id: null ids, and those of several rows, are not enough to tell a row by.
    several = stored(marked.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"))
    own = chosen.join(several, chosen["id"].eqNullSafe(several["id"]), "left_anti").select(F.col("id").alias("_own"))
    alone = df.join(own, df[id_col] == own["_own"], "left_semi")
    if several.isEmpty():
        return alone
    key, mark, rank = unused(df, "_key", "_fp", "_rank")
    shared = chosen.join(several, chosen["id"].eqNullSafe(several["id"]), "left_semi").select(F.col("id").alias("_shared"), F.col("fp").alias("_mark"))
    crowd = df.join(shared, df[id_col].eqNullSafe(shared["_shared"]), "left_semi").withColumn(mark, fingerprint_column(text_col, words))
    crowd = crowd.join(shared, crowd[id_col].eqNullSafe(shared["_shared"]) & (crowd[mark] == shared["_mark"]), "left_semi")
    crowd = crowd.withColumn(key, F.struct(id_col, mark)).withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(mark)))
    return alone.unionByName(crowd.where(F.col(rank) == 1).select(*df.columns))
