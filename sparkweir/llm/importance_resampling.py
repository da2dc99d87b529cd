"""Importance resampling towards a target distribution, by hashed word runs.

Features of a text are its runs of 1 to n consecutive words, joined by one
space; a feature's bucket is the CRC-32 of its bytes, modulo the number of
buckets. One scan of a text keeps a ring with the running CRC of the runs that
began at the last n words; each word extends all of them by a space and itself,
and begins one more. The buckets are written once, as two bytes each, and serve
both the counts over all texts and the scores.

A bucket's gain is the floor of 1000 times the logarithm of its share in the
target over its share in all documents, each with one more count. A document's
weight is the floored mean of its features' gains; Gumbel noise from its id
makes the highest scores a draw without replacement. Ranks come from one range
partitioning by score, with the partitions' sizes as offsets, so that no task
holds more than its share, and equal scores are dealt by id.

Words are runs of letters, digits and characters beyond ASCII, with A-Z
lower-cased. Texts: null ones and those without words have no features, weight
0 and no rank; long ones are scanned whole. Rows come one to one; rows with
one id share their noise and each takes part. A null id's noise is that of an
empty id, and it comes last among equal scores. Empty tables: no documents give
no rows; an empty target has equal counts. Only the id and the text column are
read, so that other columns cannot clash.

stored() tables stay in the shared folder while the result is read; scratch() deletes them.
"""

from __future__ import annotations

from array import array
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import received, send, slices, small_batches, stored

#: Fixed by the contract: bytes of words, A-Z as a-z, all others as spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Longest runs of words, buckets, fewest words of a document that is drawn, per cent drawn, seed of the noise.
RUNS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def ring_scan(words: list[bytes], n: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to n words: at each word those that end there, the longest first."""
    out = array("I")
    take, ring = out.extend, []
    for word in words:
        ring = [*map(crc32, repeat(b" " + word), ring[-(n - 1) :] if n > 1 else ()), crc32(word)]
        take(ring)
    return np.frombuffer(out, np.uint32)


def _scanner(n: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        for batch in slices(batches, 1):
            counts, packed = [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or b"")
                counts.append(len(words))
                packed.append((ring_scan(words, n) % buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["id", "n_words", "buckets"])

    return run


def bucketed(df: DataFrame, n: int = RUNS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, buckets): the buckets of all features of each text, packed."""
    read = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return read.mapInArrow(_scanner(n, buckets), f"id {dict(read.dtypes)['id']}, n_words long, buckets binary")


def _unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of several texts in a row, and where each text ends."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    raw = [x.as_py() for x in column]
    return np.frombuffer(b"".join(raw), kind), np.cumsum([len(x) // kind.itemsize for x in raw], dtype=np.int64)


def counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts: each task adds up its own first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            total += np.bincount(_unpacked(batch.column(0), buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(features: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; as many numbers as there are buckets come to the driver."""
    spark = features.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(features, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = both.collect()
    total = spark.createDataFrame([(sum(r.s for r in rows), sum(r.t for r in rows))], "s_all long, t_all long").first()
    real = lambda name: F.col(name).cast("double")
    ratio = (real("t") + 1) * (F.lit(float(total.s_all)) + buckets) / ((real("s") + 1) * (F.lit(float(total.t_all)) + buckets))
    gained = spark.createDataFrame(rows, both.schema).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    out = np.zeros(buckets, np.int64)
    for r in gained.collect():
        out[r.bucket] = r.gain
    return out


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight)."""
    sent, buckets = send(features.sparkSession, gain), len(gain)

    def run(batches):
        table = received(sent)
        for batch in slices(batches, 2):
            flat, ends = _unpacked(batch.column(2), buckets)
            sums = np.concatenate([[0], np.cumsum(table[flat])])
            starts = np.concatenate([[0], ends[:-1]])
            n = ends - starts
            weight = np.where(n > 0, (sums[ends] - sums[starts]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return features.select("id", "n_words", "buckets").mapInArrow(run, f"id {dict(features.dtypes)['id']}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, n: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of each row of docs; rank from 1, null where it is not drawn."""
    spark = docs.sparkSession
    features = stored(bucketed(docs, n, buckets, id_col, text_col))
    gain = gains(features, bucketed(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), n, buckets, "id", "text"), buckets)
    scored = stored(weighted(features, gain).withColumn("score", F.col("weight") + noise("id", seed)).withColumn("fit", F.col("n_words") >= least_words))
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()]
    # Rows that agree in score and id are dealt over partitions by the rest, so that a repeated id is no hot key.
    rest = [F.col("weight"), F.col("n_features"), F.rand(seed)]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(scored.repartitionByRange(parts, *order, *rest).sortWithinPartitions(*order, "weight", "n_features").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = {r.part: r.n for r in placed.where("fit").groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    rank = F.get(F.lit(before or [0]).cast("array<long>"), part.cast("int")) + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.col("fit") & (rank <= percent * total // 100)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
