"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors become integers, floor(scale * x). Each partition packs its own into
blocks in vertical layout: one contiguous row per dimension. A stated set of
queries goes to the executors in groups of a bounded size, and meets all blocks
there. Within a block, scores are added up some dimensions at a time, those
with most of the queries' mass first; after each step the mass that is left, by
Cauchy and Schwarz, bounds every score from above, and only (query, candidate)
places that may still reach the query's k-th best stay. While many stay, they
are added up as a matrix; after that, as a compacted list.

The k-th best scores so far come from the first blocks of all tasks, searched
in a wave of their own, and rise as a task goes on. They are scores of real
candidates, so that nothing of the result is lost. Each task gives k rows for
a query at most; ranks are made from these.

Candidates of a query are all rows but its own, told by its place and not by
its id, whose vector is as long as the query's. Vectors that are null, or hold
null or non-finite components, take no part; empty ones score 0 with each
other. Ties go to the smaller id, null ids last. Rows with one id each count,
as queries too. An empty table gives an empty result. Only the id and the
vector column are read, so that other columns cannot clash. Components whose
sums would leave the integers that doubles hold are added up as Python's
integers, and scores beyond the long type saturate.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import received, send, stored

#: Steps of a component, results of a query.
SCALE, K = 256, 5
#: Vectors in a block, queries that meet a block together, dimensions added up at a time, bytes of queries that the executors hold at a time.
BLOCK, TOGETHER, STEP, GROUP_BYTES = 4096, 256, 8, 32_000_000
#: Bytes of a block as doubles, where vectors are so long that fewer of them make a block.
BLOCK_BYTES = 32_000_000
#: One block in so many is searched in the first wave.
FIRST = 8
#: Share of the places up to which those that stay are a list.
SPARSE = 0.02
#: Beyond this, sums of integers as doubles might not be exact.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

PACKED = "block string, n int, ids binary, known binary, asked binary, data binary"
ASKED = "block string, n int, places binary, ids binary, known binary, data binary"
FOUND = "query long, query_id long, score long, vec_id long"


def _small(data: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three types; the first byte tells which."""
    most = np.abs(data).max(initial=0)
    kind = b"h" if most < 1 << 15 else b"i" if most < 1 << 31 else b"d"
    return kind + np.ascontiguousarray(data).astype({b"h": "<i2", b"i": "<i4", b"d": "<f8"}[kind]).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """As doubles, a row for each dimension."""
    kind = np.dtype({104: "<i2", 105: "<i4", 100: "<f8"}[raw[0]])
    return np.frombuffer(raw, kind, offset=1).astype(np.float64).reshape(n, -1 if n else 0)


def _packer(scale: float, size: int):
    """Blocks of vectors of one length, under random names that are stored with them."""

    def run(batches):
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def block(n: int) -> pa.RecordBatch:
            ids, asked, data = (np.concatenate(x) for x in zip(*held.pop(n)))
            del count[n]
            ids = pa.array(ids.tolist(), pa.int64()) if ids.dtype == object else pa.array(ids)
            row = [uuid.uuid4().hex, n, ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_valid()).tobytes(), asked.tobytes(), _small(np.floor(scale * data.T))]
            return pa.RecordBatch.from_pydict(dict(zip(("block", "n", "ids", "known", "asked", "data"), ([x] for x in row))), pa.schema([("block", pa.string()), ("n", pa.int32()), *((x, pa.binary()) for x in ("ids", "known", "asked", "data"))]))

        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(2)
            starts, flat = vectors.offsets.to_numpy()[:-1], vectors.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(vectors.offsets.to_numpy())
            ids = np.array(batch.column(0).to_pylist(), object) if batch.column(0).null_count else batch.column(0).to_numpy()
            asked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                room = max(1, min(size, BLOCK_BYTES // (8 * max(n, 1))))
                for at in range(0, len(rows), room):
                    some = rows[at : at + room]
                    held.setdefault(n, []).append((ids[some], asked[some], flat[starts[some][:, None] + np.arange(n)]))
                    count[n] = count.get(n, 0) + len(some)
                    if count[n] >= room:
                        yield block(n)
        for n in list(held):
            yield block(n)

    return run


def packed(df: DataFrame, asked: Column, id_col: str, vector_col: str, scale: float = SCALE, size: int = BLOCK) -> DataFrame:
    """Blocks of up to twice so many vectors that take part, with those marked that are queries."""
    vector = F.col(vector_col)
    out = lambda x: x.isNull() | F.isnan(x) | (F.abs(F.lit(float(scale)) * x.cast("double")) == float("inf"))
    usable = df.where(vector.isNotNull() & ~F.coalesce(F.exists(vector, out), F.lit(True)))
    rows = usable.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), vector.cast("array<double>").alias("v"))
    return rows.mapInArrow(_packer(scale, size), PACKED)


def _queries(batches):
    """The queries of each block."""
    for batch in batches:
        for r in batch.to_pylist():
            places = np.flatnonzero(np.frombuffer(r["asked"], bool))
            if len(places):
                ids, known = np.frombuffer(r["ids"], np.int64)[places], np.frombuffer(r["known"], bool)[places]
                data = _wide(r["data"], r["n"])[:, places] if r["n"] else np.zeros((0, len(places)))
                row = {"block": r["block"], "n": r["n"], "places": places.astype(np.int32).tobytes(), "ids": ids.tobytes(), "known": known.tobytes(), "data": _small(data)}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.string()), ("n", pa.int32()), *((x, pa.binary()) for x in ("places", "ids", "known", "data"))]))


class Queries:
    """Queries of one length, with the dimensions in the order of their mass."""

    def __init__(self, n: int, rows: list, first: int):
        self.n, self.ids = n, np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        self.known = np.concatenate([np.frombuffer(r["known"], bool) for r in rows])
        self.numbers = first + np.arange(len(self.ids))
        data = np.concatenate([_wide(r["data"], n) if n else np.zeros((0, len(r["known"]))) for r in rows], 1)
        self.order = np.argsort(-(data * data).sum(1), kind="stable")
        self.data = np.ascontiguousarray(data[self.order].T)
        self.left = _left(self.data.T).T
        self.most = np.abs(self.data).max(initial=0)
        self.places, at = {}, 0
        for r in rows:
            places = np.frombuffer(r["places"], np.int32)
            self.places[r["block"]] = (at + np.arange(len(places)), places)
            at += len(places)


def _left(data: np.ndarray) -> np.ndarray:
    """Norm of what is left of each vector from a dimension on: a row for each dimension, and a last one of zeros."""
    return np.sqrt(np.concatenate([np.cumsum((data * data)[::-1], 0)[::-1], np.zeros((1, data.shape[1]))]))


def reaching(q: np.ndarray, q_left: np.ndarray, c: np.ndarray, c_left: np.ndarray, least: np.ndarray, own: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all places whose score is at least the query's least, and among the block's k best, ties included.

    q: queries by dimensions; c: dimensions by candidates. own: the places to leave out.
    """
    n, size = c.shape
    sums = np.zeros((len(q), size))
    sums[own] = -np.inf
    at = 0
    while at < n:
        end = min(at + STEP, n)
        sums += q[:, at:end] @ c[at:end]
        at = end
        if at < n:
            # One more than the bound, which is rounded.
            stay = sums + q_left[:, at, None] * c_left[at] + 1 >= least[:, None]
            if np.count_nonzero(stay) <= SPARSE * stay.size:
                break
    else:
        if size > k:
            least = np.maximum(least, np.partition(sums, size - k, 1)[:, size - k])
        where, what = np.nonzero((sums >= least[:, None]) & (sums > -np.inf))
        return where, what, sums[where, what]
    where, what = np.nonzero(stay)
    score = sums[where, what]
    while at < n:
        end = min(at + STEP, n)
        score = score + np.einsum("ij,ji->i", q[where, at:end], c[at:end, what])
        at = end
        stay = (score + q_left[where, at] * c_left[at, what] + (at < n) >= least[where]) & (score > -np.inf)
        where, what, score = where[stay], what[stay], score[stay]
    return where, what, score


def _large(q: np.ndarray, c: np.ndarray, own: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places, added up as Python's integers."""
    whole = np.vectorize(int, otypes=[object])
    score = whole(q) @ whole(c) if c.size else np.zeros((len(q), c.shape[1]), object)
    keep = np.ones(score.shape, bool)
    keep[own] = False
    where, what = np.nonzero(keep)
    return where, what, np.array([max(-LONG, min(LONG, x)) for x in score[where, what]], np.int64)


class Best:
    """The k best candidates of each query so far: scores descending, then ids, null ids last."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids, known = (np.concatenate(x) for x in zip(self.rows, (query, score.astype(np.int64), ids, known)))
        order = np.lexsort((ids, ~known, -score, query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        keep = order[rank < self.k]
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], np.nextafter(score[order][last].astype(np.float64), -np.inf))
        self.rows = (query[rank < self.k], score[keep], ids[keep], known[keep])


def _searcher(group, k: int):
    def run(batches):
        queries, leasts = received(group)
        best = {n: [Best(leasts[n][a : a + TOGETHER], k) for a in range(0, len(q.ids), TOGETHER)] for n, q in queries.items()}
        for batch in batches:
            for r in batch.to_pylist():
                if (q := queries.get(r["n"])) is None:
                    continue
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                c = np.ascontiguousarray(_wide(r["data"], r["n"])[q.order]) if r["n"] else np.zeros((0, len(ids)))
                c_left = _left(c)
                exact = q.most * np.abs(c).max(initial=0) * max(r["n"], 1) < EXACT
                asked, places = q.places.get(r["block"], (np.zeros(0, int), np.zeros(0, int)))
                for i, held in enumerate(best[r["n"]]):
                    part = slice(i * TOGETHER, (i + 1) * TOGETHER)
                    here = (asked >= part.start) & (asked < part.stop)
                    own = (asked[here] - part.start, places[here])
                    found = reaching(q.data[part], q.left[part], c, c_left, held.least, own, k) if exact else _large(q.data[part], c, own)
                    held.add(found[0], found[2], ids[found[1]], known[found[1]])
        for n, parts in best.items():
            q = queries[n]
            for i, held in enumerate(parts):
                where, score, ids, known = held.rows
                if len(where):
                    where = where + i * TOGETHER
                    columns = [pa.array(q.numbers[where]), pa.array(q.ids[where], mask=~q.known[where]), pa.array(score), pa.array(ids, mask=~known)]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "score", "vec_id"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, asked: Column, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where asked holds.

    Blocks are written once. The queries are dealt into groups of about
    group_bytes; each group is sent to the executors on its own, meets all
    blocks in two waves, and its results are written before the next is sent.
    stored() tables stay in the shared folder while the result is read; scratch() deletes them.
    """
    spark = df.sparkSession
    blocks = stored(packed(df, asked, id_col, vector_col, scale, block))
    queries = stored(blocks.mapInArrow(_queries, ASKED))
    total = queries.agg(F.sum(F.length("data")).alias("size")).first().size or 0
    groups = max(1, -(-total // group_bytes))
    out = []
    early = F.pmod(F.xxhash64("block"), F.lit(FIRST)) == 0
    for g in range(groups):
        rows = queries.where(F.pmod(F.xxhash64("block", F.lit(1)), F.lit(groups)) == g).collect()
        of, first = {}, g << 40
        for n in sorted({r.n for r in rows}):
            of[n] = Queries(n, [r for r in rows if r.n == n], first)
            first += len(of[n].ids)
        least = {n: np.full(len(q.ids), -np.inf) for n, q in of.items()}
        sent = send(spark, (of, least))
        wave = stored(blocks.where(early).mapInArrow(_searcher(sent, k), FOUND))
        sent.content.unpersist()
        for r in _best(wave, k).where(F.col("rank") == k).select("query", "score").collect():
            for q in of.values():
                if q.numbers[0] <= r.query <= q.numbers[-1]:
                    least[q.n][r.query - q.numbers[0]] = np.nextafter(float(r.score), -np.inf)
        sent = send(spark, (of, least))
        rest = stored(blocks.where(~early).mapInArrow(_searcher(sent, k), FOUND))
        sent.content.unpersist()
        out.append(wave.unionByName(rest))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
