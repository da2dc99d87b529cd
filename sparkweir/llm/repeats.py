"""Search for repeated windows of tokens over whole tables, for the substring operators.

A window is a fixed number of consecutive tokens of one text. Each has an
anchor: its gram of least hash, the first of these in a tie. Equal windows have
equal anchors at the same place, so that all of a window's occurrences meet
under the hash of its anchor. Successive windows with one anchor are a segment.

1. scan: each text becomes segments. Within a task equal segments are settled
   at once and one of them goes on, so that copies don't pile up under a hash.
   Entries go to partitions by anchor, packed in columns.
2. match: equal segments are settled by hash. Segments that differ under one
   anchor can share windows only if they agree on most of a window around the
   anchor, in one of four places; representatives of those that do are asked for.
3. compare: the tokens asked for are taken from the texts and go to partitions
   by what they agree on; there the operator's own method finds equal windows.
4. The spans found go to the texts, which are cut as they stream by.

Two rules: "earlier" covers windows that also start in a text with a smaller
id, "elsewhere" covers all windows that start in two places or more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_per_process, slices, stored

#: Tokens that are worked on at a time, entries that a task gathers before it settles and sends them.
PIECE, GATHERED = 1 << 20, 1_500_000
#: Tokens that are compared at a time; those of one key always are.
COMPARED = 1 << 15
#: Bytes of texts for each partition, by the size that Spark knows of.
PARTITION_BYTES = 16 << 20
#: From here on Spark's size of a table is a guess.
UNKNOWN = 1 << 50
#: Stands for an id that is null.
NULL_ID = -(1 << 63)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0xA24BAED4963EE407)

#: Hashes of what lies around an anchor, by the side of it that has more; 0 where none of a segment's windows has the anchor in that place.
AROUND = ("right", "more_right", "more_left", "left")

ENTRY = np.dtype([("anchor", "<u8"), ("segment", "<u8"), *[(name, "<u2") for name in AROUND], ("doc", "<i8"), ("start", "<u4"), ("before", "u1"), ("n", "u1"), ("twice", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
REQUEST = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("twice", "u1")])


@dataclass(frozen=True)
class Shape:
    """window and gram in tokens; rule is "earlier" or "elsewhere". Tokens of a text come as unsigned 64-bit integers."""

    window: int
    gram: int
    rule: str

    @property
    def places(self) -> list[tuple[int, int]]:
        """The places that an anchor can have in a window, in as many ranges (first, last) as AROUND has names.

        Equal windows with their anchor in such a range agree on the first
        tokens before it, and on what a window has after it in the last place.
        """
        n, parts = self.window - self.gram + 1, len(AROUND)
        return [(i * n // parts, (i + 1) * n // parts - 1) for i in range(parts)]


def mixed(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(32)
    y ^= x
    y *= _MIX
    y ^= y >> np.uint64(29)
    return y


def _powers(n: int):
    """Powers of an odd number modulo 2**64, and of its inverse."""
    n = 1 << max(21, (n - 1).bit_length())

    def build():
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        out = np.full((2, n), 1, np.uint64)
        out[0, 1:], out[1, 1:] = _ODD, inverse
        with np.errstate(over="ignore"):
            return np.cumprod(out, axis=1, dtype=np.uint64)

    return once_per_process("powers", str(n), build)


def segments(values: np.ndarray, piece: np.ndarray, allowed: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """The segments of tokens that lie one piece after another.

    values: a random integer for each kind of token. piece: the piece of each
    token. allowed: where windows may start. at, n: the first start and the
    number of starts.
    """
    w, k = shape.window, shape.gram
    total = len(values)
    starts = np.flatnonzero((piece[: total - w + 1] == piece[w - 1 :]) & allowed[: total - w + 1]) if total >= w else np.empty(0, np.int64)
    if not len(starts):
        return {}
    power, inverse = _powers(total + 1)

    def sums(x):
        out = np.zeros(total + 1, np.uint64)
        np.multiply(x, power[:total], out=out[1:])
        return np.cumsum(out, out=out)

    prefix = sums(values)

    def hashed(first, last):
        return (prefix[last] - prefix[first]) * inverse[first]

    grams = prefix[k:] - prefix[:-k]
    grams *= inverse[: total - k + 1]
    grams = mixed(grams)
    low = grams & np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(grams), dtype=np.uint64)
    width, have = w - k + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: total - w + 1], low[width - have : width - have + total - w + 1])
    anchors = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, (np.diff(starts) != 1) | (np.diff(anchors) != 0))
    first = np.flatnonzero(new)
    at, n = starts[first], np.diff(np.append(first, len(starts)))
    place = anchors[first]
    before = place - at
    anchor = grams[place]
    own = piece[place]
    # From other integers for the tokens than the anchor's, so that its bits tell segments under one anchor apart.
    other = sums(mixed(values ^ _OTHER))
    whole = mixed((other[at + n - 1 + w] - other[at]) * inverse[at])
    out = {"at": at, "n": n, "before": before, "anchor": anchor, "segment": whole, "piece": own}
    for name, (first, last) in zip(AROUND, shape.places):
        # Some window has its anchor there, so that the tokens around it are within the piece.
        some = np.flatnonzero((before >= first) & (before - n < last)) if first <= last else np.empty(0, np.int64)
        p = place[some]
        out[name] = np.zeros(len(at), np.uint16)
        out[name][some] = np.maximum(mixed(hashed(p - first, p + w - last)) >> np.uint64(48), np.uint64(1))
    return out


def pieces(tokens: list[np.ndarray], window: int):
    """Texts in turn, so many tokens at a time: (values, piece, allowed, text of each piece, the offset of each piece's first token less its place)."""
    parts, allowed, text, shift, size = [], [], [], [], 0

    def out():
        lengths = [len(x) for x in parts]
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), lengths), np.concatenate(allowed), np.array(text), np.array(shift)

    for i, x in enumerate(tokens):
        if len(x) < window:
            continue
        for first in range(0, len(x), PIECE):
            low, high = max(0, first - 2 * window), min(len(x), first + PIECE + 2 * window)
            parts.append(x[low:high])
            ok = np.zeros(high - low, bool)
            ok[first - low : first - low + PIECE] = True
            allowed.append(ok)
            text.append(i)
            shift.append(low - size)
            size += high - low
            if size >= PIECE:
                yield out()
                parts, allowed, text, shift, size = [], [], [], [], 0
    if parts:
        yield out()


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans by text and start, overlapping and touching ones joined."""
    if not len(spans):
        return spans
    doc, start = spans["doc"], spans["start"]
    if not ((doc[1:] > doc[:-1]) | ((doc[1:] == doc[:-1]) & (start[1:] >= start[:-1]))).all():
        spans = spans[np.lexsort((start, doc))]
    doc = np.append(0, np.cumsum(spans["doc"][1:] != spans["doc"][:-1]))
    end = spans["end"].astype(np.int64) + (doc << 33)
    reach = np.maximum.accumulate(end)
    first = np.append(True, (doc[1:] != doc[:-1]) | (spans["start"][1:].astype(np.int64) + (doc[1:] << 33) > reach[:-1]))
    at = np.flatnonzero(first)
    out = spans[at].copy()
    out["end"] = (reach[np.append(at[1:], len(spans)) - 1] - (doc[at] << 33)).astype(np.uint32)
    return out


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of entries with one anchor: whether their segments differ in tokens, by a hash of 64 bits, in the anchor's place or in length."""
    return (a["segment"] != b["segment"]) | (a["before"] != b["before"]) | (a["n"] != b["n"])


def settle(entries: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(entries that go on, in the order in which they come, spans covered by equal segments)."""
    if not len(entries):
        return entries, np.empty(0, SPAN)
    key = mixed(entries["anchor"] + mixed(entries["segment"] + (entries["before"].astype(np.uint64) << np.uint64(8)) + entries["n"]))
    order = np.argsort(key)
    new = np.append(True, np.diff(key[order]) != 0)
    rest = np.flatnonzero(~new)
    a, b = entries[order[rest]], entries[order[rest - 1]]
    if ((a["anchor"] != b["anchor"]) | differ(a, b)).any():  # segments that differ have one key
        order = np.lexsort([entries[name] for name in ("n", "before", "segment", "anchor")])
        a, b = entries[order[1:]], entries[order[:-1]]
        new = np.append(True, (a["anchor"] != b["anchor"]) | differ(a, b))
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(entries)))
    covered = np.zeros(len(entries), bool)
    if shape.rule == "earlier":
        doc = entries["doc"][order]
        covered[order] = doc != np.repeat(np.minimum.reduceat(doc, at), sizes)
        left = entries[~covered]
    else:
        several = np.logical_or.reduceat(entries["twice"][order] > 0, at) | (sizes > 1)
        covered[order] = np.repeat(several, sizes)
        left = entries[order[at]]
        left["twice"] = several
        left = left[np.argsort(order[at])]
    found = entries[covered]
    spans = np.empty(len(found), SPAN)
    spans["doc"], spans["start"], spans["end"] = found["doc"], found["start"], found["start"] + found["n"] - 1 + shape.window
    return left, merged(spans)


def dealt(kind: int, rows: np.ndarray, bucket: np.ndarray, dtype: np.dtype):
    """(kind, bucket, blob) of rows; a blob holds each byte of each column in turn, so that like bytes lie together and compress."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")  # quicker so
    rows, bucket = rows[order], bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for i, j in zip(at, np.append(at[1:], len(rows)) if len(at) else []):
        yield kind, int(bucket[i]), b"".join(np.ascontiguousarray(rows[name][i:j]).view(np.uint8).reshape(j - i, -1).T.tobytes() for name in dtype.names)


def undealt(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        n = len(blob) // dtype.itemsize
        rows, at = np.empty(n, dtype), 0
        for name in dtype.names:
            size = dtype[name].itemsize * n
            rows[name] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, size, at).reshape(dtype[name].itemsize, n).T).view(dtype[name]).reshape(n)
            at += size
        parts.append(rows)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


ROW = "kind int, bucket long, id long, data binary"


def rows_out(rows):
    """Record batches of (kind, bucket, blob)."""
    rows = list(rows)
    for i in range(0, len(rows), 5000):
        part = rows[i : i + 5000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.nulls(len(part), pa.int64()), pa.array([r[2] for r in part], pa.binary())],
            ["kind", "bucket", "id", "data"],
        )


def _scanner(shape: Shape, tokenize, buckets: int):
    def send(gathered):
        left, spans = settle(np.concatenate(gathered), shape)
        yield from rows_out([*dealt(0, left, bucket_of(left["anchor"], buckets), ENTRY), *dealt(1, spans, bucket_of(spans["doc"], buckets), SPAN)])

    def run(batches):
        gathered, size = [], 0
        for batch in slices(batches, 1, PIECE):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tokens = [tokenize(x.as_py()) for x in batch.column(1)]
            for values, piece, allowed, text, shift in pieces(tokens, shape.window):
                found = segments(values, piece, allowed, shape)
                if not found:
                    continue
                entries = np.zeros(len(found["at"]), ENTRY)
                for name in ("anchor", "segment", *AROUND, "before", "n"):
                    entries[name] = found[name]
                entries["doc"] = ids[text[found["piece"]]]
                entries["start"] = found["at"] + shift[found["piece"]]
                gathered.append(entries)
                size += len(entries)
            if size >= GATHERED:
                yield from send(gathered)
                gathered, size = [], 0
        if size:
            yield from send(gathered)

    return run


def requests(entries: np.ndarray, shape: Shape) -> np.ndarray:
    """Which segments' tokens are to be compared, and under which key.

    entries: one or more of each segment. A segment is asked for under its
    anchor and what lies around it in one of the places, if another one agrees
    there, unless all that do agree in a place before.
    """
    out = []
    for i, name in enumerate(AROUND):
        rows = entries[entries[name] > 0]
        if len(rows) < 2:
            continue
        key = mixed(rows["anchor"] + mixed(rows[name].astype(np.uint64) + np.uint64((i + 1) << 32)))
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, np.diff(key) != 0)
        alone = new & np.append(new[1:], True)
        order, key = order[~alone], key[~alone]
        if not len(order):
            continue
        rows = rows[order]
        at = np.flatnonzero(np.append(True, np.diff(key) != 0))
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(rows))))
        wanted = np.logical_or.reduceat(differ(rows, rows[at][group]), at)
        for earlier in AROUND[:i]:
            wanted &= np.logical_or.reduceat((rows[earlier] == 0) | (rows[earlier] != rows[earlier][at][group]), at)
        if shape.rule == "earlier":
            wanted &= np.maximum.reduceat(rows["doc"], at) != np.minimum.reduceat(rows["doc"], at)
        rows, key = rows[wanted[group]], key[wanted[group]]
        asked = np.empty(len(rows), REQUEST)
        asked["key"] = key
        for field in ("doc", "start", "n", "twice"):
            asked[field] = rows[field]
        out.append(asked)
    return np.concatenate(out) if out else np.empty(0, REQUEST)


def _columns(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def by_bucket(batches):
    """(bucket, rows) of consecutive rows (kind, bucket, id, data); a bucket's rows fit in memory."""
    last, held = None, []
    for row in _columns(batches):
        if row[1] != last and held:
            yield last, held
            held = []
        last = row[1]
        held.append(row)
    if held:
        yield last, held


def _matcher(shape: Shape, buckets: int):
    def run(batches):
        for bucket, rows in by_bucket(batches):
            out = [(1, bucket, r[3]) for r in rows if r[0] == 1]
            left, spans = settle(undealt([r[3] for r in rows if r[0] == 0], ENTRY), shape)
            out += dealt(1, spans, bucket_of(spans["doc"], buckets), SPAN)
            asked = requests(left, shape)
            out += dealt(2, asked, bucket_of(asked["doc"], buckets), REQUEST)
            yield from rows_out(out)

    return run


def streamed(batches, dtype):
    """(rows of the bucket's blobs in order of doc, id, text) for each text; a bucket's blobs come before its texts, which stream by."""
    last, held, rows = None, [], np.empty(0, dtype)
    for kind, bucket, id_, data in _columns(slices(batches, 3)):
        if bucket != last:
            last, held, rows = bucket, [], np.empty(0, dtype)
        if kind < 9:
            held.append(data)
            continue
        if held:
            rows = undealt(held, dtype)
            rows = rows[np.argsort(rows["doc"], kind="stable")]
            held = []
        id_ = NULL_ID if id_ is None else id_
        i, j = np.searchsorted(rows["doc"], [id_, id_ + 1])
        yield rows[i:j], id_, data


def _extractor(shape: Shape, tokenize, pack, buckets: int):
    """Tokens asked for, as (key, bucket, request and tokens)."""

    def run(batches):
        held, size = {}, 0
        for asked, _, text in streamed(batches, REQUEST):
            if not len(asked):
                continue
            tokens = tokenize(text)
            for r, bucket in zip(asked, bucket_of(asked["key"], buckets).tolist()):
                end = int(r["start"]) + int(r["n"]) - 1 + shape.window
                if end <= len(tokens):
                    held.setdefault(bucket, []).append(r.tobytes() + pack(text, tokens, int(r["start"]), end))
                    size += end - int(r["start"])
            if size > 1 << 21:
                yield from rows_out((3, k, b"".join(v)) for k, v in held.items())
                held, size = {}, 0
        yield from rows_out((3, k, b"".join(v)) for k, v in held.items())

    return run


def _comparer(shape: Shape, unpack, equal_windows, buckets: int):
    """equal_windows(segments) gives, for the windows of a list of token arrays in turn, a class that equal windows share."""

    def compared(requests, segments):
        """Spans covered of some requests, none of which comes twice, and their tokens."""
        asked = np.array(requests, REQUEST)
        classes = equal_windows(segments)
        n = asked["n"].astype(np.int64)
        owner = np.repeat(np.arange(len(asked)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        doc = asked["doc"][owner]
        if shape.rule == "earlier":
            least = np.full(classes.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, classes, doc)
            covered = doc > least[classes]
        else:
            covered = np.bincount(classes, 1.0 + asked["twice"][owner])[classes] > 1
        spans = np.empty(int(covered.sum()), SPAN)
        spans["doc"] = doc[covered]
        spans["start"] = asked["start"][owner][covered] + offset[covered]
        spans["end"] = spans["start"] + shape.window
        return merged(spans)

    def run(batches):
        for _, rows in by_bucket(batches):
            found, parts = [], []
            for row in rows:
                data, at = row[3], 0
                while at < len(data):
                    r = np.frombuffer(data, REQUEST, 1, at)[0]
                    at += REQUEST.itemsize
                    tokens, at = unpack(data, at, int(r["n"]) - 1 + shape.window)
                    found.append(r)
                    parts.append(tokens)
            spans, some, seen, size = [], [], set(), 0
            order = np.argsort(np.array(found, REQUEST)["key"], kind="stable").tolist()
            for i, following in zip(order, [*order[1:], None]):
                r = found[i]
                if (place := (int(r["doc"]), int(r["start"]))) not in seen:
                    seen.add(place)
                    some.append(i)
                    size += len(parts[i])
                # Equal windows meet under one key, so that keys can be taken a few at a time, which sort quicker.
                if following is None or size >= COMPARED and found[following]["key"] != r["key"]:
                    spans.append(compared([found[j] for j in some], [parts[j] for j in some]))
                    some, seen, size = [], set(), 0
            spans = merged(np.concatenate(spans))
            yield from rows_out(dealt(1, spans, bucket_of(spans["doc"], buckets), SPAN))

    return run


def repeated_spans(df: DataFrame, shape: Shape, tokenize, pack, unpack, equal_windows, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(rows of kind 1: packed spans by bucket of the id, the number of buckets)."""
    spark = df.sparkSession
    size = int(str(df.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < UNKNOWN else 0  # of files; what has been computed has no size, or a far too large one
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // PARTITION_BYTES + 1)
    buckets = parts
    texts = texts_of(df, id_col, text_col)
    scanned = texts.mapInArrow(_scanner(shape, tokenize, buckets), ROW)
    matched = stored(dealt_by_bucket(scanned, parts).mapInArrow(_matcher(shape, buckets), ROW))
    asked = matched.where("kind = 2")
    if asked.isEmpty():
        return matched.where("kind = 1"), buckets
    taken = with_texts(asked, texts, buckets, parts).mapInArrow(_extractor(shape, tokenize, pack, buckets), ROW)
    compared = stored(dealt_by_bucket(taken, parts).mapInArrow(_comparer(shape, unpack, equal_windows, buckets), ROW))
    return matched.where("kind = 1").unionAll(compared), buckets


def dealt_by_bucket(df: DataFrame, parts: int) -> DataFrame:
    """One partition per bucket; in it blobs before texts."""
    return df.repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind")


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))


def _bucketer(buckets: int):
    def run(batches):
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 9, np.int32)), pa.array(bucket_of(ids, buckets)), *batch.columns], ["kind", "bucket", "id", "data"])

    return run


def with_texts(rows: DataFrame, texts: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Blobs and texts by bucket of the id, each bucket's blobs first."""
    every = rows.unionAll(texts.mapInArrow(_bucketer(buckets), ROW))
    return dealt_by_bucket(every, parts)
