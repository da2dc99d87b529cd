"""Substring deduplication by relative Lempel-Ziv parsing.

The reference are all documents, cut into blocks of segments by their anchors
(see repeats). A segment is parsed against its block: from each start the
longest factor that occurs elsewhere in the block is taken; a factor of a
window's length or more becomes a duplicate span, and parsing goes on at the
first start whose window the factor doesn't hold, so that windows over a
boundary of factors are checked as well. Every window that starts in two
places or more is covered, the first of them included.

Words are runs of characters other than space and the controls \\t to \\r,
unchanged, and are told apart by a 64-bit hash. Texts: null and empty ones
have no words and stay empty; texts shorter than a window are unchanged but
for white space; long ones are taken in pieces. Ids are integers and should
be unique: rows that share an id share their spans, and equal rows are copies
of each other. A null id counts as one id of its own. Empty tables give empty
results. Only the named columns are read, so that other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NULL_ID, SPAN, Shape, merged, repeated_spans, streamed, texts_of, with_texts

#: Words of a window and of the grams that anchor windows.
WINDOW, GRAM = 35, 6


def tokenize(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []  # of bytes: at space and \t to \r
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _pack(text: bytes, tokens: np.ndarray, first: int, last: int) -> bytes:
    return tokens[first:last].tobytes()


def _unpack(data: bytes, at: int, n: int):
    return np.frombuffer(data, "<u8", n, at), at + 8 * n


def factor_lengths(names: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """For each token the longest factor from there, of up to so many tokens, that also begins elsewhere.

    An index by doubling: ranks[j] names the stretches of 2**j tokens. Sorted
    by all of them, a stretch's longest match is with one of its neighbours.
    """
    n = len(names)
    ranks, size = [np.unique(names, return_inverse=True)[1].astype(np.int64)], 1
    room = np.append(np.flatnonzero(np.diff(piece)) + 1, n)[piece] - np.arange(n)  # tokens to the end of the piece
    ranks[0] = ranks[0] + 1
    while 2 * size <= longest:
        ahead = np.zeros(n, np.int64)
        ahead[:-size] = ranks[-1][size:]
        ahead[room <= size] = 0
        pair = ranks[-1] * (n + 2) + ahead
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1)
        size *= 2
    ahead = np.zeros(n, np.int64)
    ahead[: n - size] = ranks[-1][size:]
    ahead[room <= size] = 0
    order = np.lexsort((ahead, ranks[-1]))
    a, b = order[:-1], order[1:]
    length = np.zeros(n - 1, np.int64)
    limit = np.minimum(room[a], room[b])
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        ok = length + step <= limit
        i, j = np.where(ok, a + length, 0), np.where(ok, b + length, 0)
        length += step * (ok & (ranks[level][i] == ranks[level][j]))
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, length)
    np.maximum.at(out, b, length)
    return out


def equal_windows(parts: list[np.ndarray]) -> np.ndarray:
    """A class for each window of the segments in turn; windows within duplicate spans of the parse share one with their equals, the others have one each."""
    names = np.concatenate(parts)
    lengths = np.array([len(x) for x in parts])
    piece = np.repeat(np.arange(len(parts)), lengths)
    factors = factor_lengths(names, piece, WINDOW)
    ends = np.cumsum(lengths)
    spans = []
    for first, end in zip((ends - lengths).tolist(), ends.tolist()):
        at = first
        while at <= end - WINDOW:
            length = int(factors[at])
            if length < WINDOW:
                at += 1
                continue
            spans.append((at, length - WINDOW + 1))
            at += length - WINDOW + 1
    starts = np.concatenate([np.arange(e - n, e - WINDOW + 1) for e, n in zip(ends.tolist(), lengths.tolist())])
    duplicate = np.zeros(len(names) + 1, np.int64)
    for at, n in spans:
        duplicate[at] += 1
        duplicate[at + n] -= 1
    inside = np.cumsum(duplicate)[starts] > 0
    classes = np.arange(len(starts)) + 1
    if inside.any():
        rows = names[starts[inside][:, None] + np.arange(WINDOW)]
        classes[inside] = len(starts) + 1 + np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    return np.unique(classes, return_inverse=True)[1]


def _cutter(batches):
    rows = []

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "n_words", "n_removed", "kept"]
        )

    size = 0
    for spans, id_, text in streamed(batches, SPAN):
        words = text.split()
        kept, removed, at = [], 0, 0
        for _, start, end in merged(spans).tolist():
            start, end = min(start, len(words)), min(end, len(words))
            kept += words[at:start]
            removed += end - start
            at = end
        kept += words[at:]
        rows.append((None if id_ == NULL_ID else id_, len(words), removed, b" ".join(kept)))
        size += len(rows[-1][3]) + 100
        if size > 1 << 22:
            yield out()
            rows, size = [], 0
    yield out()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, text): the kept words joined by one space."""
    spans, buckets = repeated_spans(df, Shape(WINDOW, GRAM, "elsewhere"), tokenize, _pack, _unpack, equal_windows, id_col, text_col)
    cut = with_texts(spans, texts_of(df, id_col, text_col), buckets, buckets).mapInArrow(_cutter, "id long, n_words long, n_removed long, kept binary")
    return cut.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("text"))
