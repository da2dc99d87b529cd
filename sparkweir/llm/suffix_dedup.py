"""Suffix-array deduplication by the distributed difference-cover algorithm.

Suffixes are dealt to partitions by content (see repeats): those that can share
a prefix of a window's length meet. In each partition the suffixes at places
that aren't multiples of three are sorted by their triples, with recursion on
the triples' names while these aren't unique and cover less than a window; the
remaining suffixes are sorted by their first byte and the rank of the next,
and merged in; adjacent suffixes are then compared over a window's bytes.
Every window that also starts in a text with a smaller id is covered.

Texts are taken as UTF-8 bytes; matches never cross texts. Null and empty
texts stay empty; texts shorter than a window are unchanged; long ones are
taken in pieces. A cut may leave part of a character, so that kept texts are
bytes. Ids are integers and should be unique: rows that share an id share
their spans and don't cover each other. A null id counts as smaller than
every other. Empty tables give empty results. Only the named columns are
read, so that other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NULL_ID, SPAN, Shape, merged, mixed, repeated_spans, streamed, texts_of, with_texts

#: Bytes of a window and of the grams that anchor windows.
WINDOW, GRAM = 50, 16

_VALUE = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))


def tokenize(text: bytes | None) -> np.ndarray:
    return _VALUE[np.frombuffer(text or b"", np.uint8)]


def _pack(text: bytes, tokens: np.ndarray, first: int, last: int) -> bytes:
    return text[first:last]


def _unpack(data: bytes, at: int, n: int):
    return np.frombuffer(data, np.uint8, n, at), at + n


def _names(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 of rows, equal ones sharing theirs."""
    if all(int(c.max(initial=0)) < 1 << 20 for c in columns):
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = (key << 21) | c
        return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a text of positive integers in order of their first depth tokens or more."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    padded = np.append(text.astype(np.int64), [0, 0, 0])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])  # places 1, then places 2 modulo 3
    names = _names([padded[sample], padded[sample + 1], padded[sample + 2]])
    if depth > 3 and int(names.max()) < len(names):
        order = suffix_order(names, -(-depth // 3))
        # Names whose suffixes agree over the depth needed keep the order found; ranks are then all distinct.
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(1, len(names) + 1)
    else:
        order = np.argsort(names, kind="stable")
        rank = names
    ranks = np.zeros(n + 4, np.int64)
    ranks[sample] = rank
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((ranks[rest + 1], padded[rest]))]
    low = _sampled_before(padded, ranks, rest, sampled)
    # Among suffixes that agree over the depth any order will do, so long as places grow along the rest.
    place = np.maximum.accumulate(low) + np.arange(len(rest))
    out = np.full(n, -1, np.int64)
    out[place] = rest
    out[out < 0] = sampled
    return out


def _sampled_before(text: np.ndarray, ranks: np.ndarray, rest: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """How many of the sampled suffixes come before each of the rest.

    The merge of the two: against places 1 modulo 3 suffixes compare by a token
    and a rank, against places 2 by two tokens and a rank.
    """
    tokens, rank = int(text.max(initial=1)).bit_length(), int(ranks.max(initial=1)).bit_length()
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    if 2 * tokens + rank > 63:  # too wide for one integer each
        return _rows_before([text[one], ranks[one + 1]], [text[rest], ranks[rest + 1]]) + _rows_before([text[two], text[two + 1], ranks[two + 2]], [text[rest], text[rest + 1], ranks[rest + 2]])
    shift, further = np.int64(rank), np.int64(rank + tokens)
    by_one = lambda i: (text[i] << shift) | ranks[i + 1]
    by_two = lambda i: (text[i] << further) | (text[i + 1] << shift) | ranks[i + 2]
    return np.searchsorted(np.sort(by_one(one)), by_one(rest)) + np.searchsorted(np.sort(by_two(two)), by_two(rest))


def _rows_before(columns: list[np.ndarray], queries: list[np.ndarray]) -> np.ndarray:
    """How many rows of the columns are less than each of the queries' rows."""
    n = len(columns[0])
    both = [np.concatenate([q, c]) for c, q in zip(columns, queries)]
    order = np.lexsort([np.append(np.zeros(len(queries[0])), np.ones(n)), *both[::-1]])
    seen = np.cumsum(order >= len(queries[0]))
    out = np.empty(len(queries[0]), np.int64)
    asked = order < len(queries[0])
    out[order[asked]] = seen[asked]
    return out


def equal_windows(parts: list[np.ndarray]) -> np.ndarray:
    """A class for each window of the segments in turn, shared by equal windows only."""
    lengths = np.array([len(x) for x in parts])
    text = np.zeros(int(lengths.sum()) + len(parts), np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    flat = np.arange(len(text))
    ends = begin + lengths
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.concatenate(parts).astype(np.int64) + 2
    text[ends] = 1
    order = suffix_order(text, WINDOW)
    owner = np.repeat(np.arange(len(parts)), lengths + 1)
    start = flat + WINDOW <= ends[owner]
    order = order[start[order]]
    a, b = order[:-1], order[1:]
    # Seven tokens of nine bits to an integer.
    padded = np.append(text, np.zeros(7, np.int64))
    packed = np.zeros(len(text), np.int64)
    for k in range(7):
        packed = (packed << 9) | padded[k : k + len(text)]
    same = np.ones(len(a), bool)
    for k in [*range(0, WINDOW - 6, 7), WINDOW - 7]:
        same &= packed[a + k] == packed[b + k]
    classes = np.zeros(len(text), np.int64)
    classes[order] = np.append(0, np.cumsum(~same))
    return classes[np.flatnonzero(start)]


def _cutter(batches):
    rows = []

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    size = 0
    for spans, id_, text in streamed(batches, SPAN):
        kept, removed, at, n_spans = [], 0, 0, 0
        for _, start, end in merged(spans).tolist():
            start, end = min(start, len(text)), min(end, len(text))
            n_spans += end > start
            kept.append(text[at:start])
            removed += end - start
            at = end
        kept.append(text[at:])
        rows.append((None if id_ == NULL_ID else id_, len(text), removed, n_spans, b"".join(kept)))
        size += len(rows[-1][4]) + 100
        if size > 1 << 22:
            yield out()
            rows, size = [], 0
    yield out()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): kept in bytes."""
    spans, buckets = repeated_spans(df, Shape(WINDOW, GRAM, "earlier"), tokenize, _pack, _unpack, equal_windows, id_col, text_col)
    cut = with_texts(spans, texts_of(df, id_col, text_col), buckets, buckets).mapInArrow(_cutter, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumnRenamed("id", id_col)
