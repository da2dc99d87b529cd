"""Byte-level BPE encoding and decoding.

The ranks of a public vocabulary decide: in each match of the splitting
pattern the adjacent pair of lowest rank is merged, the leftmost first, until
no pair has a rank. Pairs wait in a queue with one bucket per rank; a bitmap
of three levels over the ranks gives the next occupied one by find-first-set,
each bucket is a heap of linked-list positions, and entries whose pair has
changed since are skipped. A pre-token of n bytes takes O(n log n), so that
one of a megabyte is no trouble.

Texts: null counts as empty; an empty text has no ids. Bytes that are not
UTF-8 are replaced by U+FFFD before encoding. Rows come one to one, repeated
ids included; an empty table gives an empty result. Only the id and the text
column are read, so that other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once_per_process, slices, small_batches

#: Pre-tokens that a worker remembers before it keeps only those in use.
REMEMBERED = 200_000
#: A pre-token of more bytes goes through a queue of its own and is not remembered.
LONG = 128
#: Bytes of text that are encoded together.
TOGETHER = 1_500_000


class RankQueue:
    """Positions by merge rank; pop() gives the lowest rank, then the lowest position."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int]:
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = (group << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        rank = (word << 6) | ((bits & -bits).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[group] &= ~(1 << (word & 63))
                if not self.mid[group]:
                    self.top &= ~(1 << group)
        return rank, position


class Splitter:
    """Matches of the common splitting pattern, from the classes of the characters.

    The pattern's alternatives are runs of letters, of digits and of other
    marks, each with a space before it if there is one, the contractions, and
    white space, of which the last character goes with what follows. So the
    cuts are where the class changes, with few exceptions.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    MARK, LETTER, DIGIT, SPACE = range(4)
    ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, runs: bytes | None = None):
        lengths, kinds = np.frombuffer(runs or character_runs(), "<u4").reshape(2, -1)
        self.kind = np.repeat(kinds.astype(np.uint8), lengths)

    def __call__(self, text: str) -> list[str]:
        n = len(text)
        if n == 0:
            return []
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        cut = np.empty(n + 1, bool)
        cut[0] = cut[n] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
        space = kind == self.SPACE
        if n > 1:
            # The last of a run of white space before something else starts a match of its own; a plain space then takes in what follows.
            last = np.flatnonzero(space[:-1] & ~space[1:])
            cut[last] = True
            cut[last[code[last] == 32] + 1] = False
        quotes = np.flatnonzero(code == 39)
        for i in quotes.tolist():
            if cut[i] and i + 1 < n and kind[i + 1] == self.LETTER:
                for ending in self.ENDINGS:
                    if text.startswith(ending, i + 1):
                        cut[i + 1] = False
                        cut[i + 1 + len(ending)] = True
                        break
        at = np.flatnonzero(cut).tolist()
        return [text[i:j] for i, j in zip(at, at[1:])]


@cache
def character_runs() -> bytes:
    """The classes of all code points, as lengths of runs and their classes.

    Unicode's versions differ in what is a letter, so that the classes are
    asked of the library whose ids are wanted: with the bytes as its only
    tokens it gives back the characters that match. Asked once, by the driver.
    """
    import tiktoken

    kind = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for value, one in ((Splitter.LETTER, r"\p{L}"), (Splitter.DIGIT, r"\p{N}"), (Splitter.SPACE, r"\s")):
        matching = tiktoken.Encoding("characters", pat_str=one, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(matching.encode_ordinary(every)).decode()
        kind[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    return np.array([np.diff(np.append(first, len(kind))), kind[first]], "<u4").tobytes()


def ranks_of(content: bytes) -> dict[bytes, int]:
    """The ranks by token of a tiktoken file's content."""
    rows = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in rows}


class Tokens:
    """The tokens by id, and the decoder."""

    def __init__(self, content: bytes):
        ranks = ranks_of(content)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Vocabulary(Tokens):
    """The encoder."""

    def __init__(self, content: bytes, pattern: str, runs: bytes | None = None):
        super().__init__(content)
        self.ranks = ranks_of(content)
        if pattern == Splitter.PATTERN:
            self.split = Splitter(runs)
        else:
            import regex

            self.split = regex.compile(pattern).findall
        self.queue = RankQueue(len(self.tokens))
        self.known: dict[str, bytes] = {}
        self.byte_id = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = {
            (self.ranks[token[:i]] << 32) | self.ranks[token[i:]]: rank
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        }
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([pairs.get(key, -1) for key in self.pair_keys.tolist()], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, however long."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n, queue, find = len(piece), self.queue, ranks.get
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = [-1] * n  # of the pair that begins at a position
        for i in range(n - 1):
            rank = find(piece[i : i + 2])
            if rank is not None:
                rank_of[i] = rank
                queue.push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            if rank_of[i] != rank:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j] = b""
            rank_of[j] = -1
            after[i] = k = after[j]
            new = -1
            if k < n:
                before[k] = i
                new = find(parts[i] + parts[k], -1)
            rank_of[i] = new
            if new >= 0:
                queue.push(new, i)
            p = before[i]
            if p >= 0:
                new = find(parts[p] + parts[i], -1)
                if new != rank_of[p]:
                    rank_of[p] = new
                    if new >= 0:
                        queue.push(new, p)
        return [ranks[part] for part in parts if part]

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens, all in one queue.

        A bucket holds the positions of a rank in all of them. Of each
        pre-token the leftmost is merged; the others go back to the bucket, as
        the merge may have made a pair of lower rank.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        ids = np.append(ids, -1)
        piece = np.append(np.repeat(np.arange(len(pieces)), lengths), -1)
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n)
        before[0] = n  # position n belongs to no piece
        rank_of = np.full(n + 1, -1, np.int64)
        inside = np.flatnonzero(piece[:-1] == piece[1:])
        rank_of[inside] = self._pair_rank(ids[inside], ids[inside + 1])
        queue, buckets = RankQueue(len(self.tokens)), {}

        def push(ranks, positions):
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else ranks
            ends = np.append(starts[1:], len(ranks)).tolist() if len(ranks) else []
            for rank, i, j in zip(ranks[starts].tolist(), starts.tolist(), ends):
                if rank in buckets:
                    buckets[rank].append(positions[i:j])
                else:
                    buckets[rank] = [positions[i:j]]
                    queue.push(rank, 0)

        there = np.flatnonzero(rank_of >= 0)
        push(rank_of[there], there)
        while queue.top:
            rank, _ = queue.pop()
            held = buckets.pop(rank)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            at = at[rank_of[at] == rank]
            if not len(at):
                continue
            owner = piece[at]
            first = np.append(True, owner[1:] != owner[:-1])
            if not first.all():
                buckets[rank] = [at[~first]]
                queue.push(rank, 0)
                at = at[first]
            gone = after[at]
            ids[at] = rank
            ids[gone] = -1
            rank_of[gone] = -1
            behind = after[gone]
            after[at] = behind
            joined = piece[behind] == piece[at]
            before[behind[joined]] = at[joined]
            ahead = before[at]
            touching = piece[ahead] == piece[at]
            left = np.concatenate((at, ahead[touching]))
            right = np.concatenate((behind, at[touching]))
            new = np.where(piece[left] == piece[right], self._pair_rank(ids[left], ids[right]), -1)
            rank_of[left] = new
            some = new >= 0
            if some.any():
                push(new[some], left[some])
        left = np.flatnonzero(ids[:-1] >= 0)
        packed = ids[left].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(piece[left], minlength=len(pieces))) * 4
        return [packed[i:j] for i, j in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        split = [self.split(text) for text in texts]
        needed = set(chain.from_iterable(split))
        known = self.known
        if len(known) + len(needed) > REMEMBERED:
            self.known = known = {token: known[token] for token in needed & known.keys()}
        short, pieces = [], []
        for token in needed.difference(known):
            piece = token.encode()
            if piece in self.ranks:
                known[token] = self.ranks[piece].to_bytes(4, "little")
            elif len(piece) > LONG:
                known[token] = np.array(self.merge(piece), "<u4").tobytes()
            else:
                short.append(token)
                pieces.append(piece)
        if pieces:
            known.update(zip(short, self.merge_many(pieces)))
        out = [b"".join(map(known.__getitem__, tokens)) for tokens in split]
        for token in needed:
            if len(token) > LONG:
                del known[token]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def _encoder(content, pattern: str, decoded: bool):
    runs = character_runs() if pattern == Splitter.PATTERN else None

    def run(batches):
        raw = content.value
        words = once_per_process("bpe", f"{hashlib.sha256(raw).hexdigest()} {pattern}", lambda: Vocabulary(raw, pattern, runs))
        for batch in slices(batches, 1, TOGETHER):
            ids = words.encode_many([(text or b"").decode("utf-8", "replace") for text in batch.column(1).to_pylist()])
            columns = {"id": batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(map(words.decode, ids), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _decoder(content):
    def run(batches):
        raw = content.value
        words = once_per_process("bpe", hashlib.sha256(raw).hexdigest(), lambda: Tokens(raw))
        for batch in slices(batches, 2, TOGETHER):
            plain = [None if x is None else words.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return run


def _shared(df: DataFrame, path: str):
    """The vocabulary file, read on the driver and sent to the executors; its size does not follow the data."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _encoded(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    content = _shared(df, path)
    read = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = read.mapInArrow(_encoder(content, pattern, decoded), f"id {dict(read.dtypes)['id']}, ids binary" + ", decoded binary" * decoded)
    return out.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", *["decoded"] * decoded)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids): ids as little-endian unsigned 32-bit integers in one binary."""
    return _encoded(df, path, pattern, id_col, text_col, False)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded): what decode(encode(df)) gives, by one worker for each task instead of two."""
    return _encoded(df, path, pattern, id_col, text_col, True)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """What encode() returns, with the decoded bytes; null ids stay null."""
    content = _shared(encoded, path)
    read = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    out = read.mapInArrow(_decoder(content), f"id {dict(read.dtypes)['id']}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digest(binary: str | Column) -> Column:
    """Lowercase hex of the SHA-256."""
    return F.sha2(F.col(binary) if isinstance(binary, str) else binary, 256)
