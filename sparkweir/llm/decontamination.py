"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds every run of consecutive words of the benchmark items.
The words of a training text are streamed through it; at each word it knows
the longest run that ends there and occurs in an item. Where that reaches the
window, the window's words are hit, and the automaton's state tells in which
items the window occurs. An item of fewer words than a window is a window of
its own, found through the chain of suffix links.

A word is a run of letters, digits and characters beyond ASCII, with A-Z
lower-cased. Texts: null and empty ones have no words and are clean; long
ones are streamed whole. Items: null ones and those without words are
skipped; repeated items share their windows and each counts; one without an id
has windows like others, whose words are hit, but no name to be listed by. Rows come one to
one, repeated ids included; empty tables give an empty result, or clean rows.
Only the named columns are read, so that other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, give_back, once_per_process, slices, small_batches, stored, unused

#: Fixed by the contract: what may stand between words.
BETWEEN = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of items in one automaton; further items go to further automata.
BLOCK_WORDS = 150_000
#: Automata that a worker holds at a time; the texts are read once for so many.
AT_ONCE = 4


def words_of(text: bytes | None) -> list[bytes]:
    """Every byte of a character beyond ASCII is above 0x7F, so that bytes serve as characters."""
    return [w for w in _split(text.translate(LOWER)) if w] if text else []


_split = re.compile(BETWEEN).split


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window.

    steps: for each state, the next state by word. length, link: as usual.
    whole: for each state, the nearest state on its chain of suffix links,
    itself included, that is a short item as a whole, or -1.
    windows: items by the state of a window of full length; shorts: items by the state of a short item.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.steps: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.windows: dict[int, set] = {}
        self.shorts: dict[int, set] = {}
        for item, words in items:
            if not words:
                continue
            state, size = 0, 0
            for word in words:
                state, size = self.steps[state][word], size + 1
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if size >= window:
                    self.windows.setdefault(state, set()).add(item)
            if size < window:
                self.shorts.setdefault(state, set()).add(item)
        # A short item is its state's longest run: whatever ends where it ends in every item begins no earlier, as the item itself begins there.
        self.whole = [-1] * len(self.steps)
        for state in sorted(range(1, len(self.steps)), key=self.length.__getitem__):
            self.whole[state] = state if state in self.shorts else self.whole[self.link[state]] if self.link[state] > 0 else -1

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, raw: bytes) -> Automaton:
        self = cls.__new__(cls)
        vars(self).update(pickle.loads(raw))
        return self

    def _extend(self, last: int, word: bytes) -> int:
        steps, length, link = self.steps, self.length, self.link
        if word in steps[last]:
            old = steps[last][word]
            if length[old] == length[last] + 1:
                return old
            return self._split_off(last, word, old)
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p >= 0:
            old = steps[p][word]
            link[new] = old if length[old] == length[p] + 1 else self._split_off(p, word, old)
        return new

    def _split_off(self, p: int, word: bytes, old: int) -> int:
        copy = len(self.steps)
        self.steps.append(dict(self.steps[old]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[old])
        self.link[old] = copy
        while p >= 0 and self.steps[p].get(word) == old:
            self.steps[p][word] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Hit runs of words [first, end), ascending and apart, and the items found."""
        steps, length, link, whole, window = self.steps, self.length, self.link, self.whole, self.window
        root, spans, items = steps[0], [], set()
        state = size = 0
        for at, word in enumerate(words):
            if not state:
                state = root.get(word, 0)
                if not state:
                    continue
                size = 1
            else:
                while state and word not in steps[state]:
                    state = link[state]
                    size = length[state]
                state = steps[state].get(word, 0)
                if not state:
                    size = 0
                    continue
                size += 1
            reach = 0
            if size >= window:
                found = state
                while length[link[found]] >= window:
                    found = link[found]
                items |= self.windows[found]
                reach = window
            short = whole[state]
            if short >= 0 and length[short] > size:
                short = whole[link[short]]
            while short >= 0:
                items |= self.shorts[short]
                reach = max(reach, length[short])
                short = whole[link[short]] if link[short] > 0 else -1
            if reach:
                first = at + 1 - reach
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first:
                    spans[-1][1] = at + 1
                else:
                    spans.append([first, at + 1])
        return spans, items


SCANNED = "n_words long, spans array<struct<first:int,end:int>>, items array<string>"


def joined(spans: list) -> list[list[int]]:
    """Runs of words of several scans, ascending and apart."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _scanner(group: list[Sent]):
    def run(batches):
        automata = [_received(sent) for sent in group]
        for batch in slices(batches, 1):
            counts, spans, items = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                runs, found = automata[0].scan(words)
                for automaton in automata[1:]:
                    more, others = automaton.scan(words)
                    runs, found = joined(runs + more) if more else runs, found | others
                counts.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in runs])
                items.append(sorted(found - {None}))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                ["id", "n_words", "spans", "items"],
            )

    return run


def _builder(window: int):
    """Automata of blocks of items, which come one after another; a block that has grown too large is parted, and an item longer than a block has one of its own."""

    def run(batches):
        block, size, at = [], 0, None
        for batch in batches:
            for name, text, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = words_of(text.as_py())
                at, before = number, at
                if block and (number != before or size + len(words) > BLOCK_WORDS):
                    yield pa.RecordBatch.from_arrays([pa.array([Automaton(block, window).packed()], pa.binary())], ["automaton"])
                    block, size = [], 0
                if words:
                    block.append((name, words))
                    size += len(words)
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([Automaton(block, window).packed()], pa.binary())], ["automaton"])

    return run


def _received(sent: Sent) -> Automaton:
    return once_per_process(sent.kind, sent.key, lambda: Automaton.unpacked(sent.content.value))


def _automata(spark: SparkSession, benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> list[list[Sent]]:
    """Automata in groups of AT_ONCE, each built in a task from items of BLOCK_WORDS or so; the driver only passes them on, one at a time."""
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    total = items.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("n")).first().n or 0
    # Blocks are numbered, so that there are no more of them than the words need, however many partitions they are dealt to.
    number = F.pmod(F.xxhash64("text", "item"), F.lit(max(1, -(-total // BLOCK_WORDS))))
    dealt = items.withColumn("block", number).repartition("block").sortWithinPartitions("block")
    sent = []
    for row in stored(dealt.mapInArrow(_builder(window), "automaton binary")).toLocalIterator():
        raw = bytes(row.automaton)
        sent.append(Sent("automaton", hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)))
    if not sent:
        raw = Automaton([], window).packed()
        sent = [Sent("automaton", hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw))]
    return [sent[i : i + AT_ONCE] for i in range(0, len(sent), AT_ONCE)]


def _merger(batches):
    """Findings of several groups for one text as one."""
    for batch in batches:
        spans = [[{"first": a, "end": b} for a, b in joined([(s["first"], s["end"]) for part in parts for s in part])] for parts in batch.column(2).to_pylist()]
        items = [sorted({item for part in parts for item in part}) for parts in batch.column(3).to_pylist()]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])


def scan(df: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, spans, items): the runs of hit words, and the items, as sorted strings, whose windows occur.

    The items are cut into automata of a bounded size, built by tasks, each of
    which is sent to the executors. The documents are scanned once for each
    AT_ONCE of them, which bounds what a worker holds, and the findings are
    merged. stored() tables stay in the shared folder while the result is read.
    """
    groups = _automata(df.sparkSession, benchmark, window, item_col, item_text_col)
    if len(groups) == 1:
        read = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
        return read.mapInArrow(_scanner(groups[0]), f"id {dict(read.dtypes)['id']}, {SCANNED}").withColumnRenamed("id", id_col)
    # Rows may repeat, so that each is known by its place, too, and not by its id alone; places are written once, as another run may give others.
    read = stored(df.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("id"), F.col(text_col).cast("binary").alias("text")))
    kind = f"id {read.select('id').schema[0].dataType.simpleString()}"
    every = reduce(DataFrame.unionByName, [read.mapInArrow(_scanner(group), f"{kind}, {SCANNED}") for group in groups])
    gathered = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return gathered.mapInArrow(_merger, f"{kind}, {SCANNED}").select(F.col("id.id").alias(id_col), "n_words", "spans", "items")


def marks(df: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Column:
    """struct(n_words, n_hit) as a column: only the text goes to the Python workers, once for each AT_ONCE automata."""

    def runs_of(group: list[Sent]) -> Column:
        @F.arrow_udf("struct<n_words:long,spans:array<struct<first:int,end:int>>>")
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automata = [_received(sent) for sent in group]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            for part in texts:
                counts, spans = [], []
                for text in part:
                    words = words_of(text.as_py())  # of one text at a time, as they take many times its bytes
                    counts.append(len(words))
                    spans.append([{"first": a, "end": b} for a, b in joined([s for automaton in automata for s in automaton.scan(words)[0]])])
                yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, kind)], ["n_words", "spans"])
            give_back()

        return run(F.col(text_col).cast("binary"))

    found = F.array(*[runs_of(group) for group in _automata(small_batches(df).sparkSession, benchmark, window, item_col, item_text_col)])
    # Hit words of runs in order, each counted from where the ones before it ended.
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))
    add = lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], s["reach"]))).alias("hit"), F.greatest(s["reach"], x["end"]).alias("reach"))
    return F.transform(F.array(found), lambda f: F.struct(f[0]["n_words"].alias("n_words"), F.aggregate(F.array_sort(F.flatten(F.transform(f, lambda g: g["spans"]))), start, add)["hit"].alias("n_hit")))[0]


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])


def contaminated(hit: Column, words: Column, one_in: int = 20) -> Column:
    """At least one word hit, and at least one in so many."""
    return (hit > 0) & (one_in * hit >= words)


def _cutter(batches):
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for batch in slices(batches, 1):
        texts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if not spans:
                texts.append(text)
                continue
            places = [m.span() for m in find.finditer(text.translate(LOWER))]
            kept, at = [], 0
            for s in spans:
                kept.append(text[at : places[s["first"]][0]])
                at = places[s["end"] - 1][1]
            texts.append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "text"])


def remove(df: DataFrame, benchmark: DataFrame, one_in: int = 20, window: int = 13, text_col: str = "text") -> DataFrame:
    """df with the hit spans of contaminated texts cut out; all columns, all rows, other texts unchanged. Null and repeated ids are as good as others: rows are not told apart by ids."""
    columns = df.columns
    row, whole = unused(df, "_row", "_whole")
    found = scan(df.select(F.struct(*columns).alias(row), F.col(text_col).alias(whole)), benchmark, window, row, whole)
    hit = contaminated(n_hit(), F.col("n_words"), one_in)
    cut = found.select(F.struct(row, hit.alias("hit")).alias("id"), F.col(f"{row}.{text_col}").cast("binary").alias("text"), F.when(hit, F.col("spans")).otherwise(F.expr("array()").cast("array<struct<first:int,end:int>>")).alias("spans"))
    done = cut.mapInArrow(_cutter, f"id {cut.schema['id'].dataType.simpleString()}, text binary")
    return done.select(*[F.when(F.col("id.hit"), F.col("text").cast("string")).otherwise(F.col(f"id.{row}.{c}")).alias(c) if c == text_col else F.col(f"id.{row}.{c}").alias(c) for c in columns])
