"""Language identification by language-bitmask n-gram filters.

The filter is a Bloom filter sliced by bits: each slot holds a mask with one
bit per language, and the masks of an n-gram's slots, and-ed, give every
language that contains the n-gram. Over a text the bits are counted per
language; each count is corrected for the false positives that the filling of
the slices makes likely, and the language with the largest count wins.

Learning: the n-grams of a bounded, fixed sample of labelled rows (SAMPLE per
language, by a hash of the id), of which a language keeps those that are at
least a tenth as frequent in it as in any other. They are turned into slots
where they are, so that what comes to the driver is bounded by the filter.

Texts: null, empty ones and those without a letter get `und` and 0, as does
every text where nothing could be learned. A text whose n-grams are all
unknown gets the language of most learning rows and 0. Ties go to the language
with more learning rows, then to the first by name. Rows come one to one,
repeated and null ids included; empty tables give an empty result. Only the
named columns are read, so that other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import received, sample_share, send, slices

#: Bytes of an n-gram.
N = 4
#: About so many labelled rows of a language are learned from.
SAMPLE = 3000
#: Slots of the filter, as a power of two, and probes of an n-gram.
SLOTS, PROBES = 20, 3
#: Bytes that are worked on at a time.
SLICE = 1 << 21

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
#: Odd multipliers of the probes.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _grams(data: np.ndarray) -> np.ndarray:
    """The n-grams of a stretch as integers; letters only, lower-cased, the rest as spaces."""
    b = _FOLD[data].astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


_BLANK = 0x20202020


def _stretches(texts: list[bytes]):
    """Texts, each between two spaces, so many at a time, or a part of a long one: the index of the first, the n-grams, where each text's begin, and which of them lie within one text and aren't blank."""
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (at == first or size + len(texts[at]) <= SLICE):
            size += len(texts[at]) + 3
            at += 1
        if at - first == 1 and size > SLICE:
            whole = b" " + texts[first] + b" "
            for i in range(0, len(whole) - N + 1, SLICE):
                grams = _grams(np.frombuffer(whole[i : i + SLICE + N - 1], np.uint8))
                yield first, grams, np.zeros(1, np.int64), grams != _BLANK
        else:
            lengths = np.array([len(x) for x in texts[first:at]], np.int64)
            grams = _grams(np.frombuffer(b" " + b"   ".join(texts[first:at]) + b"     ", np.uint8))
            starts = np.append(0, np.cumsum(lengths + 3)[:-1])
            inside = grams != _BLANK
            past = (starts + lengths)[:, None] + np.arange(-1, 3)  # n-grams that reach beyond the space after the text
            inside[past[(past >= starts[:, None]) & (past < len(grams))]] = False
            yield first, grams, starts, inside


def _counter(batches):
    for batch in slices(batches, 1):
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            found, seen = [], []
            own = [x for x, y in zip(texts, langs) if y == lang]
            for _, grams, _, inside in _stretches(own):
                grams, n = np.unique(grams[inside], return_counts=True)
                found.append(grams)
                seen.append(n)
            if found:
                grams, place = np.unique(np.concatenate(found), return_inverse=True)
                n = np.bincount(place, np.concatenate(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _probes(grams: np.ndarray, shift: int):
    """The slots of n-grams, probe by probe."""
    grams = grams.astype(np.uint32)
    mixed = grams ^ (grams >> np.uint32(15))
    for m in _MULTIPLIERS[:PROBES]:
        yield (mixed * np.uint32(m)) >> np.uint32(shift)


class Filter:
    """Bit-sliced Bloom filter; languages in order of preference."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        self.languages, self.shift = languages, 32 - slots
        self.masks = np.zeros((-(-len(languages) // 64), 1 << slots), np.uint64)

    def _probes(self, grams: np.ndarray):
        return _probes(grams, self.shift)

    def add(self, language: int, grams: np.ndarray) -> None:
        for at in self._probes(grams):
            self.masks[language >> 6][at] |= np.uint64(1 << (language & 63))

    def seal(self) -> Filter:
        """Sets the rate of false positives of each slice: how full it is, to the power of the probes."""
        full = [((self.masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        self.false = np.minimum(np.array(full) ** PROBES, 0.999)
        return self

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the n-grams that the language contains, and all n-grams that aren't blank."""
        hits, every = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for first, grams, starts, inside in _stretches(texts):
            some = inside.astype(np.int64)
            span = slice(first, first + len(starts))
            every[span] += np.add.reduceat(some, starts)
            probes = list(self._probes(grams))
            for word, masks in enumerate(self.masks):
                found = masks[probes[0]]
                for at in probes[1:]:
                    found &= masks[at]
                found *= some.astype(np.uint64)
                for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    hits[span, i] += np.add.reduceat(((found >> np.uint64(i & 63)) & np.uint64(1)).astype(np.int64), starts)
        return hits, every

    def decide(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hits, every = self.counts(texts)
        true = (hits - every[:, None] * self.false) / (1 - self.false)
        true[true < 0] = 0
        best = true.argmax(axis=1)
        return best, np.clip(true[np.arange(len(texts)), best] / np.maximum(every, 1), 0, 1)


def learn(df: DataFrame, learn_from: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Filter:
    """The filter; learn_from says which rows may be read for it."""
    rows = df.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = sorted(((r["n"], r["lang"]) for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    languages = [lang for _, lang in totals]
    out = Filter(languages)
    if not languages:
        return out.seal()
    share = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(min(1.0, sample / n))) for n, lang in totals])
    read = rows.where(sample_share(id_col, share)).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counts = read.mapInArrow(_counter, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    found = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by")).where(f"gram <> {_BLANK}")
    each = counts.where(f"gram <> {_BLANK}").groupBy("lang").agg(F.sum("n").alias("n")).collect()
    size = {r["lang"]: r["n"] for r in each}
    rates = F.transform("by", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] / F.element_at(F.create_map(*[F.lit(y) for lang in languages for y in (lang, float(size.get(lang, 1)))]), x["lang"])).alias("rate"), x["n"].alias("n")))
    kept = (
        found.select("gram", rates.alias("by"))
        .select("gram", F.filter("by", lambda x: (x["n"] >= 2) & (x["rate"] * 10 >= F.array_max(F.transform("by", lambda y: y["rate"])))).alias("by"))
        .where(F.size("by") > 0)
        .select("gram", F.transform("by", lambda x: x["lang"]).alias("langs"))
    )
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    masks = kept.select("gram", F.explode(F.transform("langs", lambda x: F.element_at(place, x))).alias("language")).groupBy("gram", F.shiftright("language", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, language % 64)")).alias("mask"))
    slots = masks.mapInArrow(_slotter, "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # of each 64 languages no more rows than slots
    word, slot, mask = (slots.column(i).to_numpy() for i in range(3))
    out.masks[word, slot] = mask.view(np.uint64)
    return out.seal()


def _slotter(batches):
    for batch in batches:
        word, grams, mask = batch.column(1), batch.column(0).to_numpy(), batch.column(2)
        for slots in _probes(grams, 32 - SLOTS):
            yield pa.RecordBatch.from_arrays([word, pa.array(slots.astype(np.int32)), mask], ["word", "slot", "mask"])


def _decider(sent):
    def run(batches):
        model = received(sent)
        for batch in slices(batches, 1):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            if model.languages and texts:
                best, score = model.decide(texts)
                names = [model.languages[i] for i in best]
            else:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), batch.column(2)], ["id", "lang_pred", "score", "letters"])

    return run


def identify(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score)."""
    sent = send(df.sparkSession, model)  # 8 MB for each 64 languages
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    read = df.select(F.col(id_col).alias("id"), F.lower(text_col).cast("binary").alias("text"), letters.alias("letters"))
    out = read.mapInArrow(_decider(sent), f"id {dict(read.dtypes)['id']}, lang_pred string, score double, letters boolean")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
