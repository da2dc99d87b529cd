"""Excerpts of texts around what patterns find, as columns: whole texts, no Python.

A text is split at a pattern's matches; a fold over what is between them keeps
the place it is at and the windows taken so far, of which there are few. So a
text is read once for each pattern, whatever the number of its matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


def _any_of(words: list[str]) -> str:
    """A pattern of literal words, in any case."""
    return "(?iu)" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _steps(text: Column, pattern: str) -> Column:
    """(gap, size) of each match: the characters before it since the match before, and its own; then what is after the last, with no size."""
    step = lambda b, f: F.struct(F.length(b).alias("gap"), F.length(f).alias("size"))
    return F.coalesce(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), step), F.array().cast("array<struct<gap:int,size:int>>"))


def _gaps(text: Column, word: str) -> Column:
    """The characters before each match of a word since the match before; then those after the last."""
    return F.coalesce(F.transform(F.split(text, _any_of([word]), -1), lambda b: F.length(b)), F.array().cast("array<int>"))


def _taken(steps: Column, of: Callable[[Column], tuple[Column, Column]], kept: Column, limit: Column, length: Column, before: int, after: int, apart: Callable[[Column, Column, Column], Column]) -> Column:
    """kept, with the windows of steps that are taken one after another while there are fewer than limit. of: a step's gap and size."""

    def step(s: Column, x: Column) -> Column:
        gap, size = of(x)
        at, end = s["at"] + gap, s["at"] + gap + size
        window = F.struct(F.greatest(F.lit(0), at - before).alias("start"), F.least(length, end + after).alias("end"))
        more = _once(window, lambda w: F.when(apart(s["kept"], w["start"], w["end"]), F.concat(s["kept"], F.array(w))).otherwise(s["kept"]))
        # What is after the last match ends where the text does, so that no match fits there.
        return F.when(F.size(s["kept"]) >= s["limit"], s).otherwise(F.struct(end.alias("at"), F.when(end <= length, more).otherwise(s["kept"]).alias("kept"), s["limit"].alias("limit")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), kept.alias("kept"), limit.alias("limit")), step, lambda s: s["kept"])


def windows(text: Column, pattern: str | list[str], before: int, after: int, most: int) -> Column:
    """(start, end) around matches of a pattern, or of literal words, those that would overlap the one before left out. Null and empty texts have none."""
    after_last = lambda kept, a, b: (F.size(kept) == 0) | (a >= F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)))
    pattern = _any_of(pattern) if isinstance(pattern, list) else pattern
    return _once(F.length(text), lambda n: _taken(_steps(text, pattern), lambda x: (x["gap"], x["size"]), F.array().cast(SPAN), F.lit(most), n, before, after, after_last))


def budgeted(text: Column, groups: list[tuple[list[str], int]], before: int, after: int, most: int, each: int = 2, share: float = 0.55) -> Column:
    """(start, end) around words of groups: up to `each` for a word and so many for a group, in the order of groups and words; then, while fewer than `most` are there, as many as there are for any word.

    A window that has `share` of the shorter one in common with one taken before is left out; share is the fraction that its digits say.
    """
    part, whole = (F.lit(n).cast("long") for n in Fraction(str(share)).as_integer_ratio())

    def apart(kept: Column, a: Column, b: Column) -> Column:
        common = lambda k: F.least(b, k["end"]) - F.greatest(a, k["start"])
        return ~F.exists(kept, lambda k: (common(k) > 0) & (whole * common(k) >= part * F.greatest(F.lit(1), F.least(b - a, k["end"] - k["start"]))))

    words = list(dict.fromkeys(w for some, _ in groups for w in some))
    made = lambda w, own, budget, new: F.struct(F.lit(words.index(w)).alias("word"), F.lit(len(w)).alias("size"), F.lit(min(own, most)).alias("each"), F.lit(min(budget, most)).alias("budget"), F.lit(new).alias("new"))
    rounds = [made(w, each, budget, i == 0) for some, budget in groups for i, w in enumerate(some)] + [made(w, most, most, True) for w in words]

    def fold(x: Column) -> Column:
        def one(s: Column, r: Column) -> Column:
            base = F.when(r["new"], F.size(s["kept"])).otherwise(s["base"])
            limit = F.least(F.lit(most), F.size(s["kept"]) + r["each"], base + r["budget"])
            more = _taken(F.get(x["gaps"], r["word"]), lambda gap: (gap, r["size"]), s["kept"], limit, x["n"], before, after, apart)
            return F.struct(F.when(F.size(s["kept"]) >= limit, s["kept"]).otherwise(more).alias("kept"), base.alias("base"))

        return F.aggregate(F.array(*rounds), F.struct(F.array().cast(SPAN).alias("kept"), F.lit(0).alias("base")), one, lambda s: s["kept"])

    # Each word is looked for once, and its places are gone through in both of its rounds.
    return _once(F.struct(F.array(*[_gaps(text, w) for w in words]).alias("gaps"), F.length(text).alias("n")), fold)


def cut(text: Column, spans: Column) -> Column:
    """The texts of spans."""
    return F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


#: Sections that are held in one array before the next is begun, so that many of them cost no square.
TOGETHER = 64


def sections(text: Column, start: str, stop: str, most: int = 6000) -> Column:
    """(start, end, title) of sections: from a line that start fits, in any case, to the next that stop fits or that is so many characters on. The title is the line, 120 characters at most. Null and empty texts have none."""
    fits = lambda line, pattern: F.regexp_like(line, F.lit(f"(?iU){pattern}"))
    line = lambda x: F.struct(F.length(x).alias("size"), fits(x, start).alias("begins"), fits(x, stop).alias("ends"), F.left(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(120)).alias("title"))
    kind = "array<struct<start:int,end:int,title:string>>"
    none = F.array().cast(kind)
    first = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("at"), F.lit("").alias("title"), none.alias("open"), F.array().cast(f"array<{kind}>").alias("full"))

    def step(s: Column, x: Column) -> Column:
        over = (s["at"] >= 0) & (x["ends"] | (s["pos"] - s["at"] >= most))
        begins = ((s["at"] < 0) | over) & x["begins"]
        shut = F.size(s["open"]) >= TOGETHER
        done = F.array(F.struct(s["at"].alias("start"), s["pos"].alias("end"), s["title"].alias("title")))
        return F.struct(
            (s["pos"] + x["size"] + 1).alias("pos"),
            F.when(begins, s["pos"]).when(over, F.lit(-1)).otherwise(s["at"]).alias("at"),
            F.when(begins, x["title"]).otherwise(s["title"]).alias("title"),
            F.when(over, F.concat(F.when(shut, none).otherwise(s["open"]), done)).otherwise(s["open"]).alias("open"),
            F.when(over & shut, F.concat(s["full"], F.array(s["open"]))).otherwise(s["full"]).alias("full"),
        )

    def end(s: Column) -> Column:
        last = F.when(s["at"] >= 0, F.array(F.struct(s["at"].alias("start"), F.least(s["pos"] - 1, s["at"] + most).alias("end"), s["title"].alias("title")))).otherwise(none)
        return F.concat(F.flatten(s["full"]), s["open"], last)

    return F.aggregate(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line), first, step, end)
