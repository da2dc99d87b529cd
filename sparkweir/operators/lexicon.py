"""A lexicon as a table: phrases of any number, found by one pass over the texts.

A lexicon has the columns group and phrase. Phrases and texts are taken as
words, runs of letters and digits in lower case with the letter yo as ye; a
word of a phrase that ends in * stands for all words with that beginning. A
text's runs of words, of the lengths that the lexicon has, meet the phrases by
equality, so that 2,000 phrases cost little more than 20: no text is searched
once for each. Spark sends the lexicon to the executors while it is small, and
shuffles both sides else.

Decisions: ordered rules over the groups that a text has. The first rule that
holds wins; a rule may be overridden by groups, and may need groups of the title.

Null and empty texts have no words and fall to the rules that need none. Null
phrases and those without words match nothing. Repeated phrases count once for
a group; a phrase may be in several groups. Rows without a key have no hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal

WORD = r"[\p{L}\p{N}]+"
#: A lexicon of so many bytes, as it is held, is sent to the executors.
SENT = 64_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(normal(text), F.lit(WORD), F.lit(0))


def prepared(lexicon: DataFrame) -> DataFrame:
    """(group, phrase, size, open, at): the phrase's words joined by blanks, how many, and the length of the last one's beginning, 0 if it is whole."""
    plain = F.array_join(F.regexp_extract_all(normal(F.col("phrase")), F.lit(WORD), F.lit(0)), " ")
    is_open = F.rtrim("phrase").endswith("*")
    made = lexicon.where(F.col("phrase").isNotNull()).select(F.col("group"), plain.alias("p"), is_open.alias("o")).where("p <> ''")
    last = F.element_at(F.split("p", " "), -1)
    return made.select("group", F.col("p").alias("phrase"), F.size(F.split("p", " ")).alias("size"), F.when(F.col("o"), F.length(last)).otherwise(0).alias("open")).distinct()


def _runs(size: int, end: int) -> Column:
    """(phrase, size, open, at) of each run of so many of the words w, the last one cut to its beginning if the end is open."""

    def run(at: Column) -> Column:
        last = F.get("w", at + (size - 1))
        tail = F.left(last, F.lit(end)) if end else last
        phrase = F.array_join(F.concat(F.slice("w", at + 1, F.lit(size - 1)), F.array(tail)), " ") if size > 1 else tail
        return F.struct(phrase.alias("phrase"), F.lit(size).alias("size"), F.lit(end).alias("open"), at.alias("at"))

    made = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), run)
    return F.when(F.size("w") >= size, made).otherwise(F.slice(made, 1, 0))


def hits(df: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, group, phrase, open, n, first): how often each phrase stands in a text, and the place of the first, in words from 0."""
    ready = prepared(lexicon)
    # Shapes of phrases: words, and letters of an open end. There are few, whatever the number of phrases.
    found = ready.groupBy("size", "open").agg(F.count("*").alias("n"), F.sum(F.length("phrase") + F.length(F.coalesce("group", F.lit("")))).alias("chars")).orderBy("size", "open").collect()
    shapes = [(r.size, r.open) for r in found]
    # Left to itself Spark learns how few the phrases are when it has shuffled the texts' runs.
    if sum(r.chars + 100 * r.n for r in found) <= SENT:
        ready = F.broadcast(ready)
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), words(F.col(text)).alias("w"))
    runs = [_runs(size, end) for size, end in shapes]
    if not runs:
        return texts.where("false").select(F.col("k").alias(key), F.lit("").alias("group"), F.lit("").alias("phrase"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("first"))
    met = texts.select("k", F.inline(F.concat(*runs))).join(ready, ["phrase", "size", "open"])
    return met.groupBy(F.col("k").alias(key), "group", "phrase", "open").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def groups(df: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, groups: map of group to number of hits) of texts that have any."""
    per = hits(df, lexicon, key, text).groupBy(key, "group").agg(F.sum("n").alias("n"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "n")))).alias("groups"))


@dataclass(frozen=True)
class Rule:
    """name holds where any group of `any` is there (none named: always) and all of `all`, at least `least` hits of `any` together, no group of `unless`, and any of `title` in the title."""

    name: str
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    title: tuple[str, ...] = ()
    least: int = 1


def holds(rule: Rule, body: Column, title: Column) -> Column:
    count = lambda where, names: reduce(lambda a, b: a + b, [F.coalesce(where[n], F.lit(0)) for n in names], F.lit(0).cast("long"))
    out = F.lit(True)
    if rule.any:
        out = out & (count(body, rule.any) >= rule.least)
    for name in rule.all:
        out = out & (count(body, [name]) > 0)
    if rule.unless:
        out = out & (count(body, rule.unless) == 0)
    if rule.title:
        out = out & (count(title, rule.title) > 0)
    return out


def decide(df: DataFrame, lexicon: DataFrame, key: str, title: str, text: str, rules: list[Rule], otherwise: str) -> DataFrame:
    """df with decision, and signals: the groups of its text, sorted. Keys are unique; a row without one has no signals."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    body = groups(df, lexicon, key, text).select(F.col(key).alias("_body_key"), F.col("groups").alias("_body"))
    head = groups(df, lexicon, key, title).select(F.col(key).alias("_head_key"), F.col("groups").alias("_head"))
    met = df.join(body, F.col(key) == F.col("_body_key"), "left").join(head, F.col(key) == F.col("_head_key"), "left").withColumn("_body", F.coalesce("_body", none)).withColumn("_head", F.coalesce("_head", none))
    decision = reduce(lambda rest, r: F.when(holds(r, F.col("_body"), F.col("_head")), F.lit(r.name)).otherwise(rest), reversed(rules), F.lit(otherwise))
    return met.select(*df.columns, decision.alias("decision"), F.array_sort(F.map_keys("_body")).alias("signals"))
