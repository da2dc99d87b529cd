"""Guards over reports: what may be offered, how sure a decision may be, and whether there is evidence for it.

Words, phrases and reasons are configuration. Missing texts count as empty and
missing counts as 0, so that every predicate is true or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any, matching, normal
from .cascade import first_match


def _no(*columns: Column) -> list[Column]:
    return [F.coalesce(c, F.lit(False)) for c in columns]


def restricted_origin(corpus: Column, words: list[str], most: int = 12) -> Column:
    """struct(detected, signals): which words of a restricted origin the text has, so many at most."""
    signals = F.transform(F.array(normal(corpus)), lambda b: matching(b, words))[0]
    return F.transform(F.array(signals), lambda s: F.struct((F.size(s) > 0).alias("detected"), F.slice(s, 1, most).alias("signals")))[0]


def names_any(values: Column, words: list[str]) -> Column:
    """Whether any of an array of texts has one of the words."""
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: contains_any(normal(v), words))


def guarded_offer(restricted: Column, foreign: Column, offer: Column, risks: Column, level: Column, safe: list[str], check: str) -> Column:
    """struct(applied, offer, risks, level): a foreign offer under a restricted origin gives way to the safe lines, the check joins the risks once, and a level that is low or unknown becomes medium."""
    restricted, foreign = _no(restricted, foreign)
    hit = restricted & foreign
    weak = F.lower(F.coalesce(level, F.lit(""))).isin("", "unknown", "low")
    risks = F.coalesce(risks, F.array().cast("array<string>"))
    return F.struct(
        hit.alias("applied"),
        F.when(hit, F.array(*map(F.lit, safe))).otherwise(offer).alias("offer"),
        F.when(hit, F.array_union(risks, F.array(F.lit(check)))).otherwise(risks).alias("risks"),
        F.when(hit & weak, F.lit("medium")).otherwise(level).alias("level"),
    )


def capped_confidence(decision: Column, confidence: Column, equivalent: Column, n_items: Column, n_facts: Column, unsure: tuple[str, ...] = ("unclear", "no")) -> Column:
    """A go of high confidence becomes medium where equivalents are unsure, or neither items nor facts were read."""
    bare = (F.coalesce(n_items, F.lit(0)) == 0) & (F.coalesce(n_facts, F.lit(0)) == 0)
    high = (F.lower(F.coalesce(decision, F.lit(""))) == "go") & (F.lower(F.coalesce(confidence, F.lit(""))) == "high")
    return F.when(high & (F.lower(F.coalesce(equivalent, F.lit(""))).isin(*unsure) | bare), F.lit("medium")).otherwise(confidence)


def lacks_specification(has_one: Column, said: list[Column], counts: list[Column]) -> Column:
    """Whether documents are known to hold no specification: not where one is found, else what is said first, else that some count is known and none is above 0."""
    known = F.coalesce(*counts).isNotNull()
    none = F.greatest(F.lit(0), *[F.coalesce(c, F.lit(0)) for c in counts]) == 0
    return F.when(F.coalesce(has_one, F.lit(False)), F.lit(False)).otherwise(F.coalesce(*said, known & none))


def preliminary(n_texts: Column, has_content: Column, has_one: Column, said: Column, says_none: Column, lacks: Column) -> Column:
    """Whether a report was made without a specification: some text was read, no content or specification was found, and that is said, written or known."""
    has_content, has_one, said, says_none, lacks = _no(has_content, has_one, said, says_none, lacks)
    return (F.coalesce(n_texts, F.lit(0)) > 0) & ~has_content & ~has_one & (said | says_none | lacks)


def capped_decision(decision: Column) -> Column:
    """go becomes maybe; others stay, in lower case with an underscore where they are known."""
    plain = F.replace(F.lower(F.trim(decision)), F.lit("-"), F.lit("_"))
    return F.when(plain == "go", F.lit("maybe")).when(plain.isin("maybe", "no_go"), plain).otherwise(F.nullif(F.trim(decision), F.lit("")))


def important_unread(titles: Column, n_stored: Column, words: list[str], pattern: str) -> Column:
    """Whether more documents are listed than stored, and a listed one looks important by a word or the pattern."""
    titles = F.coalesce(titles, F.array().cast("array<string>"))
    return (F.size(titles) > F.coalesce(n_stored, F.lit(0))) & F.exists(titles, lambda t: contains_any(normal(t), words) | F.coalesce(normal(t).rlike(pattern), F.lit(False)))


def no_go_reason(direct: Column, access: Column, action: Column, direct_reasons: tuple[str, ...], access_reasons: tuple[str, ...]) -> Column:
    """The direct reason if it is one of those that count, else that of market access, else low priority, else no_go."""
    low = (access == "low_priority_deal") | (action == "skip_low_priority")
    return F.coalesce(F.when(direct.isin(*direct_reasons), direct), F.when(access.isin(*access_reasons), access), first_match([("low_priority_deal", F.coalesce(low, F.lit(False)))], "no_go"))


def buying_office(customer: Column, stem: str, offices: list[str], phrases: list[str]) -> Column:
    """Whether a customer's name says that it buys for others: the stem with a word for an office, or a whole phrase."""
    return F.transform(F.array(normal(customer)), lambda b: (F.contains(b, F.lit(stem)) & contains_any(b, offices)) | contains_any(b, phrases))[0]


def lacks_evidence(found: Column, kind: Column, chars: Column, triggers: Column, weak: list[str], most: int = 2500) -> Column:
    """Whether a candidate document shows no specification: none found, of another kind, short, and with no trigger but weak ones."""
    strong = F.filter(F.transform(F.coalesce(triggers, F.array().cast("array<string>")), lambda t: normal(t)), lambda t: (t != "") & ~t.isin(*weak))
    return ~F.coalesce(found, F.lit(False)) & (F.coalesce(kind, F.lit("")) != "technical_spec") & (F.coalesce(chars, F.lit(0)) <= most) & (F.size(strong) == 0)
