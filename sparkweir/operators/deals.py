"""Predicates over a deal's title and text, by groups of words.

A deal is a struct of flags: for each group whether its words are in the
title, and whether they are in the title or text. Groups are configuration;
the predicates say how they go together. Missing text counts as empty, so that
every predicate is true or false. A predicate names the groups it reads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any, normal
from .cascade import all_matches
from .rules import Lexicon


class Deal:
    """in_title and in_text of a deal's groups, from a column made by flags()."""

    def __init__(self, column: str):
        self.column = column

    def in_title(self, group: str) -> Column:
        return F.col(self.column)["title"][group]

    def in_text(self, group: str) -> Column:
        return F.col(self.column)["text"][group]


def flags(title: Column, text: Column, groups: Lexicon) -> Column:
    """struct(title, text) of flags by group; both texts are normalised once."""
    one = lambda body: F.struct(*[contains_any(body, words).alias(group) for group, words in groups.items()])
    both = F.struct(normal(title).alias("title"), normal(F.concat_ws(" ", title, text)).alias("text"))
    return F.transform(F.array(both), lambda b: F.struct(one(b["title"]).alias("title"), one(b["text"]).alias("text")))[0]


def excluded_vertical(d: Deal) -> Column:
    """Of a vertical that isn't ours, unless the title names what we sell."""
    return d.in_text("vertical") & ~d.in_title("goods")


def full_deal(d: Deal, price: Column, least: Column) -> Column:
    """Goods of at least the category's price; an unknown price will do if the title says supply."""
    return d.in_text("goods") & F.coalesce(price >= least, d.in_title("supply"))


def generic_guard(d: Deal, n_goods: Column, least: int = 2) -> Column:
    """A title that only says equipment passes if the text names so many kinds of goods; other titles pass."""
    return ~(d.in_title("generic") & ~d.in_title("goods")) | (n_goods >= least)


def infra_project(d: Deal) -> Column:
    """Works on our kind of goods, and no mere service."""
    return d.in_title("works") & d.in_text("goods") & ~d.in_title("service")


def non_core(d: Deal) -> Column:
    """Building works whose object or systems aren't ours: by the title with either, or by the object with the text's."""
    by_title = d.in_title("building") & (d.in_title("site") | d.in_text("systems"))
    by_site = d.in_title("site") & (d.in_text("building") | d.in_text("systems"))
    return ~(d.in_title("supply") & d.in_title("goods")) & (by_title | by_site) & (d.in_text("works") | d.in_text("systems"))


def supply_intent(d: Deal) -> Column:
    """Supply of goods in the title, where neither what isn't ours nor a service without goods speaks against it."""
    barred = non_core(d) | excluded_vertical(d) | (d.in_title("service") & ~d.in_title("goods"))
    return ~barred & d.in_title("supply") & d.in_text("goods")


def service_noise(d: Deal) -> Column:
    """A service in the title; overridden by supply of goods first, then by works on goods."""
    return F.when(d.in_title("supply") & d.in_title("goods"), F.lit(False)).when(infra_project(d), F.lit(False)).otherwise(d.in_title("service"))


def target(d: Deal) -> Column:
    """Supply of goods, or goods in the title without a service, a foreign vertical or building works."""
    return supply_intent(d) | (d.in_title("goods") & ~(service_noise(d) | excluded_vertical(d) | non_core(d)))


def exact(d: Deal, model: Column) -> Column:
    """A target with a maker's name or a model."""
    return target(d) & (d.in_text("maker") | model)


def domestic_restriction(d: Deal) -> Column:
    """A ban on foreign goods that the text doesn't lift."""
    return d.in_text("ban") & ~d.in_text("lifted")


def incumbent_extension(d: Deal) -> Column:
    """More of what a maker has already put in, unless something new is bought."""
    return d.in_text("extension") & d.in_text("maker") & ~(d.in_title("supply") & ~d.in_title("extension"))


def tailored(d: Deal, model: Column, n_makers: Column) -> Column:
    """Two or more of: one maker only, a model, no equivalents."""
    marks = (n_makers == 1).cast("int") + model.cast("int") + d.in_text("no_equivalent").cast("int")
    return marks >= 2


def warnings(d: Deal, model: Column, n_makers: Column, price: Column, days_left: Column) -> Column:
    """What to look at before a choice, in order. An unknown price or deadline is a warning of its own."""
    return all_matches(
        [
            ("restricted", domestic_restriction(d)),
            ("tailored", tailored(d, model, n_makers)),
            ("incumbent", incumbent_extension(d)),
            ("service", service_noise(d)),
            ("not_core", non_core(d)),
            ("price_unknown", price.isNull() | (price <= 0)),
            ("deadline_unknown", days_left.isNull()),
            ("deadline_near", days_left.between(0, 2)),
        ]
    )
