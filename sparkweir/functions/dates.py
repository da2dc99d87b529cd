"""Dates, times and numbers as columns. `now` is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import pandas_function


def parsed(text: Column) -> Column:
    """An ISO time, Z as UTC; null where there is none."""
    return F.expr("null").cast("timestamp") if text is None else text.try_cast("timestamp")


def parsed_with_zone(text: Column) -> Column:
    """An ISO time that names its zone; anything else is an error."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(text.isNull(), F.lit(None).cast("timestamp")).when(zoned, text.try_cast("timestamp")).otherwise(F.raise_error(F.concat(F.lit("a time without a zone: "), text)))


def deadline(text: Column) -> Column:
    """A date alone means its last second."""
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(day, F.concat(text, F.lit(" 23:59:59")).try_cast("timestamp")).otherwise(text.try_cast("timestamp"))


def first_date(text: Column) -> tuple[Column, Column]:
    """The first date in a text, as yyyy-mm-dd or dd.mm.yyyy with hh:mm or without: (its end or time, whether it has a time)."""
    found = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})(?:[ T](\d{2}:\d{2}))?", 0)
    day = F.regexp_replace(F.substring(found, 1, 10), r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")
    time = F.nullif(F.substring(found, 12, 5), F.lit(""))
    at = F.concat(day, F.lit(" "), F.coalesce(time, F.lit("23:59"))).try_cast("timestamp")
    return F.when(found != "", at), (found != "") & time.isNotNull()


def short_date(text: Column) -> Column:
    """dd.mm.yy or dd.mm.yyyy; two digits are of this century."""
    year = F.regexp_extract(text, r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", 3)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    iso = F.concat_ws("-", full, F.lpad(F.regexp_extract(text, r"^(\d{1,2})\.(\d{1,2})\.", 2), 2, "0"), F.lpad(F.regexp_extract(text, r"^(\d{1,2})\.", 1), 2, "0"))
    return F.when(year != "", iso.try_cast("date"))


def serial_day(time: Column) -> Column:
    """Days since 1899-12-30, as spreadsheets count."""
    return F.unix_micros(time.cast("timestamp")) / 86400e6 + 25569


def days_left(time: Column, now: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_micros(time.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 86400e6)


def left_text(time: Column, now: Column) -> Column:
    seconds = (F.unix_micros(time.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6
    return F.when(seconds.isNull(), F.lit("no deadline")).when(seconds < 0, F.lit("expired")).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" d")))


def age_seconds(time: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 1e6


def fresh(time: Column, now: Column, seconds: float) -> Column:
    """Up to so old; without a time not."""
    return F.coalesce(age_seconds(time, now) <= seconds, F.lit(False))


def cooling(time: Column, now: Column, seconds: float) -> Column:
    """Less than so old; without a time yes."""
    return F.coalesce(age_seconds(time, now) < seconds, F.lit(True))


def seconds_until(time: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), -age_seconds(time, now))


def not_before(time: Column, bound: Column) -> Column:
    """Rows that lack either time pass."""
    return F.coalesce(time >= bound, F.lit(True))


def after(time: Column, bound: Column) -> Column:
    """Rows that lack either time don't pass."""
    return F.coalesce(time > bound, F.lit(False))


def day_bounds(now: Column, zone: str) -> tuple[Column, Column]:
    """The first moments of now's day in a zone and of the next, in UTC. now in UTC."""
    start = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(start + F.expr("interval 1 day"), zone)


def decimal(text: Column, kind: str = "decimal(18,2)") -> Column:
    """A number with spaces in it, or with a comma if it has no point; null where there is none."""
    bare = F.regexp_replace(text, r"[\s ]+", "")
    return F.when(F.contains(bare, F.lit(".")), bare).otherwise(F.replace(bare, F.lit(","), F.lit("."))).try_cast(kind)


def money(amount: Column) -> Column:
    """A whole number with spaces between thousands."""
    return F.replace(F.format_number(amount, 0), F.lit(","), F.lit(" "))


def whole(text: Column) -> Column:
    """A whole number that isn't negative, else 0."""
    return F.greatest(F.lit(0), F.coalesce(text.try_cast("int"), F.lit(0)))


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def first_set(*columns: Column) -> Column:
    """A setting from the first source that has it."""
    return F.coalesce(*columns)


def without_past_dates(day: str, prepositions: tuple[str, ...] = ("by", "until", "from", "on")):
    """A function of texts: dates (dd.mm.yyyy) before the day go, with the preposition before them."""
    words = "|".join(prepositions)

    @pandas_function("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        found = re.compile(rf"\s*(?:\b(?:{words})\s+)?\b(\d{{2}})\.(\d{{2}})\.(\d{{4}})\b")
        for part in texts:
            yield part.map(lambda t: found.sub(lambda m: "" if f"{m[3]}-{m[2]}-{m[1]}" < day else m[0], t), na_action="ignore")

    return run
