"""A rule engine over texts: a lexicon gives flags, ordered rules give decisions.

A lexicon is a dict from group to words; it is configuration, and the small
one here serves the tests. Every decision is an ordered cascade in which the
first rule that holds wins, and every expression is total: missing text counts
as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, matching, normal
from .cascade import all_matches, any_of, first_match
from .near import alike  # noqa: F401

Lexicon = dict[str, list[str]]


def flags(text: Column, lexicon: Lexicon) -> dict[str, Column]:
    """One condition per group of words."""
    body = normal(text)
    return {group: contains_any(body, words) for group, words in lexicon.items()}


def flagged(text: Column, lexicon: Lexicon) -> Column:
    """flags() as one struct: the text is normalised once, whatever the number of words and of uses."""
    return F.transform(F.array(normal(text)), lambda body: F.struct(*[contains_any(body, words).alias(group) for group, words in lexicon.items()]))[0]


def gate(title: Column, body: Column, positive: list[str], title_only: list[str], negative: list[str], override: list[str]) -> Column:
    """struct(accepted, hit): a positive word anywhere, or a title word in the title, and no negative word unless an overriding one is there."""
    t, b = normal(title), normal(F.concat_ws(" ", title, body))
    hits = F.concat(matching(b, positive), matching(t, title_only))
    barred = contains_any(b, negative) & ~contains_any(b, override)
    return F.struct(((F.size(hits) > 0) & ~barred).alias("accepted"), F.get(hits, F.lit(0)).alias("hit"))


def evidence(*parts: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def assessment(rules: list[tuple[str, Column, str, str]], otherwise: tuple[str, str, str]) -> Column:
    """struct(fit, recommendation, reason) of the first rule (reason, condition, fit, recommendation)."""

    def made(fit, recommendation, reason):
        return F.struct(F.lit(fit).alias("fit"), F.lit(recommendation).alias("recommendation"), F.lit(reason).alias("reason"))

    out = made(*otherwise)
    for reason, condition, fit, recommendation in reversed(rules):
        out = F.when(condition, made(fit, recommendation, reason)).otherwise(out)
    return out


def effective(recommendation: Column, fit: Column) -> Column:
    """A go of a poor fit is a maybe; a maybe of none is a no."""
    return F.when((recommendation == "go") & (fit == "poor"), F.lit("maybe")).when((recommendation == "maybe") & (fit == "none"), F.lit("no_go")).otherwise(recommendation)


def signal_strength(n_strong: Column, n_weak: Column, noise: Column) -> Column:
    return F.when(noise & (n_strong == 0), F.lit("noise")).when(n_strong > 0, F.lit("strong")).when(n_weak > 0, F.lit("weak")).otherwise(F.lit("none"))


def hard_noise(text: Column, rules: list[tuple[str, list[str]]], core: list[str]) -> Column:
    """The first noise rule whose words the text has, unless a core word overrides it."""
    body = normal(text)
    reason = first_match([(name, contains_any(body, words)) for name, words in rules])
    return F.when(~contains_any(body, core), reason)


def signals(text: Column, lexicon: Lexicon) -> Column:
    return F.transform(F.array(flagged(text, lexicon)), lambda f: all_matches([(group, f[group]) for group in lexicon]))[0]


def tightened(found: Column, reason: Column, kept: dict[str, list[str]]) -> Column:
    """Signals less those that a noise reason voids."""
    return reduce(lambda out, pair: F.when(reason == pair[0], F.filter(found, lambda s: s.isin(pair[1]))).otherwise(out), kept.items(), found)


def category(title: Column, corpus: Column, markers: list[tuple[str, list[str]]], generic: str = "other") -> Column:
    """The first group with a word in the title; else the group with most words in the corpus, the earlier in a tie; else generic."""

    def occurrences(body, words):
        # What removing a word takes away; unlike a pattern's matches this needs no pass over characters.
        return reduce(lambda a, b: a + b, [((F.octet_length(body) - F.octet_length(F.replace(body, F.lit(w), F.lit("")))) / len(w.encode())).cast("int") for w in words])

    def decided(x):
        by_title = first_match([(name, contains_any(x["title"], words)) for name, words in markers])
        counts = F.array(*[F.struct(occurrences(x["corpus"], words).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(markers)])
        best = F.transform(F.array(F.array_max(counts)), lambda b: F.when(b["n"] > 0, b["name"]))[0]
        return F.coalesce(by_title, best, F.lit(generic))

    return F.transform(F.array(F.struct(normal(title).alias("title"), normal(corpus).alias("corpus"))), decided)[0]


def document_type(name: Column, text: Column, by_name: list[tuple[str, str]], by_text: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """struct(type, by): patterns on the file's name come before those on its text."""
    n, t = normal(name), normal(text)
    named = first_match([(kind, n.rlike(p)) for kind, p in by_name])
    read = first_match([(kind, t.rlike(p)) for kind, p in by_text])
    return F.struct(F.coalesce(named, read, F.lit(otherwise)).alias("type"), F.when(named.isNotNull(), F.lit("name")).when(read.isNotNull(), F.lit("text")).otherwise(F.lit("none")).alias("by"))


def row_evidence(line: Column) -> Column:
    """How many of six marks of a product's row a line has: number first, unit, quantity, price, several cells, an article."""
    marks = [r"^\s*\d+[.)\s]", r"(?i)\b(pcs|pc|kg|m|l|set|unit)\b", r"\b\d+([.,]\d+)?\b", r"\d[.,]\d{2}\b", r"\S(\t|\s{2,}|\|)\S", r"\b[A-Z]{1,4}-?\d{2,}\b"]
    return reduce(lambda a, b: a + b, [line.rlike(m).cast("int") for m in marks])


def product_lines(text: Column, least: int = 3) -> Column:
    """(position, line) of the lines with enough marks."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.struct(i.alias("position"), line.alias("line")))
    return F.filter(lines, lambda x: row_evidence(x["line"]) >= least)


def points(scores: list[tuple[Column, int]]) -> Column:
    """Sum of the points whose conditions hold."""
    return reduce(lambda a, b: a + b, [F.when(condition, F.lit(n)).otherwise(0) for condition, n in scores])


def primary(df: DataFrame, keys: list[str], score: str, tie: str, threshold: int = 110, margin: int = 10) -> DataFrame:
    """The best candidate of each key with `selection`: selected, ambiguous if the next is as near as the margin, or below_threshold."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc())
    ranked = df.withColumn("_rank", F.row_number().over(order)).where("_rank <= 2")
    best = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 1, F.col(tie))).alias(tie),
        F.max(F.when(F.col("_rank") == 1, F.col(score))).alias(score),
        F.max(F.when(F.col("_rank") == 2, F.col(score))).alias("next_score"),
    )
    decision = F.when(F.coalesce(F.col(score) < threshold, F.lit(True)), F.lit("below_threshold")).when(F.col(score) - F.col("next_score") < margin, F.lit("ambiguous")).otherwise(F.lit("selected"))
    return best.withColumn("selection", decision)


def document_quality(chars: Column, words: Column, letters: Column) -> Column:
    """struct(quality, confidence) from the counts of a text."""
    share = F.try_divide(letters.cast("double"), chars.cast("double"))
    quality = F.when(F.coalesce(chars, F.lit(0)) == 0, F.lit("empty")).when(share < 0.5, F.lit("garbled")).when(words < 50, F.lit("short")).otherwise(F.lit("good"))
    confidence = F.when(quality.isin("empty", "garbled"), F.lit("low")).when(quality == "short", F.lit("medium")).otherwise(F.lit("high"))
    return F.struct(quality.alias("quality"), confidence.alias("confidence"))


def document_status(n_documents: Column, n_text: Column, n_failed: Column) -> Column:
    return first_match([("no_documents", n_documents == 0), ("ready", n_text == n_documents), ("partial", n_text > 0), ("failed", n_failed > 0)], "waiting")


def status_action(status: Column) -> Column:
    return F.when(status == "no_documents", F.lit("search")).when(status == "failed", F.lit("load_again")).when(status == "waiting", F.lit("wait")).when(status == "partial", F.lit("review")).otherwise(F.lit("none"))


def html_class(html: Column) -> Column:
    """What a response is: empty, login, captcha, error, redirect, listing or document."""
    h = F.lower(F.coalesce(html, F.lit("")))
    return first_match(
        [
            ("empty", F.trim(h) == ""),
            ("login", h.rlike(r"<input[^>]*type\s*=\s*.?password")),
            ("captcha", F.contains(h, F.lit("captcha"))),
            ("error", h.rlike(r"<title>[^<]*(404|403|500|not found|forbidden|error)")),
            ("redirect", h.rlike(r"http-equiv\s*=\s*.?refresh")),
            ("listing", F.regexp_count(h, F.lit("<li")) >= 20),
        ],
        "document",
    )


#: First bytes of file formats.
MAGIC = [("pdf", b"%PDF-"), ("zip", b"PK\x03\x04"), ("7z", b"7z\xbc\xaf\x27\x1c"), ("rar", b"Rar!\x1a\x07"), ("ole", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("gzip", b"\x1f\x8b"), ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff")]


def magic(content: Column) -> Column:
    """The format that a file's first bytes name; html and text by their look, else unknown."""
    rules = [(kind, F.substring(content, 1, len(start)) == F.lit(bytearray(start))) for kind, start in MAGIC]
    head = F.lower(F.substring(content, 1, 512).cast("string"))
    rules.append(("html", head.rlike(r"^\s*(<!doctype html|<html)")))
    return first_match(rules, "unknown")


#: Formats that a suffix may stand for.
SUFFIX_FORMATS = {"pdf": ["pdf"], "docx": ["zip"], "xlsx": ["zip"], "zip": ["zip"], "doc": ["ole"], "xls": ["ole"], "7z": ["7z"], "rar": ["rar"], "html": ["html"]}


def format_check(name: Column, found: Column) -> Column:
    """ok, mismatch, html_instead, or unknown_suffix."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    ok = any_of([(suffix == s) & found.isin(formats) for s, formats in SUFFIX_FORMATS.items()])
    return F.when(~suffix.isin(*SUFFIX_FORMATS), F.lit("unknown_suffix")).when(ok, F.lit("ok")).when(found == "html", F.lit("html_instead")).otherwise(F.lit("mismatch"))


def failure_class(output: Column) -> Column:
    """What a failed step's output says; transient ones may be tried again."""
    o = F.lower(F.coalesce(output, F.lit("")))
    return first_match(
        [
            ("rate_limited", o.rlike(r"\b429\b|too many requests|rate limit")),
            ("transient", transient(output)),
            ("not_found", o.rlike(r"\b404\b|not found")),
            ("denied", o.rlike(r"\b40[13]\b|forbidden|unauthorized")),
            ("invalid", o.rlike("invalid|malformed|cannot parse")),
        ],
        "other",
    )


def transient(output: Column) -> Column:
    return F.lower(F.coalesce(output, F.lit(""))).rlike(r"timed? ?out|connection (reset|refused|aborted)|temporarily|\b50[234]\b|dns|ssl")


def download_priority(role: Column, suffix: Column) -> Column:
    """0 to 9, the first to load first."""
    base = F.when(role == "specification", F.lit(0)).when(role == "contract", F.lit(2)).when(role == "notice", F.lit(4)).when(role == "form", F.lit(6)).otherwise(F.lit(8))
    return base + F.when(suffix.isin("pdf", "docx", "doc", "txt"), F.lit(0)).otherwise(F.lit(1))


def skip_reason(row: dict[str, Column]) -> Column:
    """Why a candidate isn't prepared, by precedence. row: expired, soon, blocked, cooling, exhausted, rejected, has_report."""
    return first_match([("expired", row["expired"]), ("deadline_soon", row["soon"]), ("rejected", row["rejected"]), ("exhausted", row["exhausted"]), ("blocked", row["blocked"] & row["cooling"]), ("has_report", row["has_report"])])


def any_no(recommendations: Column) -> Column:
    """no_go if any is; else the first."""
    return F.when(F.array_contains(recommendations, "no_go"), F.lit("no_go")).otherwise(F.get(recommendations, F.lit(0)))


def occurrences_grade(text: Column, names: Column, phones: Column, mails: Column) -> Column:
    """A, B or C: contacts whose name and phone the text has, whose phone, or whose name and mail."""
    from ..functions.text import digits, phone_core

    body, held = normal(text), digits(text)
    name = (F.coalesce(names, F.lit("")) != "") & F.contains(body, normal(names))
    phone = (F.length(phone_core(phones)) == 10) & F.contains(held, phone_core(phones))
    mail = (F.coalesce(mails, F.lit("")) != "") & F.contains(body, normal(mails))
    return F.when(name & phone, F.lit("A")).when(phone, F.lit("B")).when(name & mail, F.lit("C")).otherwise(F.lit("none"))


def export_status(hidden: Column, has_report: Column, expired: Column) -> Column:
    return first_match([("expired", expired), ("hidden", hidden.isNotNull()), ("ready", has_report)], "waiting")


#: Required rows in a part, for readiness().
AT_A_TIME = 500_000


def readiness(required: DataFrame, processed: DataFrame, key: str, document: str) -> DataFrame:
    """Per key: n_required, n_processed, n_missing, n_without_text, and the reason by precedence. processed: (key, document, has_text).

    Both are dealt once, by key, in parts of AT_A_TIME rows or so; a task groups
    a part without a join. What is processed under a null key or document is of no use.
    """
    n = max(int(required.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-required.count() // AT_A_TIME))
    needed = required.select(key, document, F.lit(True).alias("_needed"), F.lit(None).cast("boolean").alias("has_text"))
    done = processed.where(F.col(key).isNotNull() & F.col(document).isNotNull()).select(key, document, F.lit(False).alias("_needed"), "has_text")
    dealt = needed.unionByName(done).repartition(n, key)
    joined = dealt.groupBy(key, document).agg(F.max("_needed").alias("_needed"), F.max("has_text").alias("has_text")).where("_needed")
    counts = joined.groupBy(key).agg(
        F.count("*").alias("n_required"),
        F.count_if("has_text").alias("n_processed"),
        F.count_if(F.col("has_text").isNull()).alias("n_missing"),
        F.count_if(~F.col("has_text")).alias("n_without_text"),
    )
    reason = first_match([("missing", F.col("n_missing") > 0), ("not_processed", F.col("n_without_text") > 0)], "ready")
    return counts.withColumn("reason", reason)


def backfill_outcome(row: dict[str, Column]) -> Column:
    """Nine classes in order. row: status, retry, rate_limited, n_new, n_found, n_errors."""
    return first_match(
        [
            ("rate_limited", row["rate_limited"]),
            ("retry_scheduled", row["retry"]),
            ("failed", row["status"] == "failed"),
            ("partial", (row["n_errors"] > 0) & (row["n_new"] > 0)),
            ("errors", row["n_errors"] > 0),
            ("loaded", row["n_new"] > 0),
            ("known", row["n_found"] > 0),
            ("empty", row["status"] == "done"),
        ],
        "unknown",
    )


def sections(text: str | None, start: str, stop: str, most: int = 6000) -> list[dict]:
    """(start, end, title) of sections: from a heading that start fits to the next that stop fits, or so many characters: of one text, outside Spark."""
    import re

    out, at = [], None
    begin, end = re.compile(start, re.I), re.compile(stop, re.I)
    position = 0
    for line in (text or "").split("\n"):
        if at is not None and (end.search(line) or position - at["start"] >= most):
            out.append(at | {"end": position})
            at = None
        if at is None and begin.search(line):
            at = {"start": position, "title": line.strip()[:120]}
        position += len(line) + 1
    if at is not None:
        out.append(at | {"end": min(position - 1, at["start"] + most)})
    return out


def section_finder(start: str, stop: str, most: int = 6000):
    """sections() as a column, in the JVM."""
    from .excerpts import sections as found

    return lambda text: found(F.col(text) if isinstance(text, str) else text, start, stop, most)


def windows(text: str | None, words: list[str], radius: int, most: int) -> list[dict]:
    """(start, end) around words, those that would overlap the one before left out: of one text, outside Spark."""
    import re

    out: list[dict] = []
    if text and words:
        for m in re.finditer("|".join(map(re.escape, words)), text, re.I):
            a, b = max(0, m.start() - radius), min(len(text), m.end() + radius)
            if out and a < out[-1]["end"]:
                continue
            out.append({"start": a, "end": b})
            if len(out) == most:
                break
    return out


def window_finder(words: list[str], radius: int, most: int = 12):
    """windows() as a column, in the JVM."""
    from .excerpts import windows as around

    return lambda text: F.when(F.lit(bool(words)), around(F.col(text) if isinstance(text, str) else text, words or ["x"], radius, radius, most))


def coded_row(line: Column) -> Column:
    """struct(code, name, unit, quantity) of a row of a coded catalogue: a code with dots, then cells; null for other lines."""
    cells = F.transform(F.split(line, r"\||\t| {2,}"), lambda x: F.trim(x))
    code = F.regexp_extract(line, r"\b(\d{2}\.\d{2}\.\d{2}(?:\.\d{3})?(?:-\d{4,8})?)\b", 1)
    return F.when((code != "") & (F.size(cells) >= 4), F.struct(code.alias("code"), F.get(cells, F.lit(1)).alias("name"), F.get(cells, F.size(cells) - 2).alias("unit"), F.replace(F.get(cells, F.size(cells) - 1), F.lit(","), F.lit(".")).try_cast("double").alias("quantity")))


def header_position(lines: Column, words: list[str], least: int = 2) -> Column:
    """The index of the first line with so many of the words, null without one."""
    hits = F.transform(lines, lambda line: reduce(lambda a, b: a + b, [F.contains(F.lower(line), F.lit(w)).cast("int") for w in words]) >= least)
    at = F.array_position(hits, True)
    return F.when(at > 0, at - 1)


def additive_score(rules: list[tuple[Column, int]], profile: Column, too_soon: Column, void: Column) -> Column:
    """Points clamped to 0..100, then at most 25 without a profile signal, then 0 if void, then at most 60 if too soon."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), points(rules)))
    score = F.when(~profile, F.least(score, F.lit(25))).otherwise(score)
    score = F.when(void, F.lit(0)).otherwise(score)
    return F.when(too_soon, F.least(score, F.lit(60))).otherwise(score)


def weighted_risk(df: DataFrame, keys: list[str], weight: str, signal: str) -> DataFrame:
    """Per key the sum of weight times signal, each cut to a whole number, within 0..100, and its band."""
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.sum((F.col(weight) * F.col(signal)).cast("int")))).cast("int")
    band = F.when(F.col("risk") >= 70, F.lit("high")).when(F.col("risk") >= 40, F.lit("medium")).otherwise(F.lit("low"))
    return df.groupBy(*keys).agg(total.alias("risk")).withColumn("band", band)
