"""Text functions as columns. Patterns that need Unicode classes say so, as Java's are ASCII by default."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """Lower case, with the letter yo as ye; null as empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")


def collapsed(text: Column) -> Column:
    """normal(), with each run of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(normal(text), r"(?U)\s+", " "))


def clean_lines(text: Column) -> Column:
    """Lines with white space collapsed, without empty ones."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def matching(text: Column, words: list[str], most: int | None = None) -> Column:
    """The words that the text contains, as declared, or the first of them."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.slice(found, 1, most) if most else found


def token_match(text: Column, word: str, short: int = 3) -> Column:
    """A word of few letters has to stand alone; a longer one may be part of another."""
    return whole_word(text, word) if len(word) <= short else F.contains(text, F.lit(word))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])")


def latin_boundary_match(text: Column, word: str) -> Column:
    """Words of Latin letters and digits have to stand alone, others may be part of another."""
    if re.fullmatch(r"[a-z0-9 ]+", word):
        return text.rlike(rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])")
    return F.contains(text, F.lit(word))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def cut(text: Column, most: int) -> Column:
    return F.rtrim(F.substring(text, 1, most))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")


def phone_core(text: Column) -> Column:
    """The ten digits after a leading 7 or 8 of eleven, else the first ten."""
    d = digits(text)
    return F.when((F.length(d) == 11) & d.rlike("^[78]"), F.substring(d, 2, 10)).otherwise(F.substring(d, 1, 10))


def phones_found(phones: Column, source: Column) -> Column:
    """Of phones parted by ; or a line break those whose core the source's digits contain."""
    held = digits(source)
    parts = F.transform(F.split(F.coalesce(phones, F.lit("")), r"[;\n]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (F.length(phone_core(x)) == 10) & F.contains(held, phone_core(x)))


def stems_found(names: Column, text: Column, least: int = 4) -> Column:
    """True if the text has the stem of every word of the names: the word less two letters, but four at least."""
    words = F.regexp_extract_all(normal(names), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    body = normal(text)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(body, F.substring(w, F.lit(1), F.greatest(F.lit(least), F.length(w) - 2))))


#: Names of settings that hold something secret.
SECRET_NAMES = r"password|passwd|secret|token|api_?key|authorization|credential"


def redacted(text: Column, most: int = 500) -> Column:
    """Values of secret settings as ***, white space collapsed, cut."""
    hidden = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)\b({SECRET_NAMES})(\s*[:=]\s*)[^\s,;]+", "$1$2***")
    return F.substring(F.trim(F.regexp_replace(hidden, r"\s+", " ")), 1, most)


def secret_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_").rlike(rf"(^|_)({SECRET_NAMES})(_|$)")


def cells(line: Column) -> Column:
    """Cells of a table's line by the first kind of delimiter that it has: |, tab, ;, two spaces."""
    split = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).when(F.contains(line, F.lit("\t")), F.split(line, "\t")).when(F.contains(line, F.lit(";")), F.split(line, ";")).otherwise(F.split(line, r" {2,}"))
    return F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")


def snippet(text: Column, word: str, radius: int) -> Column:
    """The text around a word's first place, null without one."""
    at = F.locate(word, text)
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - radius), F.lit(len(word)) + F.least(at - 1, F.lit(radius)) + radius))


def window_at(text: Column, start: Column, radius: int) -> Column:
    first = F.greatest(F.lit(1), start - radius)
    return F.substring(text, first, start + radius - first + 1)


def article_tokens(text: Column, most: int = 20) -> Column:
    """Tokens of letters and digits like those of articles and models, each once, in order of the text."""
    found = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"\b[A-Z0-9][A-Z0-9/.\-]{3,24}[A-Z0-9]\b"), F.lit(0))
    mixed = F.filter(found, lambda x: x.rlike("[A-Z]") & x.rlike("[0-9]") & ~x.rlike(r"^\d+(ST|ND|RD|TH|GB|MB|KG|MM|CM)$"))
    return F.slice(F.array_distinct(mixed), 1, most)


def days_near(text: Column, words: str, most: int = 10, around: int = 40) -> Column:
    """Whole numbers of days, up to so many, with one of the words within so many characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?:{words}).{{0,{around}}}?\b(\d{{1,3}}) days?\b"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x <= most))


def without_tags(html: Column) -> Column:
    """The text of HTML: scripts, styles and tags as spaces, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def tag_text(html: Column, tag: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))


def attribute(html: Column, tag: str, name: str) -> Column:
    """An attribute of the first such tag, empty without one."""
    return F.regexp_extract(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>", 0), rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def meta_refresh(html: Column) -> Column:
    """The address that a page refreshes to, empty without one."""
    return F.regexp_extract(html, r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*\burl\s*=\s*([^"'\s>]+)""", 1)


def file_name(name: Column, most: int = 120) -> Column:
    """A name without what file systems refuse."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', "_")
    safe = F.trim(F.regexp_replace(safe, r"\s+", " "))
    return F.when(safe == "", F.lit("file")).otherwise(F.substring(safe, 1, most))


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition header; the encoded form is preferred."""
    encoded = F.regexp_extract(header, r"(?i)filename\*\s*=\s*utf-8''([^;\s]+)", 1)
    plain = F.regexp_extract(header, r"""(?i)filename\s*=\s*"?([^";]+)"?""", 1)
    return F.when(encoded != "", F.url_decode(encoded)).otherwise(F.trim(plain))


def cell_value(text: Column, most: int = 32767) -> Column:
    """A spreadsheet cell: control characters gone, what a program would run as a formula quoted, cut."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.substring(F.when(bare.rlike(r"^\s*[=+@\-]"), F.concat(F.lit("'"), bare)).otherwise(bare), 1, most)


def escaped(text: Column, most: int = 200) -> Column:
    """Cut, then escaped for HTML."""
    out = F.substring(F.coalesce(text, F.lit("")), 1, most)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def first_filled(*columns: Column) -> Column:
    """The first text that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def truthy(column: Column, kind: str) -> Column:
    """null for what counts as nothing: 0, an empty text or an empty array."""
    if kind == "string":
        return F.nullif(column, F.lit(""))
    if kind == "array":
        return F.when(F.size(column) > 0, column)
    return F.when(column != 0, column)


def first_truthy(*columns: tuple[Column, str]) -> Column:
    return F.coalesce(*[truthy(c, kind) for c, kind in columns])


def joined(separator: str, *columns: Column) -> Column:
    """What is filled of the columns."""
    return F.array_join(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in columns])), separator)


def note(text: Column, most: int = 2000) -> Column:
    """Line breaks of one kind, ends trimmed; an error where the note is too long."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))
    return F.when(F.length(clean) > most, F.raise_error(F.concat(F.lit("note of "), F.length(clean).cast("string"), F.lit(" characters")))).otherwise(clean)


def comment(text: Column, most: int = 2000) -> Column:
    return F.substring(clean_lines(text), 1, most)


def distinct_ignoring_case(values: Column, most: int) -> Column:
    """Values, each once but for case and space around, in order, the first so many."""
    trimmed = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    lowered = F.transform(trimmed, lambda x: F.lower(x))
    first = F.filter(F.transform(trimmed, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(lowered, F.lower(s["x"])) == s["i"] + 1)
    return F.slice(F.transform(first, lambda s: s["x"]), 1, most)


def more_specific(roles: Column, most: int = 4) -> Column:
    """Distinct roles without those that another one contains."""
    once = F.array_distinct(roles)
    return F.slice(F.filter(once, lambda r: ~F.exists(once, lambda o: (o != r) & F.contains(o, r))), 1, most)


def chunks(text: Column, size: int) -> Column:
    """Stretches of a text of so many characters."""
    return F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))), lambda at: F.substring(text, at + 1, F.lit(size)))


def host_allowed(url: Column, suffixes: list[str]) -> Column:
    """https addresses without a user, on one of the hosts or below."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = reduce(lambda a, b: a | b, [(host == s) | host.endswith("." + s) for s in suffixes], F.lit(False))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & fits, F.lit(False))


def public_host(url: Column) -> Column:
    """http or https addresses whose host is a name with a dot and no number, and not of a local domain."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    named = host.rlike(r"^[a-z0-9\-]+(\.[a-z0-9\-]+)*\.[a-z]{2,}$") & ~host.rlike(r"(^|\.)(localhost|local|internal|lan)$")
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & named, F.lit(False))


def safe_member(path: Column) -> Column:
    """Names of archive members that stay below the folder they are unpacked to."""
    return F.coalesce(~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x00") & (F.trim(path) != ""), F.lit(False))
