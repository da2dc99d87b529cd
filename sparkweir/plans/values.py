"""Queries over scalar functions: texts, dates, numbers, JSON and hashes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, jsonx, text
from ..operators import cascade, excerpts, ranking, rules
from .registry import query, table
from .selections import NOW, NOW_SQL, ntz


@query(
    "H01-H05 H38",
    r"""SELECT doc_id, md5(lower(text)) AS normal, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), lambda l: l <> ''), chr(10))) AS lines,
        contains(lower(text), 'the') OR contains(lower(text), 'der') AS any_word, array_to_string(list_filter(['the', 'der', 'que', 'password', 'zzz'], lambda w: contains(lower(text), w)), ',') AS words FROM documents""",
)
def h_normalise_and_match(spark, sf_dir):
    t = F.col("text")
    n = text.normal(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(n.cast("binary")).alias("normal"),
        F.md5(text.clean_lines(t).cast("binary")).alias("lines"),
        text.contains_any(n, ["the", "der"]).alias("any_word"),
        F.array_join(text.matching(n, ["the", "der", "que", "password", "zzz"]), ",").alias("words"),
    )


@query(
    "H06 H07 H37",
    r"""SELECT page_id, regexp_matches(lower(url), '(^|[^a-z0-9])fr([^a-z0-9]|$)') AS short_alone, contains(lower(url), 'example') AS long_anywhere, regexp_matches(lower(url), '(^|[^a-z0-9])page([^a-z0-9]|$)') AS whole FROM pages""",
)
def h_boundary_matches(spark, sf_dir):
    u = F.lower("url")
    return table(spark, sf_dir, "pages").select("page_id", text.token_match(u, "fr").alias("short_alone"), text.token_match(u, "example").alias("long_anywhere"), text.latin_boundary_match(u, "page").alias("whole"))


@query(
    "H08 H16 H17 H42",
    """SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 77)) || '...' ELSE text END AS short, rtrim(substr(text, 1, 50)) AS cut,
       CASE WHEN position(' th' IN text) > 0 THEN substr(text, greatest(1, position(' th' IN text) - 20), 3 + least(position(' th' IN text) - 1, 20) + 20) END AS snippet FROM documents""",
)
def h_truncate_and_snippets(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.ellipsis(t, 80).alias("short"), text.cut(t, 50).alias("cut"), text.snippet(t, " th", 20).alias("snippet"))


@query(
    "H09 H10",
    r"""WITH d AS (SELECT c_custkey, regexp_replace(c_name || CAST(c_custkey * 7919 AS VARCHAR), '[^0-9]', '', 'g') AS d FROM customer) SELECT c_custkey, d AS digits, CASE WHEN length(d) = 11 AND regexp_matches(d, '^[78]') THEN substr(d, 2, 10) ELSE substr(d, 1, 10) END AS core FROM d""",
)
def h_phone_core(spark, sf_dir):
    p = F.concat("c_name", (F.col("c_custkey") * 7919).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.digits(p).alias("digits"), text.phone_core(p).alias("core"))


@query(
    "H11 H12 K51 K52 D34",
    r"""WITH f AS (SELECT doc_id, lower(text) AS body, regexp_replace(text, '[^0-9]', '', 'g') AS held, regexp_extract(text, '(\+?\d[\d \-()]{8,16}\d)', 1) AS phone, lower(regexp_extract(text, '([\w.+\-]+@[\w\-]+\.[\w.]+)', 1)) AS mail, lower(regexp_extract(text, '^(\p{L}+)', 1)) AS name FROM documents),
        d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM f), c AS (SELECT *, CASE WHEN length(digits) = 11 AND regexp_matches(digits, '^[78]') THEN substr(digits, 2, 10) ELSE substr(digits, 1, 10) END AS core FROM d),
        k AS (SELECT *, length(core) = 10 AND contains(held, core) AS p, name <> '' AND contains(body, name) AS n, mail <> '' AND contains(body, mail) AS m FROM c)
        SELECT doc_id, CAST(p AS INTEGER) + CAST(contains(held, '9990000000') AS INTEGER) AS phones, name <> '' AND contains(body, substr(name, 1, greatest(4, length(name) - 2))) AS name_found,
        CASE WHEN n AND p THEN 'A' WHEN p THEN 'B' WHEN n AND m THEN 'C' ELSE 'none' END AS grade FROM k""",
)
def h_contact_grounding(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    phone = F.regexp_extract("text", r"(\+?\d[\d \-()]{8,16}\d)", 1)
    mail = F.regexp_extract("text", r"([\w.+\-]+@[\w\-]+\.[\w.]+)", 1)
    name = F.regexp_extract("text", r"^(\p{L}+)", 1)
    return d.select(
        "doc_id",
        F.size(text.phones_found(F.concat_ws(";", phone, F.lit("+7 999 000-00-00")), F.col("text"))).alias("phones"),
        text.stems_found(name, F.col("text")).alias("name_found"),
        rules.occurrences_grade(F.col("text"), name, phone, mail).alias("grade"),
    )


@query(
    "H13 H14",
    r"""SELECT doc_id, md5(substr(trim(regexp_replace(regexp_replace(text, '(?i)\b(password|passwd|secret|token|api_?key|authorization|credential)(\s*[:=]\s*)[^\s,;]+', '\1\2***', 'g'), '\s+', ' ', 'g')), 1, 500)) AS redacted FROM documents""",
)
def h_redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redacted(F.col("text")).cast("binary")).alias("redacted"))


@query(
    "H15 K74 K75",
    r"""SELECT doc_id, len(list_filter(list_transform(CASE WHEN contains(l, '|') THEN string_split(l, '|') WHEN contains(l, chr(9)) THEN string_split(l, chr(9)) WHEN contains(l, ';') THEN string_split(l, ';') ELSE regexp_split_to_array(l, ' {2,}') END, lambda x: trim(x)), lambda x: x <> '')) AS cells FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)""",
)
def h_table_cells(spark, sf_dir):
    line = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.cells(line)).cast("long").alias("cells"))


def _windows_sql(column: str, pattern: str, before: int, after: int, most: int) -> str:
    """Windows of a text column as start-end, parted by commas: places from what is between matches, then the first, and each next that begins after the one taken."""
    b, f = f"regexp_split_to_array({column}, '{pattern}')", f"regexp_extract_all({column}, '{pattern}')"
    at = "(list_sum(list_transform(b[1:i], lambda y: length(y))) + COALESCE(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0))"
    spans = f"list_transform(range(1, len(f) + 1), lambda i: [{{'a': greatest(0, {at} - {before}), 'z': least(n, {at} + length(f[i]) + {after})}}])"
    taken = f"list_reduce({spans}, lambda x, y: CASE WHEN len(x) < {most} AND y[1].a >= x[len(x)].z THEN list_concat(x, y) ELSE x END)"
    return f"(SELECT CASE WHEN len(f) = 0 THEN '' ELSE array_to_string(list_transform({taken}, lambda w: CAST(w.a AS VARCHAR) || '-' || CAST(w.z AS VARCHAR)), ',') END FROM (SELECT {b} AS b, {f} AS f, length({column}) AS n))"


@query("H20 H21 H39 H40", f"""SELECT doc_id, {_windows_sql("text", "[0-9]{2,}", 30, 60, 12)} AS numbers, {_windows_sql("text", "(?i)password|token|licen[cs]e", 350, 700, 8)} AS words FROM documents""")
def h_text_windows(spark, sf_dir):
    t = F.col("text")
    shown = lambda w: F.array_join(F.transform(w, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return table(spark, sf_dir, "documents").select("doc_id", shown(excerpts.windows(t, "[0-9]{2,}", 30, 60, 12)).alias("numbers"), shown(excerpts.windows(t, "(?i)password|token|licen[cs]e", 350, 700, 8)).alias("words"))


#: Words by group with each group's budget, for excerpts.
EXCERPTS = [(["password", "token"], 3), (["the", "und", "que"], 3), (["price", "@"], 2)]


def _budgeted_sql(column: str, groups, before: int, after: int, most: int, each: int, share: float) -> str:
    """Excerpts with budgets: every word's matches in rounds, folded with what was taken; a taken window knows its round and its group."""
    every = [w for words, _ in groups for w in words]
    rounds = [(w, g, each, budget) for g, (words, budget) in enumerate(groups) for w in words] + [(w, 1000 + i, 1000000, 1000000) for i, w in enumerate(every)]
    split = ", ".join(f"regexp_split_to_array({column}, '(?i){w}') AS b{i}, regexp_extract_all({column}, '(?i){w}') AS f{i}" for i, w in enumerate(every))

    def made(k: int, w: str, g: int, own: int, budget: int) -> str:
        b, f = f"b{every.index(w)}", f"f{every.index(w)}"
        at = f"(list_sum(list_transform({b}[1:i], lambda y: length(y))) + (i - 1) * {len(w)})"
        return f"list_transform(range(1, len({f}) + 1), lambda i: [{{'a': greatest(0, {at} - {before}), 'z': least(n, {at} + {len(w) + after}), 'g': {g}, 'w': {k}, 'own': {own}, 'budget': {budget}}}])"

    candidates = f"flatten([{', '.join(made(k, *r) for k, r in enumerate(rounds))}])"
    common = "(least(y[1].z, k.z) - greatest(y[1].a, k.a))"
    close = f"len(list_filter(x, lambda k: {common} > 0 AND {common} >= {share} * greatest(1, least(y[1].z - y[1].a, k.z - k.a)))) > 0"
    taken = f"list_reduce({candidates}, lambda x, y: CASE WHEN len(x) < {most} AND len(list_filter(x, lambda k: k.w = y[1].w)) < y[1].own AND len(list_filter(x, lambda k: k.g = y[1].g)) < y[1].budget AND NOT ({close}) THEN list_concat(x, y) ELSE x END)"
    return f"(SELECT CASE WHEN {' + '.join(f'len(f{i})' for i in range(len(every)))} = 0 THEN '' ELSE array_to_string(list_transform({taken}, lambda w: CAST(w.a AS VARCHAR) || '-' || CAST(w.z AS VARCHAR)), ',') END FROM (SELECT {split}, length({column}) AS n))"


@query("H22 C27", f"""SELECT doc_id, {_budgeted_sql("text", EXCERPTS, 80, 160, 10, 2, 0.55)} AS spans FROM documents""")
def h_budgeted_excerpts(spark, sf_dir):
    spans = excerpts.budgeted(F.col("text"), EXCERPTS, 80, 160, 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))


@query("H20-H22 H39 H40")
def h_excerpts(spark, sf_dir):
    """Windows around words and patterns, and excerpts with a budget for each group of words."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    near = excerpts.windows(t, r"(?i)\b(?:ship|deliver|within)\w*", 350, 700, 8)
    return d.select("doc_id", excerpts.windows(t, r"\b\d{2,}\b", 30, 60, 12).alias("numbers"), near.alias("delivery"), excerpts.cut(t, excerpts.budgeted(t, EXCERPTS, 80, 160, 10)).alias("excerpts"))


@query("H18-H22 H39 H40 C27 K26")
def h_windows_and_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    finder, sections = rules.window_finder(["the", "und", "que"], 40, 8), rules.section_finder(r"^\s*(the|der|la)\b", r"^\s*$|^[A-Z]{2,}")
    return d.select("doc_id", F.array_join(text.article_tokens(F.col("text")), ",").alias("articles"), F.size(text.days_near(F.col("text"), "ship|deliver")).alias("days"), finder("text").alias("windows"), sections("text").alias("sections"))


@query(
    "H23-H26 K40",
    r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, regexp_extract(regexp_extract(html, '(?is)<html[^>]*>'), '(?is)lang\s*=\s*["'']([^"'']*)["'']', 1) AS lang,
        md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS bare,
        CASE WHEN trim(html) = '' THEN 'empty' WHEN regexp_matches(lower(html), '<input[^>]*type\s*=\s*.?password') THEN 'login' WHEN contains(lower(html), 'captcha') THEN 'captcha' WHEN regexp_matches(lower(html), '<title>[^<]*(404|403|500|not found|forbidden|error)') THEN 'error'
        WHEN regexp_matches(lower(html), 'http-equiv\s*=\s*.?refresh') THEN 'redirect' WHEN len(regexp_extract_all(lower(html), '<li')) >= 20 THEN 'listing' ELSE 'document' END AS class FROM pages""",
)
def h_html_fields(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.tag_text(h, "title").alias("title"), text.attribute(h, "html", "lang").alias("lang"), F.md5(text.without_tags(h).cast("binary")).alias("bare"), rules.html_class(h).alias("class")
    )


@query("A29 H27")
def h_html_to_text(spark, sf_dir):
    from ..sources.documents import html_to_text, unescaped

    p = table(spark, sf_dir, "pages").withColumn("t", html_to_text("html"))
    return p.select("page_id", F.col("t.text").alias("text"), F.size("t.links").alias("n_links"), unescaped(text.tag_text(F.col("html"), "title")).alias("title"))


@query(
    "H29-H32 H35 J17 J18",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ': ' || p_brand || '/' || p_type, '[\\/:*?"<>|]+', '_', 'g'), '\s+', ' ', 'g')) AS file_name, CASE WHEN p_size > 25 THEN '''=' || p_name ELSE p_name END AS cell,
        replace(replace('<' || p_name || ' & ' || p_brand || '>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS escaped, concat_ws('; ', NULLIF(p_name, ''), NULLIF(p_type, 'SMALL'), p_brand) AS description FROM part""",
)
def h_names_and_cells(spark, sf_dir):
    name = F.concat("p_name", F.lit(": "), "p_brand", F.lit("/"), "p_type")
    cell = F.when(F.col("p_size") > 25, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.file_name(name).alias("file_name"),
        text.cell_value(cell).alias("cell"),
        text.escaped(F.concat(F.lit("<"), "p_name", F.lit(" & "), "p_brand", F.lit(">"))).alias("escaped"),
        text.joined("; ", F.col("p_name"), F.nullif(F.col("p_type"), F.lit("SMALL")), F.col("p_brand")).alias("description"),
    )


@query(
    "H43 H44 A39",
    r"""SELECT conv_id, turn, substr(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), lambda l: l <> ''), chr(10)), 1, 2000) AS comment FROM conversations""",
)
def h_comments(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.comment(F.col("text")).alias("comment"))


@query(
    "I01 I03 I19 I20 I21 I23",
    r"""SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END || ' 23:59:59' AS TIMESTAMP) AS deadline, greatest(0, COALESCE(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(user_id - 20 AS VARCHAR) END AS INTEGER), 0)) AS whole,
        event_type IN ('click', 'view') AS truth FROM events""",
)
def i_lenient_casts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 3 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    number = F.when(F.col("event_id") % 4 == 0, F.lit("x")).otherwise((F.col("user_id") - 20).cast("string"))
    said = F.when(F.col("event_type") == "click", F.lit(" Yes ")).when(F.col("event_type") == "view", F.lit("1")).otherwise(F.col("event_type"))
    return e.select("event_id", dates.deadline(day).cast("timestamp_ntz").alias("deadline"), dates.whole(number).alias("whole"), dates.truth(said).alias("truth"))


@query(
    "I05-I11 I24 I25",
    f"""SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - epoch_us({NOW_SQL})) / 86400e6) AS BIGINT) AS days_left, epoch_us(o_orderdate) / 86400e6 + 25569 AS serial, COALESCE((epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 1e6 <= 864000, FALSE) AS fresh,
        COALESCE((epoch_us({NOW_SQL}) - epoch_us(o_orderdate)) / 1e6 < 3600, TRUE) AS cooling, greatest(0.0, (epoch_us(o_orderdate) - epoch_us({NOW_SQL})) / 1e6) AS seconds_until,
        CASE WHEN o_orderdate < {NOW_SQL} THEN 'expired' WHEN epoch_us(o_orderdate) - epoch_us({NOW_SQL}) < 86400e6 THEN CAST(CAST(floor((epoch_us(o_orderdate) - epoch_us({NOW_SQL})) / 3600e6) AS BIGINT) AS VARCHAR) || ' h' ELSE CAST(CAST(floor((epoch_us(o_orderdate) - epoch_us({NOW_SQL})) / 86400e6) AS BIGINT) AS VARCHAR) || ' d' END AS left_text FROM orders""",
)
def i_ages(spark, sf_dir):
    at, now = F.col("o_orderdate"), ntz(NOW)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.days_left(at, now).alias("days_left"),
        dates.serial_day(at).alias("serial"),
        dates.fresh(at, now, 864000).alias("fresh"),
        dates.cooling(at, now, 3600).alias("cooling"),
        dates.seconds_until(at, now).alias("seconds_until"),
        dates.left_text(at, now).alias("left_text"),
    )


@query(
    "I02 I04 I22",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 23 HOUR + INTERVAL 59 MINUTE ELSE o_orderdate + INTERVAL 9 HOUR + INTERVAL 30 MINUTE END AS found, o_orderkey % 2 = 1 AS has_time, CAST(o_orderdate AS DATE) AS short FROM orders""",
)
def i_dates_in_text(spark, sf_dir):
    day = F.col("o_orderdate")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("until "), F.date_format(day, "dd.MM.yyyy"), F.lit(" at noon"))).otherwise(F.concat(F.lit("by "), F.date_format(day, "yyyy-MM-dd"), F.lit(" 09:30 or 01.01.2030")))
    at, has_time = dates.first_date(said)
    short = F.when(F.year(day) >= 2000, F.date_format(day, "d.M.yy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.cast("timestamp_ntz").alias("found"), has_time.alias("has_time"), dates.short_date(short).alias("short"))


@query(
    "I12 I13 I17",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', ' ') AS money FROM orders""",
)
def i_decimals_and_money(spark, sf_dir):
    said = F.replace(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.decimal(said).cast("double").alias("price"), dates.money(F.col("o_totalprice")).alias("money"))


@query(
    "I18 L05 L10",
    """WITH a AS (SELECT event_id, CAST(event_id % 9 + 1 AS INTEGER) AS n FROM events) SELECT event_id, least(3600.0, 30.0 * pow(2.0, n - 1)) + CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR) || ':' || CAST(n AS VARCHAR)), 1, 4)) AS BIGINT) % 16 AS wait, CASE WHEN n >= 2 THEN 'failed' ELSE 'retry' END AS state FROM a""",
)
def i_backoff(spark, sf_dir):
    from ..operators import ledger

    n = (F.col("event_id") % 9 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", ledger.backoff_seconds(n, F.col("event_id").cast("string")).alias("wait"), ledger.attempts_state(n).alias("state"))


@query("I26", "SELECT user_id, COALESCE(MAX(CASE WHEN event_type = 'purchase' THEN 'a' END), MAX(CASE WHEN event_type = 'signup' THEN 'b' END), 'default') AS setting FROM events GROUP BY 1")
def i_precedence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    by = lambda kind, value: F.max(F.when(F.col("event_type") == kind, F.lit(value)))
    return e.groupBy("user_id").agg(dates.first_set(by("purchase", "a"), by("signup", "b"), F.lit("default")).alias("setting"))


@query(
    "J01 J03 J09 J11 J12 J25",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"id":' || CAST(event_id AS VARCHAR) || ',"type":"' || event_type || '"}' AS built, props AS outer_object, props AS as_object FROM events""",
)
def j_paths_and_objects(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        jsonx.int_at(jsonx.envelope(p), "$.k").alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("built"),
        jsonx.outer_object(F.concat(F.lit("Answer: "), p, F.lit(" end"))).alias("outer_object"),
        jsonx.as_object(p).alias("as_object"),
    )


@query(
    "J04-J08 J19 J28 J29 M01",
    r"""WITH d AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'api_key' ELSE 'name' END AS name, props FROM events), j AS (SELECT event_id, name, '{"b": [1, {"' || name || '": ' || props || '}], "a": 1.50}' AS deep, '{"a":1.5,"b":[1,{"' || name || '":' || replace(props, ' ', '') || '}]}' AS canonical FROM d)
        SELECT event_id, ANY_VALUE(regexp_matches(deep, '(?i)"[^"]*(password|passwd|secret|token|api_?key|authorization|credential)[^"]*"\s*:')) AS likely, bool_or(COALESCE(regexp_matches(key, '(^|_)(password|passwd|secret|token|api_?key|authorization|credential)(_|$)'), FALSE)) AS secret,
        string_agg(CAST(atom AS VARCHAR), ' ' ORDER BY id) FILTER (atom IS NOT NULL) AS corpus, ANY_VALUE(canonical) AS canonical, CAST(MAX(length(regexp_replace(fullkey, '[^.\[]', '', 'g'))) + 1 AS INTEGER) AS depth, CAST(COUNT(*) AS INTEGER) AS nodes FROM j, json_tree(deep) GROUP BY event_id""",
)
def j_recursive_search(spark, sf_dir):
    deep = F.concat(F.lit('{"b": [1, {"'), F.when(F.col("event_id") % 2 == 0, F.lit("api_key")).otherwise(F.lit("name")), F.lit('": '), "props", F.lit('}], "a": 1.50}'))
    e = table(spark, sf_dir, "events").select("event_id", deep.alias("deep"))
    return e.select("event_id", jsonx.secret_key_likely(F.col("deep")).alias("likely"), jsonx.searched(30000)("deep").alias("found")).select("event_id", "likely", "found.*")


@query(
    "J20-J22 J29 J30 A06 A19",
    """SELECT doc_id, sha256(text) AS sha, sha256('["' || CAST(doc_id AS VARCHAR) || '","' || source || '",' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ']') AS fingerprint, length(text) AS chars FROM documents""",
)
def j_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", jsonx.digest(F.col("text")).alias("sha"), jsonx.fingerprint(F.col("doc_id"), F.col("source"), F.col("lang")).alias("fingerprint"), F.length("text").cast("long").alias("chars"))


@query(
    "J13-J16 J26 J27",
    """WITH t AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, CASE WHEN k >= 70 THEN 'go' WHEN k >= 30 THEN 'maybe' ELSE 'no_go' END AS decision, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN k IS NULL THEN 'k_missing' END, CASE WHEN value > 100 THEN 'value_range' END, CASE WHEN event_type = 'error' THEN 'type' END], lambda x: x IS NOT NULL))), ',') AS broken FROM t""",
)
def j_structured_output(spark, sf_dir):
    k = jsonx.int_at(F.col("props"), "$.k")
    broken = cascade.all_matches([("k_missing", k.isNull()), ("value_range", F.col("value") > 100), ("type", F.col("event_type") == "error")])
    return table(spark, sf_dir, "events").select("event_id", cascade.first_match([("go", k >= 70), ("maybe", k >= 30)], "no_go").alias("decision"), F.array_join(F.array_sort(F.array_distinct(broken)), ",").alias("broken"))


@query("J17 J18 J23 J24", "SELECT conv_id, array_to_string(list_distinct(list(role ORDER BY turn)).list_sort(), ';') AS roles, length(MAX(text) FILTER (turn = 1)) AS second FROM conversations GROUP BY 1")
def j_arrays(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    roles = text.distinct_ignoring_case(F.transform("a", lambda x: F.concat(F.lit(" "), x["role"])), 10)
    return c.select("conv_id", F.array_join(F.array_sort(roles), ";").alias("roles"), F.length(jsonx.by_id(F.col("a"), "turn", F.lit(1))["text"]).cast("long").alias("second"))
