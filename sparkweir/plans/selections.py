"""Queries over filters, cascades, orders and pages (orders as tenders, events as an operation log)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import cascade, quality, ranking, rules
from .registry import query, table

#: `now` of the queries over orders and over events, whose times lie in the past.
NOW, EVENTS_NOW = dt.datetime(2000, 1, 15, 12), dt.datetime(2024, 1, 20)
NOW_SQL, EVENTS_NOW_SQL = "TIMESTAMP '2000-01-15 12:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"


def ntz(moment):
    return F.lit(moment).cast("timestamp_ntz")


@query(
    "B01 B03 J10 H36",
    """SELECT o_orderkey AS tender_id, COALESCE(o_orderstatus, 'unknown') AS status, COALESCE(c_name, 'no customer') AS customer_name,
       COALESCE(CAST(NULLIF(o_totalprice, 0) AS DOUBLE), -1) AS price, o_orderpriority AS priority, COALESCE(o_orderdate, TIMESTAMP '1970-01-01') AS published_at, c_mktsegment AS segment
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE COALESCE(o_orderdate, TIMESTAMP '1970-01-01') >= TIMESTAMP '2001-01-01'""",
)
def b_wide_projection(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    published = F.coalesce("o_orderdate", ntz(dt.datetime(1970, 1, 1)))
    return (
        o.where(published >= ntz(dt.datetime(2001, 1, 1)))
        .join(c, o.o_custkey == c.c_custkey, "left")
        .select(
            F.col("o_orderkey").alias("tender_id"),
            F.coalesce("o_orderstatus", F.lit("unknown")).alias("status"),
            F.coalesce("c_name", F.lit("no customer")).alias("customer_name"),
            F.coalesce(text.truthy(F.col("o_totalprice"), "number"), F.lit(-1.0)).alias("price"),
            F.col("o_orderpriority").alias("priority"),
            published.alias("published_at"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


@query(
    "B02 B04 B05 B07 B08 B12 B13 B14",
    f"""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate >= {NOW_SQL} AS active, o_orderdate < {NOW_SQL} + INTERVAL 3 DAY AS needs_warning FROM orders
        WHERE o_orderdate >= {NOW_SQL} - INTERVAL 30 DAY AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-03-01'
        AND (o_totalprice IS NULL OR o_totalprice >= 100000) AND o_orderstatus IN ('O', 'P') AND (o_orderpriority LIKE '1%' OR o_orderpriority = '5-LOW')""",
)
def b_conjunctive_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    conditions = [
        at >= ntz(NOW - dt.timedelta(days=30)),
        (at >= ntz(dt.datetime(2000, 1, 1))) & (at < ntz(dt.datetime(2000, 3, 1))),
        cascade.null_or(F.col("o_totalprice"), F.col("o_totalprice") >= 100000),
        F.col("o_orderstatus").isin("O", "P"),
        F.col("o_orderpriority").startswith("1") | (F.col("o_orderpriority") == "5-LOW"),
    ]
    return o.where(cascade.every(conditions)).select("o_orderkey", "o_orderstatus", "o_totalprice", (at >= ntz(NOW)).alias("active"), (at < ntz(NOW + dt.timedelta(days=3))).alias("needs_warning"))


@query(
    "B06 J01 J25 B16",
    "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('7', '9', '99') OR json_extract_string(props, '$.report.k') = '7'",
)
def b_json_disjunction(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = lambda path: F.get_json_object("props", path)
    return e.where(cascade.any_of([at("$.k").isin("7", "9", "99"), at("$.report.k") == "7"])).select("event_id", "event_type", at("$.k").try_cast("int").alias("k"))


@query(
    "B10 B11",
    """SELECT event_id, CAST(ts AS DATE) AS utc_day FROM events WHERE ts >= TIMESTAMP '2024-01-09 21:00:00' AND ts < TIMESTAMP '2024-01-10 21:00:00'""",
)
def b_day_in_zone(spark, sf_dir):
    first, after = dates.day_bounds(F.lit(dt.datetime(2024, 1, 10, 8)).cast("timestamp_ntz").cast("timestamp"), "Europe/Moscow")
    e = table(spark, sf_dir, "events")
    at = F.col("ts")
    return e.where((at >= first.cast("timestamp_ntz")) & (at < after.cast("timestamp_ntz"))).select("event_id", F.to_date("ts").alias("utc_day"))


@query(
    "B09 B29 B30 H33 H34",
    r"""SELECT page_id, regexp_matches(lower(url), '(^|[^a-z0-9])(fr|de)([^a-z0-9]|$)') AS language_word,
        regexp_matches(url, '^https?://[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}(:\d+)?(/|\?|$)') AS public_host,
        regexp_matches(url, '^https://([a-z0-9-]+\.)*example\.com(:\d+)?(/|\?|$)') AS allowed,
        COALESCE(NULLIF(regexp_extract(url, '[?&]ref=([^&]*)', 1), ''), NULLIF(regexp_extract(url, '[?&]page=([^&]*)', 1), ''), 'none') AS first_parameter,
        CASE WHEN contains(url, '/fr/') THEN 'fr' WHEN contains(url, '/de/') THEN 'de' ELSE 'other' END AS inferred FROM pages""",
)
def b_url_guards(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        cascade.any_of([text.whole_word(F.lower(url), w) for w in ("fr", "de")]).alias("language_word"),
        text.public_host(url).alias("public_host"),
        text.host_allowed(url, ["example.com"]).alias("allowed"),
        F.coalesce(text.first_filled(F.regexp_extract(url, "[?&]ref=([^&]*)", 1), F.regexp_extract(url, "[?&]page=([^&]*)", 1)), F.lit("none")).alias("first_parameter"),
        cascade.first_match([("fr", F.contains(url, F.lit("/fr/"))), ("de", F.contains(url, F.lit("/de/")))], "other").alias("inferred"),
    )


def hidden_rules():
    at = F.col("o_orderdate")
    return [
        ("expired", at < ntz(NOW)),
        ("cheap", F.col("o_totalprice") < 50000),
        ("closed", F.col("o_orderstatus") == "F"),
        ("low_priority", F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED")),
    ]


_HIDDEN_SQL = f"CASE WHEN o_orderdate < {NOW_SQL} THEN 'expired' WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'low_priority' END"


@query("B17 B18 B25 B26 B27 B31 B36 D29", f"SELECT o_orderkey, {_HIDDEN_SQL} AS reason, CASE WHEN {_HIDDEN_SQL} IS NULL THEN 'shown' ELSE 'hidden' END AS status FROM orders")
def b_reason_cascade(spark, sf_dir):
    reason = cascade.first_match(hidden_rules())
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"), F.when(reason.isNull(), F.lit("shown")).otherwise(F.lit("hidden")).alias("status"))


_SHOWN_SQL = f"""SELECT o_orderkey, o_totalprice, CASE WHEN h IS NOT NULL THEN h WHEN rn > 50 THEN 'over_limit' END AS hidden_reason FROM (
    SELECT *, row_number() OVER (PARTITION BY h ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM (SELECT *, {_HIDDEN_SQL} AS h FROM orders))"""


@query("B19 B28 B32 B33 F08", _SHOWN_SQL)
def b_all_rows_with_reason(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return cascade.shown_or_hidden(o, cascade.first_match(hidden_rules()), order, 50).select("o_orderkey", "o_totalprice", "hidden_reason")


@query("D24 D25 D26 D27 D30 D21", f"SELECT COALESCE(hidden_reason, 'shown') AS reason, COUNT(*) AS n FROM ({_SHOWN_SQL}) GROUP BY 1")
def d_selection_stats(spark, sf_dir):
    return cascade.reason_counts(b_all_rows_with_reason(spark, sf_dir))


@query(
    "B20 B21 B22 B23 B24 B35 B37 B38",
    """WITH f AS (SELECT user_id, arg_max(event_type, event_id) FILTER (event_type IN ('click', 'error')) AS feedback, MAX(ts) FILTER (event_type = 'purchase') AS report_at, MAX(ts) FILTER (event_type = 'view') AS triage_at,
        MAX(ts) FILTER (event_type = 'signup') AS positive_at FROM events GROUP BY user_id)
        SELECT user_id, feedback, COALESCE(feedback = 'error', FALSE) AND NOT COALESCE(positive_at > triage_at, FALSE) AS hidden_by_feedback,
        CASE WHEN report_at IS NULL THEN 'waits' WHEN COALESCE(report_at >= triage_at, TRUE) THEN 'show_report' WHEN COALESCE(positive_at > triage_at, FALSE) THEN 'show_overridden' ELSE 'hide' END AS decision FROM f""",
)
def b_queue_decisions(spark, sf_dir):
    kind = F.col("event_type")
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", F.when(kind.isin("click", "error"), F.col("event_id"))).alias("feedback"),
        *[F.max(F.when(kind == k, F.col("ts"))).alias(name) for k, name in (("purchase", "report_at"), ("view", "triage_at"), ("signup", "positive_at"))],
    )
    overridden = dates.after(F.col("positive_at"), F.col("triage_at"))
    decision = cascade.first_match(
        [("waits", F.col("report_at").isNull()), ("show_report", dates.not_before(F.col("report_at"), F.col("triage_at"))), ("show_overridden", overridden)],
        "hide",
    )
    return f.select("user_id", "feedback", (F.coalesce(F.col("feedback") == "error", F.lit(False)) & ~overridden).alias("hidden_by_feedback"), decision.alias("decision"))


@query(
    "B15 B34 B39 K46 K47 L04",
    f"""WITH s AS (SELECT user_id, COUNT(*) FILTER (event_type = 'error') AS errors, MAX(ts) FILTER (event_type = 'error') AS last_error, MAX(ts) AS last_seen FROM events WHERE ts < {EVENTS_NOW_SQL} GROUP BY user_id)
        SELECT user_id, errors, CASE WHEN last_seen < {EVENTS_NOW_SQL} - INTERVAL 12 HOUR THEN 'expired' WHEN errors >= 12 THEN 'exhausted' WHEN errors > 0 AND last_error > {EVENTS_NOW_SQL} - INTERVAL 2 DAY THEN 'blocked' END AS skip_reason FROM s""",
)
def b_preparation_skip(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") < ntz(EVENTS_NOW))
    error = F.col("event_type") == "error"
    s = e.groupBy("user_id").agg(F.count_if(error).alias("errors"), F.max(F.when(error, F.col("ts"))).alias("last_error"), F.max("ts").alias("last_seen"))
    row = {
        "expired": F.col("last_seen") < ntz(EVENTS_NOW - dt.timedelta(hours=12)),
        "soon": F.lit(False),
        "rejected": F.lit(False),
        "exhausted": F.col("errors") >= 12,
        "blocked": F.col("errors") > 0,
        "cooling": dates.cooling(F.col("last_error"), ntz(EVENTS_NOW), 2 * 86400),
        "has_report": F.lit(False),
    }
    return s.select("user_id", "errors", rules.skip_reason(row).alias("skip_reason"))


@query(
    "F01 E01-E04 D02",
    "SELECT o_orderkey, o_totalprice, o_orderdate, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS FIRST, o_orderdate ASC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10",
)
def f_sorted_page_with_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    order = [F.col("o_totalprice").desc_nulls_first(), F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey").asc()]
    rows = ranking.top(o, order, 25, 10)
    return rows.join(F.broadcast(o.agg(F.count("*").alias("total")))).select("o_orderkey", "o_totalprice", "o_orderdate", "total")


@query(
    "F02-F07 F09 F10 F17 F19",
    """SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END,
       CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, COALESCE(CAST(o_orderdate AS VARCHAR), '9999'), o_orderkey LIMIT 100""",
)
def f_composite_rank(spark, sf_dir):
    order = [
        ranking.rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).asc(),
        ranking.rank_of(F.col("o_orderstatus"), ["O", "P"]).asc(),
        F.col("o_totalprice").desc(),
        F.coalesce(F.col("o_orderdate").cast("string"), F.lit("9999")).asc(),
        F.col("o_orderkey").asc(),
    ]
    return ranking.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"), order, 100).drop("o_orderdate")


@query(
    "F15 F20 F21",
    "SELECT event_id, event_type, ts, CASE WHEN (SELECT COUNT(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15') > 60 THEN CAST(60 AS BIGINT) END AS next_offset FROM events WHERE ts >= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 20 OFFSET 40",
)
def f_page_with_next_offset(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") >= ntz(dt.datetime(2024, 1, 15))).select("event_id", "event_type", "ts")
    return ranking.page(e, [F.col("ts").asc(), F.col("event_id").asc()], 40, 20)


@query(
    "F11 F12 F14",
    """WITH t AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS r FROM conversations),
       s AS (SELECT conv_id, list(role || ':' || CAST(turn AS VARCHAR) ORDER BY r, turn) AS l FROM t GROUP BY conv_id) SELECT conv_id, array_to_string(l[1:3], ';') AS first_three FROM s""",
)
def f_sorted_arrays(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rank = ranking.rank_of(F.col("role"), ["system", "assistant"])
    packed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "turn", "role"))).alias("a"))
    return packed.select("conv_id", F.array_join(F.transform(F.slice("a", 1, 3), lambda x: F.concat_ws(":", x["role"], x["turn"].cast("string"))), ";").alias("first_three"))


@query(
    "F13 G05",
    """WITH a AS (SELECT o_custkey AS id, MIN(o_orderkey) AS p, 0 AS l FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1), b AS (SELECT o_custkey AS id, MIN(o_orderkey) AS p, 1 AS l FROM orders WHERE o_totalprice > 450000 GROUP BY 1),
       u AS (SELECT * FROM a UNION ALL SELECT * FROM b), m AS (SELECT id, MIN(l) AS l, arg_min(p, (l, p)) AS p FROM u GROUP BY id) SELECT id, CAST(l AS INTEGER) AS list, p AS position FROM m ORDER BY l, p, id LIMIT 60""",
)
def f_merged_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda condition: o.where(condition).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("position"))
    return ranking.merged_lists([part("o_orderpriority = '1-URGENT' AND o_totalprice > 400000"), part("o_totalprice > 450000")], "id", "position", 60)


@query(
    "F16 F24 A50",
    "SELECT doc_id, o AS page_offset, substr(text, CAST(o AS BIGINT) + 1, 1000) AS page FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS o FROM documents)",
)
def f_text_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pages = d.select("doc_id", F.inline(ranking.text_pages(F.col("text"), 1000)))
    return pages.select("doc_id", F.col("offset").cast("long").alias("page_offset"), "page")


@query(
    "F18",
    """WITH RECURSIVE r AS (SELECT conv_id, turn, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) AS i FROM conversations),
       p AS (SELECT *, 0 AS bin, chars AS used FROM r WHERE i = 1
             UNION ALL SELECT r.*, CASE WHEN used > 0 AND used + r.chars > 1500 THEN bin + 1 ELSE bin END, CASE WHEN used > 0 AND used + r.chars > 1500 THEN r.chars ELSE used + r.chars END FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1)
       SELECT conv_id, turn, role, CAST(chars AS INTEGER) AS chars, bin FROM p""",
)
def f_packed_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return ranking.packed(c.select("conv_id", "turn", "role", F.length("text").alias("chars")), ["conv_id"], ["turn"], F.col("chars"), 1500)


@query(
    "F22 F23",
    """WITH r AS (SELECT c_nationkey, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS l FROM customer GROUP BY 1), b AS (SELECT c_nationkey, list_concat(l, ['HOUSE', 'AUTO']) AS l FROM r)
       SELECT c_nationkey, array_to_string(list_filter(l, lambda x: len(list_filter(l, lambda y: y <> x AND contains(y, x))) = 0)[1:4], ',') AS roles FROM b""",
)
def f_specific_roles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    roles = c.groupBy("c_nationkey").agg(F.concat(F.array_sort(F.collect_set("c_mktsegment")), F.array(F.lit("HOUSE"), F.lit("AUTO"))).alias("l"))
    return roles.select("c_nationkey", F.array_join(text.more_specific(F.col("l")), ",").alias("roles"))


@query(
    "I14 D08 D12 D13 D09",
    """WITH b AS (SELECT CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 'unknown' WHEN o_totalprice < 30000 THEN '<30k' WHEN o_totalprice < 100000 THEN '30k-100k' WHEN o_totalprice < 300000 THEN '100k-300k' ELSE '300k+' END AS group_key, o_orderstatus FROM orders),
       q AS (SELECT group_key, COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'F') AS positive, COUNT(*) FILTER (o_orderstatus = 'O') AS negative FROM b GROUP BY 1)
       SELECT *, round(positive / CAST(positive + negative AS DOUBLE), 4) AS positive_rate, n >= 3 OR (n >= 2 AND positive / CAST(n AS DOUBLE) >= 0.4) AS enough, CASE WHEN positive < negative THEN 'raise_limit' ELSE 'keep' END AS advice FROM q""",
)
def d_price_band_quality(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    band = quality.price_band(F.col("o_totalprice"), [30000, 100000, 300000], ["<30k", "30k-100k", "100k-300k", "300k+"])
    q = quality.quality_table(o, band, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    n = F.col("n")
    return q.withColumn("enough", (n >= 3) | ((n >= 2) & (F.col("positive") / n >= 0.4))).withColumn("advice", F.when(F.col("positive") < F.col("negative"), F.lit("raise_limit")).otherwise(F.lit("keep")))


@query("E09 E05 E06", "SELECT *, row_number() OVER (ORDER BY n DESC, c_custkey) AS number FROM (SELECT o_custkey AS c_custkey, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, c_custkey LIMIT 40)")
def e_numbered_export(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("c_custkey").asc()]
    return cascade.numbered(ranking.top(o, order, 40), order).withColumn("number", F.col("number").cast("long"))
