"""Queries over joins, latest rows and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, latest, matching, quality, rules
from .registry import query, table
from .selections import EVENTS_NOW, EVENTS_NOW_SQL, ntz


def by_time():
    return [F.col("ts").desc_nulls_first(), F.col("event_id").desc()]


@query(
    "C01 C12 C45",
    """SELECT n_name, c_mktsegment, COUNT(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def c_star_join(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    per_customer = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    joined = per_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("n_orders"), F.sum("s").cast("double").alias("revenue"))


@query(
    "C02 C30 C43 E11",
    """WITH l AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS rn FROM events WHERE event_type = 'purchase')
       SELECT c_custkey, c_name, event_id AS last_purchase, ts AS purchased_at FROM customer LEFT JOIN l ON c_custkey = user_id AND rn = 1""",
)
def c_latest_left(spark, sf_dir):
    c, e = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    last = latest.latest(e.where("event_type = 'purchase'"), ["user_id"], by_time())
    return c.join(last, c.c_custkey == last.user_id, "left").select("c_custkey", "c_name", F.col("event_id").alias("last_purchase"), F.col("ts").alias("purchased_at"))


@query(
    "C03 C38",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS rn FROM events WHERE event_type IN ('purchase', 'signup') AND value > 50) WHERE rn = 1""",
)
def c_filter_then_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup") & (F.col("value") > 50))
    return latest.latest(e, ["user_id"], by_time()).select("user_id", "event_id", "event_type", "value")


@query(
    "C04",
    """WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS report, MAX(ts) FILTER (event_type = 'purchase') AS report_at, MAX(ts) FILTER (event_type = 'view') AS triage_at,
       arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS triage_value FROM events GROUP BY user_id) SELECT user_id, report, triage_value FROM l WHERE report IS NOT NULL AND (triage_at IS NULL OR report_at > triage_at) AND COALESCE(triage_value, 0) < 100""",
)
def c_latest_then_filter(spark, sf_dir):
    kind = F.col("event_type")
    l = latest.latest_of_kinds(table(spark, sf_dir, "events"), ["user_id"], {"report": kind == "purchase", "triage": kind == "view"}, ["ts", "event_id"], ["event_id", "ts", "value"])
    report, triage = F.col("report"), F.col("triage")
    kept = report.isNotNull() & (triage.isNull() | (report["ts"] > triage["ts"])) & (F.coalesce(triage["value"], F.lit(0.0)) < 100)
    return l.where(kept).select("user_id", report["event_id"].alias("report"), triage["value"].alias("triage_value"))


@query(
    "C02 C06 C15 E12",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'signup') AS signup, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS error,
       arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view') AS view, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id""",
)
def c_fused_latest(spark, sf_dir):
    kinds = ("purchase", "signup", "error", "view", "click")
    l = latest.latest_of_kinds(table(spark, sf_dir, "events"), ["user_id"], {k: F.col("event_type") == k for k in kinds}, ["ts", "event_id"], ["event_id"])
    return l.select("user_id", *[F.col(k)["event_id"].alias(k) for k in kinds])


@query("C05 C14", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def c_fan_out_left(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query(
    "C07 H01-H03",
    """WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name, p_size, p_retailprice FROM part), l AS (SELECT name, arg_max(p_partkey, (p_size, p_partkey)) AS newest, COUNT(*) AS n FROM k GROUP BY name)
       SELECT p_partkey, k.name, newest, n FROM k JOIN l ON k.name = l.name""".replace("\\\\", "\\"),
)
def c_self_join_on_normal_name(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.collapsed(F.col("p_name")).alias("name"), "p_size")
    newest = p.groupBy("name").agg(F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("newest"), F.count("*").alias("n"))
    return p.join(newest, "name").select("p_partkey", "name", "newest", "n")


@query(
    "C08 C09 D01 D35",
    """SELECT o_orderkey, COALESCE(n, 0) AS n_lines, COALESCE(returned, 0) AS n_returned, last_ship FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, COUNT(*) FILTER (l_returnflag = 'R') AS returned, MAX(l_shipdate) FILTER (l_linestatus = 'F') AS last_ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def c_aggregate_left(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").select(F.col("o_orderkey")), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.aggregate_left(
        o, l, ["o_orderkey"], {"n_lines": 0, "n_returned": 0}, F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("last_ship")
    )


@query(
    "C10 C21 C46 D39 J24",
    "SELECT conv_id, array_to_string(list(role || '/' || CAST(length(text) AS VARCHAR) ORDER BY turn), ';') AS turns FROM conversations GROUP BY conv_id",
)
def c_nested_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    n = joins.nested(c, ["conv_id"], ["turn"], ["turn", "role", "chars"], "turns")
    return n.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat_ws("/", t["role"], t["chars"].cast("string"))), ";").alias("turns"))


@query(
    "C11 D07 C41 C42",
    """SELECT COALESCE(NULLIF(source, 'src0'), CAST(doc_id % 7 AS VARCHAR)) AS key, COUNT(*) AS n, COUNT(DISTINCT lang) AS n_lang FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1""",
)
def c_orphans_with_fallback_key(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", "left")
    key = F.coalesce(F.nullif(F.col("source"), F.lit("src0")), (F.col("doc_id") % 7).cast("string"))
    return j.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_lang"))


@query("C13", "SELECT e.event_id, e.user_id, c_name FROM events e LEFT JOIN customer ON user_id = c_custkey WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-25'")
def c_events_with_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup") & (F.col("ts") >= ntz(dt.datetime(2024, 1, 25))))
    c = table(spark, sf_dir, "customer")
    return e.join(c, e.user_id == c.c_custkey, "left").select("event_id", "user_id", "c_name")


@query("C17 A13 A14 L18", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def c_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.present(table(spark, sf_dir, "customer"), o, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "C18 C19 C20 C22",
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS action FROM events GROUP BY user_id)
       SELECT c_custkey FROM customer LEFT JOIN l ON c_custkey = user_id WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND COALESCE(action, '') <> 'error'""",
)
def c_anti_with_latest_answer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("action"))
    left = joins.absent(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"])
    return left.join(last, "c_custkey", "left").where(F.coalesce("action", F.lit("")) != "error").select("c_custkey")


@query(
    "C23 I24",
    f"""SELECT s.event_id, s.user_id FROM events s WHERE s.event_type = 'error' AND s.ts >= {EVENTS_NOW_SQL} AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = s.user_id AND e.ts >= s.ts)""",
)
def c_temporal_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    starts = e.where((F.col("event_type") == "error") & (F.col("ts") >= ntz(EVENTS_NOW)))
    return joins.without_later(starts, e.where("event_type = 'purchase'"), "user_id", "ts").select("event_id", "user_id")


@query("C24", "SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_nationkey OR p_partkey = s_suppkey")
def c_either_key(spark, sf_dir):
    p, s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size")), table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"))
    return joins.either_key(p, s, [("size", "nation"), ("p_partkey", "s_suppkey")], "p_partkey").select("p_partkey", "s_suppkey")


@query("C25 G07", "SELECT COUNT(*) AS n_cases, COUNT(*) FILTER (d.doc_id IS NULL) AS n_unknown FROM labels l LEFT JOIN documents d USING (doc_id)")
def c_gold_to_rows(spark, sf_dir):
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("found"))
    return l.join(d, "doc_id", "left").agg(F.count("*").alias("n_cases"), F.count_if(F.col("found").isNull()).alias("n_unknown"))


RULES = [("greeting", ["the the", "der die"]), ("plural", ["ing the", "und der", "de la"]), ("marks", ["!!", "$$$", "***"])]


@query(
    "C26 K53",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'the the') OR contains(lower(text), 'der die') THEN 'greeting' WHEN contains(lower(text), 'ing the') OR contains(lower(text), 'und der') OR contains(lower(text), 'de la') THEN 'plural'
       WHEN contains(lower(text), '!!') OR contains(lower(text), '$$$') OR contains(lower(text), '***') THEN 'marks' END AS rule FROM documents""",
)
def c_rows_to_rules(spark, sf_dir):
    return joins.match_rules(table(spark, sf_dir, "documents"), "text", RULES).select("doc_id", "rule")


@query(
    "C27",
    """WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a FROM lineitem), r AS (SELECT *, a + 5 + l_linenumber * 7 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, a + l_linenumber * 7, l_linenumber) AS i FROM s),
       p AS (SELECT *, a AS la, b AS lb, TRUE AS kept FROM r WHERE i = 1
             UNION ALL SELECT x.*, CASE WHEN apart THEN x.a ELSE la END, CASE WHEN apart THEN x.b ELSE lb END, apart FROM (SELECT r, la, lb, least(r.b, lb) - greatest(r.a, la) < CAST(0.55 AS DOUBLE) * least(r.b - r.a, lb - la) AS apart FROM p JOIN r ON r.l_orderkey = p.l_orderkey AND r.i = p.i + 1) q, (SELECT unnest(q.r)) x)
       SELECT l_orderkey, l_linenumber, CAST(a AS INTEGER) AS start, b AS "end" FROM p WHERE kept""",
)
def c_span_suppression(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.unix_date(F.to_date("l_shipdate")).alias("start"))
    spans = l.withColumn("end", F.col("start") + 5 + F.col("l_linenumber") * 7)
    return joins.overlapping(spans, ["l_orderkey"], "start", "end", 0.55)


#: Of a page: its site, language and number as its address has them.
PAGES_SQL = """p AS (SELECT page_id, url, regexp_extract(url, '([^./]+[.][a-z]+)/[a-z]+/[0-9]+', 1) AS site, regexp_extract(url, '/([a-z]+)/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) AS num, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"""


def _pages(spark, sf_dir):
    part = lambda pattern, n: F.regexp_extract("url", pattern, n)
    return table(spark, sf_dir, "pages").select("page_id", "url", part("([^./]+[.][a-z]+)/[a-z]+/[0-9]+", 1).alias("site"), part("/([a-z]+)/([0-9]+)", 1).alias("lang"), part("/([a-z]+)/([0-9]+)", 2).alias("num"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(
    "C28",
    rf"""WITH {PAGES_SQL}, s AS (SELECT page_id AS stored_id, site, regexp_replace(url, '[?#].*$', '') AS url, num || CASE WHEN contains(url, '?') THEN '_' ELSE '.' END || lang || '.html' AS filename, 'store/' || lang || '/' || num || CASE WHEN contains(url, '#') THEN '_page' ELSE '' END || '/index.html' AS path FROM p),
        w AS (SELECT page_id AS wanted_id, site, num AS id, url, [title, lang || ' ' || num] AS names FROM p),
        c AS (SELECT stored_id, wanted_id, s.site, s.url AS su, w.url AS wu, filename, path, id, names FROM s JOIN w ON s.site = w.site),
        n AS (SELECT stored_id, wanted_id, trim(regexp_replace(regexp_replace(replace(lower(h), 'ё', 'е'), '\.[a-z0-9]{{1,8}}\b', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS h, trim(regexp_replace(regexp_replace(replace(lower(m), 'ё', 'е'), '\.[a-z0-9]{{1,8}}\b', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS m
              FROM (SELECT stored_id, wanted_id, h, unnest(names) AS m FROM (SELECT stored_id, wanted_id, unnest([filename, path]) AS h, names FROM c))),
        t AS (SELECT DISTINCT stored_id, wanted_id FROM n WHERE h <> '' AND m <> '' AND (contains(h, m) OR contains(m, h))),
        r AS (SELECT stored_id, wanted_id, CASE WHEN id <> '' AND su = wu THEN 1 WHEN id <> '' AND (starts_with(filename, id || '_') OR starts_with(filename, id || '-')) THEN 2 WHEN id <> '' AND contains(path, '/' || id || '_') THEN 3 WHEN t.stored_id IS NOT NULL THEN 4 END AS rule FROM c LEFT JOIN t USING (stored_id, wanted_id))
        SELECT stored_id, wanted_id, rule FROM r WHERE rule IS NOT NULL""",
)
def c_document_matches(spark, sf_dir):
    p = _pages(spark, sf_dir)
    mark = lambda sign, yes, no: F.when(F.contains("url", F.lit(sign)), F.lit(yes)).otherwise(F.lit(no))
    stored = p.select("site", F.col("page_id").alias("stored_id"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.concat("num", mark("?", "_", "."), "lang", F.lit(".html")).alias("filename"), F.concat(F.lit("store/"), "lang", F.lit("/"), "num", mark("#", "_page", ""), F.lit("/index.html")).alias("path"))
    wanted = p.select("site", F.col("page_id").alias("wanted_id"), F.col("num").alias("id"), "url", F.array("title", F.concat_ws(" ", "lang", "num")).alias("names"))
    return matching.document_matches(stored, wanted, "site")


@query(
    "C28",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM pages) SELECT DISTINCT a.page_id, b.page_id AS other FROM p a JOIN p b ON a.host = b.host AND a.page_id < b.page_id AND (contains(a.url, b.url) OR contains(b.url, a.url))""",
)
def c_addresses_within(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#:]+)", 1).alias("host"))
    return joins.contained(p, "page_id", "url", "host").select(F.least("outer", "inner").alias("page_id"), F.greatest("outer", "inner").alias("other")).distinct()


@query("C29 G03 G04", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-03' INTERSECT SELECT DISTINCT o_custkey FROM orders) EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-02'")
def c_recipients(spark, sf_dir):
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    signed = e.where((F.col("event_type") == "signup") & (F.col("ts") < ntz(dt.datetime(2024, 1, 3)))).select("user_id").distinct()
    bad = e.where((F.col("event_type") == "error") & (F.col("ts") < ntz(dt.datetime(2024, 1, 2)))).select("user_id")
    return joins.absent(joins.present(signed, o.select(F.col("o_custkey").alias("user_id")), ["user_id"]), bad, ["user_id"])


@query("C16 F17", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def c_top_one(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size is not null").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(1).select("p_partkey", "p_name", "p_retailprice")


@query(
    "C44",
    "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE p_brand LIKE 'Brand#1%'",
)
def c_by_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1"))
    return p.select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")).cast("long").alias("place"))


@query(
    "E05 E06 A23",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role <> 'system') WHERE rn = 1",
)
def e_distinct_on(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return latest.latest(c, ["conv_id"], [F.col("turn").desc()]).select("conv_id", "turn", "role")


@query(
    "E07 D10 D28",
    """WITH s AS (SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT event_type) AS n_values, arg_min(event_type, (ts, event_id)) AS first_value, arg_max(event_type, (ts, event_id)) AS last_value FROM events GROUP BY user_id)
       SELECT first_value || '->' || last_value AS change, COUNT(*) AS n_users, COUNT(*) FILTER (n > 1) AS repeated, COUNT(*) FILTER (n_values > 1) AS changed FROM s GROUP BY 1""",
)
def e_first_and_last(spark, sf_dir):
    s = latest.first_and_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return s.groupBy(F.concat_ws("->", "first_value", "last_value").alias("change")).agg(F.count("*").alias("n_users"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n_values") > 1).alias("changed"))


@query(
    "E08 G01 E05",
    """SELECT c_nationkey, c_custkey, c_acctbal, first_position FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, c_acctbal DESC NULLS LAST, c_custkey) AS rn, MIN(c_custkey) OVER (PARTITION BY c_nationkey) AS first_position FROM customer) WHERE rn = 1""",
)
def e_preferred(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return latest.preferred(c, ["c_nationkey"], [(F.col("c_mktsegment") == "BUILDING").desc(), F.col("c_acctbal").desc_nulls_last()], "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal", "first_position")


@query(
    "E10 E14 E13",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events",
)
def e_carried_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return latest.carried_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase").select("event_id", "last_purchase")


@query(
    "E16 E17 A47",
    """SELECT conv_id, turn, before, substr(text, 1, CAST(greatest(0, least(length(text), 1000 - before)) AS BIGINT)) AS kept FROM (SELECT conv_id, turn, text, CAST(COALESCE(SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM conversations)""",
)
def e_running_budget(spark, sf_dir):
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(window), F.lit(0)).cast("long")
    c = table(spark, sf_dir, "conversations").withColumn("before", before)
    return c.select("conv_id", "turn", "before", F.substring("text", F.lit(1), F.greatest(F.lit(0), F.least(F.length("text").cast("long"), 1000 - F.col("before"))).cast("int")).alias("kept"))


@query(
    "E18",
    "SELECT event_id, MIN(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM events WHERE event_type IN ('error', 'purchase')",
)
def e_next_end(spark, sf_dir):
    window = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    return e.select("event_id", F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(window).alias("next_purchase"))


@query("E19", r"SELECT event_id, regexp_extract(props, '(\d+)', 1) AS item FROM events WHERE event_type = 'error' AND regexp_matches(props, '\d')")
def e_failed_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.where(F.col("props").rlike(r"\d")).select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("item"))


@query(
    "K29 K28",
    """WITH s AS (SELECT l_orderkey, l_linenumber, MAX(CASE WHEN l_quantity > 25 THEN 60 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 40 ELSE 0 END + CASE WHEN l_discount < 0.05 THEN 30 ELSE 0 END + l_linenumber) AS score FROM lineitem GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS rn FROM s), b AS (SELECT l_orderkey, MAX(l_linenumber) FILTER (rn = 1) AS l_linenumber, MAX(score) FILTER (rn = 1) AS score, MAX(score) FILTER (rn = 2) AS next_score FROM r GROUP BY 1)
       SELECT *, CASE WHEN score < 110 THEN 'below_threshold' WHEN score - next_score < 10 THEN 'ambiguous' ELSE 'selected' END AS selection FROM b""",
)
def k_primary_candidate(spark, sf_dir):
    score = rules.points([(F.col("l_quantity") > 25, 60), (F.col("l_returnflag") == "R", 40), (F.col("l_discount") < 0.05, 30)]) + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score")).groupBy("l_orderkey", "l_linenumber").agg(F.max("score").alias("score"))
    return rules.primary(lines, ["l_orderkey"], "score", "l_linenumber")


@query(
    "K70 D32 D34",
    """WITH r AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS d FROM lineitem), p AS (SELECT l_orderkey AS k, l_suppkey AS d, bool_or(l_returnflag = 'R') AS t FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
       c AS (SELECT r.k, COUNT(*) AS n_required, COUNT(*) FILTER (t) AS n_processed, COUNT(*) FILTER (t IS NULL) AS n_missing, COUNT(*) FILTER (NOT t) AS n_without_text FROM r LEFT JOIN p ON r.k = p.k AND r.d = p.d GROUP BY 1)
       SELECT k AS l_orderkey, n_required, n_processed, n_missing, n_without_text, CASE WHEN n_missing > 0 THEN 'missing' WHEN n_without_text > 0 THEN 'not_processed' ELSE 'ready' END AS reason FROM c""",
)
def k_readiness(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    done = l.where("l_linestatus = 'F'").select("l_orderkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("has_text"))
    return rules.readiness(l, done, "l_orderkey", "l_suppkey")
