"""Queries over aggregates, evaluation, sets and constraints."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import cascade, checks, evaluation, joins, latest, quality, rules, upsert
from .registry import query, table
from .selections import ntz


@query(
    "E06 D08 C01 C02",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS rn FROM events),
       b AS (SELECT CASE WHEN value IS NULL OR value <= 0 THEN 'unknown' WHEN value < 20 THEN '<20' WHEN value < 60 THEN '20-60' WHEN value < 120 THEN '60-120' ELSE '120+' END AS group_key, event_type FROM l WHERE rn = 1),
       q AS (SELECT group_key, COUNT(*) AS n, COUNT(*) FILTER (event_type IN ('purchase', 'signup')) AS positive, COUNT(*) FILTER (event_type = 'error') AS negative FROM b GROUP BY 1)
       SELECT *, CASE WHEN positive + negative = 0 THEN NULL ELSE round(positive / CAST(positive + negative AS DOUBLE), 4) END AS positive_rate FROM q ORDER BY n DESC, group_key""",
)
def latest_feedback_quality(spark, sf_dir):
    """The flagship: latest feedback per entity, in bands of value, with how much of it is positive."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    last = latest.latest(e, ["user_id"], [F.col("ts").desc_nulls_first(), F.col("event_id").desc()])
    band = quality.price_band(F.col("value"), [20, 60, 120], ["<20", "20-60", "60-120", "120+"])
    q = quality.quality_table(last, band, F.col("event_type").isin("purchase", "signup"), F.col("event_type") == "error")
    return q.orderBy(F.col("n").desc(), "group_key")


@query(
    "D02 M04",
    "WITH g AS (SELECT md5(text) AS sha, COUNT(*) AS n FROM documents GROUP BY 1 HAVING COUNT(*) > 1) SELECT n, COUNT(*) AS n_texts, (SELECT COUNT(*) FROM g) AS n_groups FROM g GROUP BY 1",
)
def d_having_with_group_total(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("sha"))
    return quality.groups_above(d, ["sha"], 1).groupBy("n", "n_groups").agg(F.count("*").alias("n_texts"))


@query(
    "D03-D05 D23 D33",
    """SELECT CAST(MAX(ts) AS VARCHAR) AS last_ts, COUNT(*) AS n, COALESCE(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 0) AS total, COUNT(*) FILTER (event_type = 'error' AND value > 100) AS stuck, CAST(SUM(length(props)) AS BIGINT) AS chars FROM events""",
)
def d_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # In hundredths: 1.005 is less than its digits say, and a decimal of two places made from the digits is 1.01.
    hundredths = F.sum((F.col("value") * 100).cast("decimal(18,0)"))
    return e.agg(
        F.max("ts").cast("string").alias("last_ts"),
        F.count("*").alias("n"),
        F.coalesce((hundredths * F.lit("0.01").cast("decimal(2,2)")).cast("double"), F.lit(0.0)).alias("total"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 100)).alias("stuck"),
        F.sum(F.length("props")).alias("chars"),
    )


@query(
    "D06 D21",
    "SELECT event_type, COUNT(*) AS n, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS place FROM events GROUP BY event_type",
)
def d_counts_in_declared_order(spark, sf_dir):
    return quality.count_in_order(table(spark, sf_dir, "events"), "event_type", ["purchase", "signup", "error"]).orderBy("place", "event_type")


@query(
    "D09",
    "SELECT lang, n, printf('%.1f%%', 100.0 * n / (SELECT COUNT(*) FROM documents)) AS share FROM (SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang)",
)
def d_ratio_text(spark, sf_dir):
    counted = cascade.with_total(table(spark, sf_dir, "documents").select("lang"), "total").groupBy("lang", "total").agg(F.count("*").alias("n"))
    return counted.select("lang", "n", quality.percent_text(F.col("n"), F.col("total")).alias("share"))


@query(
    "D11 D24",
    """SELECT 'status' AS section, event_type AS key, COUNT(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), COUNT(*) FROM events GROUP BY 2
       UNION ALL SELECT 'band', CASE WHEN value < 50 THEN 'low' ELSE 'high' END, COUNT(*) FROM events GROUP BY 2""",
)
def d_report_sections(spark, sf_dir):
    """All sections by grouping sets over one scan."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("value") < 50, F.lit("low")).otherwise(F.lit("high")).alias("band"))
    s, d, b = F.col("status"), F.col("day"), F.col("band")
    g = e.groupingSets([[s], [d], [b]], s, d, b).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 3, F.lit("status")).when(F.col("g") == 5, F.lit("day")).otherwise(F.lit("band")).alias("section"), F.coalesce("status", "day", "band").alias("key"), "n")


@query(
    "D14-D16 G03",
    """SELECT c_mktsegment, COUNT(*) AS n_rows, COUNT(DISTINCT o_orderkey % 100) AS n_ids FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1
       UNION ALL SELECT NULL, COUNT(*), COUNT(DISTINCT o_orderkey % 100) FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def d_rollup_of_distinct_ids(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.collect_set(F.col("o_orderkey") % 100).alias("ids"))
    rows = c.join(per, c.c_custkey == per.o_custkey).select("c_mktsegment", "n_rows", "ids")
    return quality.rolled_up(rows, "c_mktsegment", ["n_rows"], "ids")


def gold(spark, sf_dir):
    """Labels as gold decisions; the prediction is a rule on the document's length."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    cases = l.select(F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 1, F.lit("reject")).when(F.col("quality") == 0, F.lit("manual")).otherwise(F.lit("accept")).alias("expected"), (F.lit(1) + F.col("toxic")).cast("decimal(18,4)").alias("weight"), F.when(F.col("toxic") == 1, F.array(F.lit("accept"))).otherwise(F.array().cast("array<string>")).alias("critical"))
    n = F.col("n_chars")
    status = F.when(F.col("case_id") % 17 == 0, F.lit("failed")).when(F.col("case_id") % 23 == 0, F.lit("abstained")).when(F.col("case_id") % 41 == 0, F.lit("invalid")).otherwise(F.lit("ok"))
    predicted = F.when(n < 200, F.lit("manual")).when(n > 15000, F.lit("reject")).otherwise(F.lit("accept"))
    predictions = d.where("doc_id % 29 <> 0").withColumnRenamed("doc_id", "case_id").select(
        "case_id",
        status.alias("status"),
        predicted.alias("predicted"),
        F.when(F.col("case_id") % 5 != 0, (n % 1000).cast("int")).alias("latency_ms"),
        F.when(F.col("case_id") % 3 != 0, (n / 100000).cast("decimal(20,8)")).alias("cost"),
        (F.col("case_id") % 7 == 0).alias("fallback"),
        (F.col("case_id") % 11 == 0).alias("review_required"),
        (F.col("case_id") % 22 == 0).alias("review_completed"),
    )
    return cases, predictions


_GOLD_SQL = """WITH c AS (SELECT doc_id AS case_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'manual' ELSE 'accept' END AS expected, CAST(1 + toxic AS DECIMAL(18,4)) AS weight, toxic FROM labels),
    p AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 23 = 0 THEN 'abstained' WHEN doc_id % 41 = 0 THEN 'invalid' ELSE 'ok' END AS status,
      CASE WHEN n_chars < 200 THEN 'manual' WHEN n_chars > 15000 THEN 'reject' ELSE 'accept' END AS predicted, CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars % 1000 AS INTEGER) END AS latency_ms,
      CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars / 100000 AS DECIMAL(20,8)) END AS cost, doc_id % 7 = 0 AS fallback, doc_id % 11 = 0 AS review_required, doc_id % 22 = 0 AS review_completed FROM documents WHERE doc_id % 29 <> 0),
    j AS (SELECT c.*, COALESCE(status, 'missing') AS status, predicted, latency_ms, cost, fallback, review_required, review_completed FROM c LEFT JOIN p USING (case_id)),
    k AS (SELECT *, status = 'ok' AND predicted = expected AS correct, CASE WHEN status = 'ok' THEN predicted ELSE status END AS answer FROM j)"""


@query(
    "D17-D19 C25",
    _GOLD_SQL
    + """, m AS (SELECT COUNT(*) AS n_cases, round(COUNT(*) FILTER (status = 'ok') / CAST(COUNT(*) AS DOUBLE), 4) AS structured_rate, round(COUNT(*) FILTER (correct) / CAST(COUNT(*) AS DOUBLE), 4) AS accuracy,
    round(CAST(SUM(CASE WHEN correct THEN 0 ELSE weight END) AS DOUBLE) / CAST(SUM(weight) AS DOUBLE), 4) AS weighted_loss,
    COUNT(*) FILTER (status IN ('missing', 'invalid') OR (NOT correct AND toxic = 1 AND answer = 'accept')) AS critical_errors, COUNT(*) FILTER (status = 'abstained') AS abstained, COUNT(*) FILTER (status = 'failed') AS failed,
    round(COUNT(*) FILTER (fallback) / CAST(COUNT(*) AS DOUBLE), 4) AS fallback_rate, round(COUNT(*) FILTER (review_required) / CAST(COUNT(*) AS DOUBLE), 4) AS review_rate,
    COALESCE(round(COUNT(*) FILTER (review_required AND review_completed) / CAST(NULLIF(COUNT(*) FILTER (review_required), 0) AS DOUBLE), 4), 1.0) AS review_completion,
    quantile_disc(latency_ms, 0.95) AS latency_p95, round(AVG(CAST(cost AS DOUBLE)), 6) AS mean_cost FROM k)
    SELECT *, concat_ws(',', CASE WHEN accuracy < 0.8 THEN 'accuracy' END, CASE WHEN structured_rate < 1 THEN 'structured' END, CASE WHEN weighted_loss > 0.2 THEN 'loss' END, CASE WHEN critical_errors > 0 THEN 'critical' END) AS failed_gates,
    accuracy >= 0.8 AND structured_rate >= 1 AND weighted_loss <= 0.2 AND critical_errors = 0 AS released FROM m""",
)
def d_evaluation(spark, sf_dir):
    measured = evaluation.metrics(evaluation.match_predictions(*gold(spark, sf_dir)))
    return evaluation.gate(measured).withColumn("latency_p95", F.col("latency_p95").cast("int"))


@query("D20", _GOLD_SQL + " SELECT expected || '->' || answer AS cell, COUNT(*) AS n FROM k GROUP BY 1")
def d_confusion(spark, sf_dir):
    return evaluation.confusion(evaluation.match_predictions(*gold(spark, sf_dir)))


@query(
    "D22 I15",
    """WITH s AS (SELECT l_orderkey, CAST(greatest(0, least(100, SUM(CAST(trunc(CASE l_returnflag WHEN 'R' THEN 12.5 WHEN 'A' THEN 4.75 ELSE 0.5 END * (l_discount * 100)) AS BIGINT)))) AS INTEGER) AS risk FROM lineitem GROUP BY 1)
       SELECT l_orderkey, risk, CASE WHEN risk >= 70 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS band FROM s""",
)
def d_weighted_risk(spark, sf_dir):
    flag = F.col("l_returnflag")
    weight = F.when(flag == "R", F.lit(12.5)).when(flag == "A", F.lit(4.75)).otherwise(F.lit(0.5))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", weight.alias("weight"), (F.col("l_discount") * 100).alias("signal"))
    return rules.weighted_risk(l, ["l_orderkey"], "weight", "signal")


@query(
    "I15-I17 K04 D12",
    """WITH s AS (SELECT o_orderkey, greatest(0, least(100, (CASE WHEN o_totalprice > 200000 THEN 40 ELSE 0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 35 ELSE 0 END) + (CASE WHEN o_orderstatus = 'O' THEN 30 ELSE 0 END) - (CASE WHEN o_totalprice < 20000 THEN 50 ELSE 0 END))) AS s0, * EXCLUDE (o_orderkey) FROM orders),
       t AS (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN least(s0, 25) ELSE s0 END AS s1 FROM s), u AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE s1 END AS s2 FROM t), v AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN least(s2, 60) ELSE s2 END AS score FROM u)
       SELECT o_orderkey, CAST(score AS INTEGER) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS tier, CASE o_orderpriority WHEN '1-URGENT' THEN 10000.0 WHEN '2-HIGH' THEN 50000.0 ELSE 100000.0 END <= o_totalprice AS worth_it FROM v""",
)
def i_rule_score(spark, sf_dir):
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    points = [(price > 200000, 40), (priority == "1-URGENT", 35), (F.col("o_orderstatus") == "O", 30), (price < 20000, -50)]
    score = rules.additive_score(points, priority != "5-LOW", F.col("o_orderdate") < ntz(dt.datetime(1996, 1, 1)), F.col("o_orderstatus") == "F")
    least = F.coalesce(F.try_element_at(F.create_map(F.lit("1-URGENT"), F.lit(10000.0), F.lit("2-HIGH"), F.lit(50000.0)), priority), F.lit(100000.0))
    o = table(spark, sf_dir, "orders").select("o_orderkey", score.cast("int").alias("score"), (least <= price).alias("worth_it"))
    return o.withColumn("tier", cascade.first_match([("high", F.col("score") >= 70), ("medium", F.col("score") >= 40)], "low"))


@query(
    "D31",
    """WITH y AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS y, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS first_price FROM lineitem GROUP BY 1, 2)
       SELECT l_suppkey, MAX(first_price) FILTER (y = 1995) AS y1995, MAX(first_price) FILTER (y = 1996) AS y1996, MAX(first_price) FILTER (y = 1997) AS y1997 FROM y GROUP BY 1""",
)
def d_yearly_pivot(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    first = l.groupBy("l_suppkey", "y").agg(F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("p"))
    out = first.groupBy("l_suppkey").pivot("y", [1995, 1996, 1997]).agg(F.max("p"))
    return out.select("l_suppkey", *[F.col(str(y)).alias(f"y{y}") for y in (1995, 1996, 1997)])


@query(
    "D36-D38 J02",
    """SELECT doc_id, CAST((text IS NOT NULL AND text <> '') AS INTEGER) + CAST((lang IS NOT NULL) AS INTEGER) + CAST(source <> 'src0' AS INTEGER) AS filled, CASE WHEN n_chars > 0 THEN n_chars ELSE doc_id END AS first_positive FROM documents""",
)
def d_completeness(spark, sf_dir):
    filled = [F.coalesce(F.col("text") != "", F.lit(False)), F.col("lang").isNotNull(), F.col("source") != "src0"]
    return table(spark, sf_dir, "documents").select(
        "doc_id", sum((f.cast("int") for f in filled[1:]), filled[0].cast("int")).alias("filled"), F.coalesce(F.nullif(F.greatest(F.lit(0).cast("long"), F.col("n_chars")), F.lit(0).cast("long")), F.col("doc_id")).alias("first_positive")
    )


@query(
    "G02 G06 G08 A11",
    """SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'""",
)
def g_new_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = lambda condition: o.where(condition).select(F.col("o_custkey").alias("id"))
    return joins.absent(ids(F.col("o_orderdate") >= ntz(dt.datetime(2001, 7, 1))).distinct(), ids(F.col("o_orderdate") < ntz(dt.datetime(1996, 1, 1))), ["id"])


@query(
    "G06 G08",
    "SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user', 'tool'], lambda r: NOT list_contains(roles, r))), ',') AS missing, array_to_string(list_distinct(list_concat(roles, ['audit'])).list_sort(), ',') AS every FROM (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY 1)",
)
def g_array_sets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    declared = F.array(*map(F.lit, ("assistant", "system", "user", "tool")))
    return c.select("conv_id", F.array_join(F.array_sort(F.array_except(declared, "roles")), ",").alias("missing"), F.array_join(F.array_sort(F.array_union("roles", F.array(F.lit("audit")))), ",").alias("every"))


@query(
    "M03",
    """SELECT 'price' AS rule, COUNT(*) FILTER (NOT o_totalprice > 2000) AS n FROM orders UNION ALL SELECT 'status', COUNT(*) FILTER (NOT o_orderstatus IN ('O', 'F')) FROM orders
       UNION ALL SELECT 'priority', COUNT(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-5]-')) FROM orders UNION ALL SELECT 'together', COUNT(*) FILTER (NOT (o_orderdate IS NULL) = (o_totalprice IS NULL)) FROM orders""",
)
def m_check_constraints(spark, sf_dir):
    return checks.violations(
        table(spark, sf_dir, "orders"),
        {
            "price": F.col("o_totalprice") > 2000,
            "status": F.col("o_orderstatus").isin("O", "F"),
            "priority": F.col("o_orderpriority").rlike("^[1-5]-"),
            "together": F.col("o_orderdate").isNull() == F.col("o_totalprice").isNull(),
        },
    )


@query("M04 M05", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY 1 HAVING COUNT(*) > 1")
def m_partial_unique(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"], (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))


@query(
    "A12 A15-A17 A38 A40-A43",
    """WITH new AS (SELECT c_custkey, c_name || ' *' AS c_name, c_mktsegment, 'new' AS status FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment, 'new' FROM customer WHERE c_custkey % 100 = 0)
       SELECT c_custkey, c_name, c_mktsegment, NULL AS status FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new""",
)
def a_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = c.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit(" *")))
    added = c.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    return upsert.upsert(c.withColumn("status", F.lit(None).cast("string")), changed.unionAll(added), ["c_custkey"], reset={"status": F.lit("new")})


@query(
    "A18 A21 A45 A46 L02",
    """WITH target AS (SELECT user_id, event_type, COUNT(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2), rows AS (SELECT user_id, event_type, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND event_type <> 'view' GROUP BY 1, 2)
       SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM rows r WHERE r.user_id = t.user_id AND r.event_type = t.event_type) UNION ALL SELECT * FROM rows""",
)
def a_replace_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    counted = lambda condition: e.where(condition).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return upsert.replace_kind(counted(F.col("ts") < ntz(dt.datetime(2024, 1, 10))), counted((F.col("ts") >= ntz(dt.datetime(2024, 1, 28))) & (F.col("event_type") != "view")), ["user_id", "event_type"])


@query(
    "A21 A22 A23",
    """WITH b AS (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT c_custkey AS user_id, CAST(COALESCE(n, 0) + 1 AS BIGINT) AS n FROM customer LEFT JOIN b ON user_id = c_custkey
       UNION ALL SELECT user_id, n FROM b ANTI JOIN customer ON user_id = c_custkey""",
)
def a_counters(spark, sf_dir):
    start = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).cast("long").alias("n"))
    return upsert.counters(start, table(spark, sf_dir, "events").where("event_type = 'signup'"), ["user_id"])


@query("A28 A44", "SELECT doc_id, COALESCE(n_chars < 300, TRUE) AS unprocessed, CASE WHEN n_chars < 300 THEN 'new' ELSE 'scored' END AS status FROM documents")
def a_unprocessed(spark, sf_dir):
    short = F.col("n_chars") < 300
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(short, F.lit(True)).alias("unprocessed"), F.when(short, F.lit("new")).otherwise(F.lit("scored")).alias("status"))
