"""Queries over the guards of reports, with documents, conversations, orders and events as reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..operators import guards
from .registry import query, table

ORIGIN, FOREIGN, SAFE, CHECK = [" the ", " der ", " los ", " not ", " ein "], ["and ", "und "], ["a checked offer"], "check the register"


def _some(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(
    "K55-K57",
    f"""WITH d AS (SELECT doc_id, lang, substr(text, 1, 60) AS a, source AS b, list_filter({ORIGIN}, lambda w: contains(lower(text), w)) AS s FROM documents), h AS (SELECT *, len(s) > 0 AND ({_some('lower(a)', FOREIGN)} OR {_some('lower(b)', FOREIGN)}) AS applied FROM d)
        SELECT doc_id, len(s) > 0 AS detected, array_to_string(s[1:3], ',') AS signals, applied, CASE WHEN applied THEN '{SAFE[0]}' ELSE a END AS offer, CASE WHEN applied THEN '{CHECK}' ELSE '' END AS risks,
        CASE WHEN applied AND COALESCE(lang, '') = '' THEN 'medium' ELSE lang END AS level FROM h""",
)
def k_origin_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("origin", guards.restricted_origin(F.col("text"), ORIGIN, 3))
    start = F.substring("text", 1, 60)
    guard = guards.guarded_offer(F.col("origin.detected"), guards.names_any(F.array(start, F.col("source")), FOREIGN), F.array(start), F.array().cast("array<string>"), F.col("lang"), SAFE, CHECK)
    d = d.withColumn("guard", guard)
    return d.select("doc_id", "origin.detected", F.array_join("origin.signals", ",").alias("signals"), "guard.applied", F.array_join("guard.offer", ",").alias("offer"), F.array_join("guard.risks", ",").alias("risks"), "guard.level")


@query(
    "K58",
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE event_type WHEN 'purchase' THEN 'Go' WHEN 'signup' THEN 'go' ELSE 'maybe' END AS decision, CASE WHEN user_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM events)
       SELECT event_id, CASE WHEN lower(decision) = 'go' AND confidence = 'high' AND (k % 5 IN (0, 1) OR (k % 3 = 0 AND k % 2 = 0)) THEN 'medium' ELSE confidence END AS confidence, CASE WHEN lower(decision) = 'go' THEN 'maybe' ELSE decision END AS capped FROM e""",
)
def k_confidence_cap(spark, sf_dir):
    k, kind = jsonx.int_at(F.col("props"), "$.k"), F.col("event_type")
    decision = F.when(kind == "purchase", F.lit("Go")).when(kind == "signup", F.lit("go")).otherwise(F.lit("maybe"))
    confidence = F.when(F.col("user_id") % 2 == 0, F.lit("high")).otherwise(F.lit("low"))
    equivalent = F.when(k % 5 == 0, F.lit("Unclear")).when(k % 5 == 1, F.lit("no")).when(k % 5 == 2, F.lit("yes"))
    return table(spark, sf_dir, "events").select("event_id", guards.capped_confidence(decision, confidence, equivalent, k % 3, k % 2).alias("confidence"), guards.capped_decision(decision).alias("capped"))


@query(
    "K60 K61",
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), l AS (SELECT event_id, k, CASE WHEN k % 7 = 0 THEN FALSE WHEN k % 5 = 0 THEN TRUE WHEN k % 5 = 1 THEN FALSE WHEN k % 4 = 0 THEN FALSE ELSE k % 3 = 0 AND k % 2 = 0 END AS lacks FROM e)
       SELECT event_id, lacks, k > 10 AND k % 11 <> 0 AND k % 7 <> 0 AND (k % 5 = 0 OR k % 13 = 0 OR lacks) AS preliminary FROM l""",
)
def k_specification(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", jsonx.int_at(F.col("props"), "$.k").alias("k"))
    k = F.col("k")
    said = F.when(k % 5 == 0, F.lit(True)).when(k % 5 == 1, F.lit(False))
    counts = [F.when(k % 4 == 0, F.lit(2)), F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(0)).otherwise(F.lit(1)))]
    e = e.withColumn("lacks", guards.lacks_specification(k % 7 == 0, [said], counts))
    return e.select("event_id", "lacks", guards.preliminary(k - 10, k % 11 == 0, k % 7 == 0, said, k % 13 == 0, F.col("lacks")).alias("preliminary"))


@query(
    "K62 K72",
    """WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list(role ORDER BY turn) AS roles, sum(length(text)) AS chars FROM conversations GROUP BY 1)
       SELECT conv_id, len(texts) > conv_id % 6 AND len(list_filter(texts, lambda t: contains(lower(t), ' der ') OR regexp_matches(lower(t), '(^|[^a-z])tha[a-z]+'))) > 0 AS unread,
       conv_id % 7 <> 0 AND conv_id % 5 <> 0 AND chars <= 2500 AND len(list_filter(roles, lambda r: lower(r) NOT IN ('user', 'assistant'))) = 0 AS bare FROM c""",
)
def k_documents_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("a"), F.sum(F.length("text")).alias("chars"))
    unread = guards.important_unread(F.col("a.text"), F.col("conv_id") % 6, [" der "], "(^|[^a-z])tha[a-z]+")
    kind = F.when(F.col("conv_id") % 5 == 0, F.lit("technical_spec")).otherwise(F.lit("contract"))
    return c.select("conv_id", unread.alias("unread"), guards.lacks_evidence(F.col("conv_id") % 7 == 0, kind, F.col("chars"), F.col("a.role"), ["user", "assistant"]).alias("bare"))


@query(
    "K63",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'price_below_min' WHEN o_orderpriority = '1-URGENT' THEN 'service_noise' WHEN o_orderpriority = '5-LOW' THEN 'low_priority_deal' WHEN o_orderstatus = 'P' THEN 'low_priority_deal' ELSE 'no_go' END AS reason FROM orders""",
)
def k_no_go_reason(spark, sf_dir):
    direct = F.when(F.col("o_totalprice") < 50000, F.lit("price_below_min")).when(F.col("o_totalprice") < 90000, F.lit("shown"))
    urgency = F.col("o_orderpriority")
    access = F.when(urgency == "1-URGENT", F.lit("service_noise")).when(urgency == "5-LOW", F.lit("low_priority_deal")).when(urgency == "2-HIGH", F.lit("open"))
    action = F.when(F.col("o_orderstatus") == "P", F.lit("skip_low_priority"))
    reason = guards.no_go_reason(direct, access, action, ("service_noise", "domestic_restricted", "price_below_min"), ("service_noise", "domestic_restricted"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("K69", f"SELECT doc_id, (contains(lower(text), 'ing') AND {_some('lower(text)', ['that ', 'für ', 'que '])}) OR {_some('lower(text)', ['of the', 'in der'])} AS office FROM documents")
def k_buying_office(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", guards.buying_office(F.col("text"), "ing", ["that ", "für ", "que "], ["of the", "in der"]).alias("office"))


@query(
    "H18 H19",
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS t FROM documents), f AS (SELECT doc_id, list_filter(regexp_extract_all(upper(t), '\b[A-Z0-9][A-Z0-9/.\-]{3,24}[A-Z0-9]\b'), lambda x: regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^\d+(ST|ND|RD|TH|GB|MB|KG|MM|CM)$')) AS a,
        list_filter(list_transform(regexp_extract_all(lower('delivery is due within ' || CAST(length(t) % 14 AS VARCHAR) || ' days; ' || t), '(?:ship|deliver).{0,40}?\b(\d{1,3}) days?\b', 1), lambda x: CAST(x AS INTEGER)), lambda x: x <= 10) AS d FROM t)
        SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:20], ',') AS articles, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',') AS days FROM f""",
)
def h_articles_and_days(spark, sf_dir):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    said = F.concat(F.lit("delivery is due within "), (F.length(plain) % 14).cast("string"), F.lit(" days; "), plain)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.article_tokens(plain), ",").alias("articles"), F.array_join(F.transform(text.days_near(said, "ship|deliver"), lambda x: x.cast("string")), ",").alias("days"))
