"""Digests of customers: the latest score, lead, report, triage and feedback among their events, and their orders as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade, digest
from .registry import query, table

#: Which events stand for what, and the moment that ages are counted from.
KINDS = {"score": "view", "lead": "signup", "report": "purchase", "triage": "error", "feedback": "click"}
NOW = "2024-01-31 00:00:00"

_PICKED = ",\n".join(f"arg_max({{v}}, (ts, event_id)) FILTER (event_type = '{e}') AS {k}_{{n}}" for k, e in KINDS.items())
_BASE = f"""WITH e AS (SELECT user_id, {_PICKED.format(v="event_id", n="id")}, {_PICKED.format(v="ts", n="at")}, {_PICKED.format(v="value", n="value")} FROM events GROUP BY user_id),
o AS (SELECT o_custkey, COUNT(*) AS n_docs, COUNT(*) FILTER (o_orderstatus = 'F') AS n_text FROM orders GROUP BY 1),
b AS (SELECT c_custkey AS key, c_mktsegment AS segment, e.* EXCLUDE (user_id), COALESCE(n_docs, 0) AS n_docs, COALESCE(n_text, 0) AS n_text FROM customer LEFT JOIN e ON user_id = c_custkey LEFT JOIN o ON o_custkey = c_custkey),
r AS (SELECT *, CASE WHEN score_value >= 150 THEN 'go' WHEN score_value >= 60 THEN 'maybe' WHEN score_value IS NOT NULL THEN 'no_go' END AS recommendation, CASE WHEN feedback_value >= 150 THEN 'in_work' WHEN feedback_value >= 80 THEN 'interesting' WHEN feedback_value IS NOT NULL THEN 'declined' END AS verdict, triage_value >= 100 AS rejected FROM b) """


def _base(spark, sf_dir, inner=None):
    """One row per customer with kind_id, kind_at and kind_value, and what these say."""
    kind = F.col("event_type")
    b = digest.base(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")),
        table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type", "event_id", "ts", "value"),
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus"),
        "key",
        {k: kind == e for k, e in KINDS.items()},
        ["ts", "event_id"],
        ["event_id", "ts", "value"],
        {"n_docs": F.count("*"), "n_text": F.count_if(F.col("o_orderstatus") == "F")},
        inner,
    )
    flat = b.select("key", "segment", "n_docs", "n_text", *[F.col(k)[field].alias(f"{k}_{name}") for k in KINDS for field, name in (("event_id", "id"), ("ts", "at"), ("value", "value"))])
    score, feedback = F.col("score_value"), F.col("feedback_value")
    return flat.withColumns(
        {
            "recommendation": cascade.first_match([("go", score >= 150), ("maybe", score >= 60), ("no_go", score.isNotNull())]),
            "verdict": cascade.first_match([("in_work", feedback >= 150), ("interesting", feedback >= 80), ("declined", feedback.isNotNull())]),
            "rejected": F.col("triage_value") >= 100,
        }
    )


_now = lambda: F.lit(NOW).cast("timestamp_ntz")
_ago = lambda days: F.expr(f"timestamp_ntz '{NOW}' - interval {days} days")
_at = lambda name: F.col(name).cast("timestamp_ntz")


@query("C31", _BASE + "SELECT key, segment, score_id, lead_id, report_id, triage_id, feedback_id, n_docs, n_text, recommendation, verdict, COUNT(*) OVER () AS total FROM r WHERE recommendation IN ('go', 'maybe') AND verdict IS DISTINCT FROM 'declined' AND NOT COALESCE(rejected AND triage_at > score_at, FALSE)")
def c_full_digest(spark, sf_dir):
    declined = F.coalesce(F.col("verdict") == "declined", F.lit(False))
    rejected = F.coalesce(F.col("rejected") & (F.col("triage_at") > F.col("score_at")), F.lit(False))
    shown = _base(spark, sf_dir).where(F.col("recommendation").isin("go", "maybe") & ~declined & ~rejected)
    return cascade.with_total(shown.select("key", "segment", *[f"{k}_id" for k in KINDS], "n_docs", "n_text", "recommendation", "verdict"))


@query("C32", _BASE + "SELECT key, segment, score_id, lead_id, report_id, triage_id, feedback_id, n_docs, n_text, recommendation, verdict FROM r WHERE key = 7")
def c_one_digest(spark, sf_dir):
    """The digest's row of one key; the filter goes down to all three tables."""
    return _base(spark, sf_dir).where("key = 7").select("key", "segment", *[f"{k}_id" for k in KINDS], "n_docs", "n_text", "recommendation", "verdict")


@query("C33", _BASE + "SELECT key, feedback_id, lead_id, report_id, score_id, n_docs, feedback_at < TIMESTAMP '2024-01-26' AS stale FROM r WHERE verdict = 'in_work'")
def c_in_work_digest(spark, sf_dir):
    return _base(spark, sf_dir, "feedback").where("verdict = 'in_work'").select("key", "feedback_id", "lead_id", "report_id", "score_id", "n_docs", (_at("feedback_at") < _ago(5)).alias("stale"))


@query("C34", _BASE + f"SELECT key, report_id, report_value, recommendation, verdict, date_diff('hour', report_at, TIMESTAMP '{NOW}') AS hours FROM (SELECT * REPLACE (date_trunc('hour', report_at) AS report_at) FROM r WHERE report_at >= TIMESTAMP '2024-01-24' AND (feedback_at IS NULL OR feedback_at < report_at))")
def c_recent_reports(spark, sf_dir):
    """Reports of the last seven days that no feedback came after."""
    unlabelled = F.col("feedback_at").isNull() | (F.col("feedback_at") < F.col("report_at"))
    recent = _base(spark, sf_dir, "report").where((_at("report_at") >= _ago(7)) & unlabelled)
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", _at("report_at")).cast("timestamp_ntz"), _now())
    return recent.select("key", "report_id", "report_value", "recommendation", "verdict", hours.alias("hours"))


_QUEUED = "report_value >= 100 AND NOT COALESCE(rejected AND triage_at >= report_at, FALSE) AND (feedback_at IS NULL OR feedback_at < report_at) AND n_text > 0"


@query("C35", _BASE + f"SELECT key, report_id, recommendation, CASE WHEN n_text = n_docs THEN 'ready' WHEN 2 * n_text >= n_docs THEN 'partial' ELSE 'waiting' END AS bucket, COUNT(*) OVER () AS total FROM r WHERE {_QUEUED}")
def c_operational_queue(spark, sf_dir):
    """The newest report is positive, no later triage rejects it, no later feedback settles it, and a document can be read."""
    rejected = F.coalesce(F.col("rejected") & (F.col("triage_at") >= F.col("report_at")), F.lit(False))
    open_ = F.col("feedback_at").isNull() | (F.col("feedback_at") < F.col("report_at"))
    queued = _base(spark, sf_dir, "report").where((F.col("report_value") >= 100) & ~rejected & open_ & (F.col("n_text") > 0))
    bucket = cascade.first_match([("ready", F.col("n_text") == F.col("n_docs")), ("partial", 2 * F.col("n_text") >= F.col("n_docs"))], "waiting")
    return cascade.with_total(queued.select("key", "report_id", "recommendation", bucket.alias("bucket")))


@query("C36", _BASE + "SELECT key, feedback_id, report_id, n_docs - n_text AS n_without_text, CASE WHEN report_id IS NULL THEN 'no_report' WHEN report_at > feedback_at THEN 'new_report' ELSE 'known' END AS state, COUNT(*) OVER () AS total FROM r WHERE verdict = 'in_work' AND n_docs > 0")
def c_operational_in_work(spark, sf_dir):
    state = cascade.first_match([("no_report", F.col("report_id").isNull()), ("new_report", F.col("report_at") > F.col("feedback_at"))], "known")
    rows = _base(spark, sf_dir, "feedback").where("verdict = 'in_work' and n_docs > 0")
    return cascade.with_total(rows.select("key", "feedback_id", "report_id", (F.col("n_docs") - F.col("n_text")).alias("n_without_text"), state.alias("state")))


@query("C37", _BASE + "SELECT key, triage_id, rejected, verdict, recommendation, CASE WHEN verdict IS NULL THEN 'unlabelled' WHEN rejected = (verdict = 'declined') THEN 'agrees' WHEN rejected THEN 'lost' ELSE 'noise' END AS audit FROM r WHERE triage_id IS NOT NULL")
def c_triage_audit(spark, sf_dir):
    audit = cascade.first_match([("unlabelled", F.col("verdict").isNull()), ("agrees", F.col("rejected") == (F.col("verdict") == "declined")), ("lost", F.col("rejected"))], "noise")
    return _base(spark, sf_dir, "triage").select("key", "triage_id", "rejected", "verdict", "recommendation", audit.alias("audit"))


@query("C39", _BASE + "SELECT key, segment, score_id, report_id, feedback_id, recommendation, n_docs, COUNT(*) OVER () AS total FROM r WHERE CAST(lead_at + INTERVAL 3 HOUR AS DATE) = DATE '2024-01-30' OR CAST(score_at + INTERVAL 3 HOUR AS DATE) = DATE '2024-01-30'")
def c_today_digest(spark, sf_dir):
    """A lead or a score of the last day, by the calendar three hours ahead of UTC."""
    today = lambda name: F.coalesce(F.to_date(_at(name) + F.expr("interval 3 hours")) == F.lit("2024-01-30").cast("date"), F.lit(False))
    rows = _base(spark, sf_dir).where(today("lead_at") | today("score_at"))
    return cascade.with_total(rows.select("key", "segment", "score_id", "report_id", "feedback_id", "recommendation", "n_docs"))


@query("C40", _BASE + """, n AS (SELECT *, CASE WHEN segment = 'FURNITURE' THEN 'vertical' WHEN n_docs = 0 THEN 'no_documents' WHEN rejected AND triage_at > score_at THEN 'triage' END AS noise FROM r WHERE score_at >= TIMESTAMP '2024-01-11')
    SELECT key, noise, recommendation, verdict, CASE WHEN noise IS NOT NULL AND (recommendation = 'go' OR verdict = 'in_work') THEN 'review_rule' WHEN noise IS NOT NULL THEN 'hide' WHEN recommendation = 'no_go' THEN 'add_rule' ELSE 'keep' END AS action FROM n""")
def c_noise_audit(spark, sf_dir):
    recent = _base(spark, sf_dir, "score").where(_at("score_at") >= _ago(20))
    noise = cascade.first_match([("vertical", F.col("segment") == "FURNITURE"), ("no_documents", F.col("n_docs") == 0), ("triage", F.col("rejected") & (F.col("triage_at") > F.col("score_at")))])
    n = recent.select("key", noise.alias("noise"), "recommendation", "verdict")
    wanted = F.coalesce((F.col("recommendation") == "go") | (F.col("verdict") == "in_work"), F.lit(False))
    action = cascade.first_match([("review_rule", F.col("noise").isNotNull() & wanted), ("hide", F.col("noise").isNotNull()), ("add_rule", F.col("recommendation") == "no_go")], "keep")
    return n.select("*", action.alias("action"))
