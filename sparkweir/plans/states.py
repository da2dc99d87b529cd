"""Queries over ledgers and state (events as an operation log) and over sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import jobs, ledger
from ..sources import appendlog, files
from .registry import query, table
from .selections import EVENTS_NOW, EVENTS_NOW_SQL, ntz


@query(
    "L02 L03",
    """WITH f AS (SELECT user_id, event_type AS fingerprint, MIN(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, fingerprint, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS is_update FROM f""",
)
def l_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("fingerprint"), "event_id")
    return ledger.versions(e, ["user_id"], "fingerprint", ["event_id"])


@query(
    "L05 L06 A36",
    """WITH s AS (SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'signup' THEN 'claimed' WHEN 'error' THEN 'released' ELSE 'uncertain' END, (ts, event_id)) AS state FROM events GROUP BY 1)
       SELECT c_custkey AS user_id FROM customer LEFT JOIN s ON user_id = c_custkey WHERE state IS NULL OR state = 'released'""",
)
def l_claimable(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "purchase", F.lit("sent")).when(kind == "signup", F.lit("claimed")).when(kind == "error", F.lit("released")).otherwise(F.lit("uncertain"))
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("state"))
    return ledger.claimable(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), log, ["user_id"], ["ts", "event_id"])


@query(
    "L07 L09",
    """WITH w AS (SELECT event_id, user_id, event_type AS state, COALESCE(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS from_state FROM events)
       SELECT event_id, from_state, state FROM w WHERE NOT (from_state || '>' || state) IN ('>view', '>click', 'view>click', 'view>view', 'click>purchase', 'click>error', 'purchase>view', 'error>view', 'signup>view', 'view>signup')""",
)
def l_transitions(spark, sf_dir):
    allowed = {"": ["view", "click"], "view": ["click", "view", "signup"], "click": ["purchase", "error"], "purchase": ["view"], "error": ["view"], "signup": ["view"]}
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("state"))
    return ledger.invalid_transitions(log, ["user_id"], ["event_id"], allowed).select("event_id", "from_state", "state")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "ts")


@query("A20 A21", "SELECT event_id, user_id, event_type AS kind, ts FROM events")
def a_event_log(spark, sf_dir):
    """Events appended in batches that overlap, the first of them twice: each is there once."""
    folder, e = files.scratch(spark), _log(spark, sf_dir)
    early, late = e.where(F.col("ts") < ntz(dt.datetime(2024, 1, 16))), e.where(F.col("ts") >= ntz(dt.datetime(2024, 1, 10)))
    for batch, rows in (("1", early), ("1", early), ("2", late), ("3", e)):
        appendlog.append_once(rows, folder, batch, ["event_id"])
    return appendlog.read(spark, folder, e.schema)


@query("L15", "SELECT event_type AS kind, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY 1")
def l_append_only(spark, sf_dir):
    """A log that is to be overwritten, and one that gets rows without a key, stay as they are."""
    folder, e = files.scratch(spark), _log(spark, sf_dir)
    appendlog.append_once(e, folder, "1", ["event_id"])
    refused = 0
    without_key = e.withColumn("event_id", F.when(F.col("kind") != "view", F.col("event_id") + 1_000_000_000))
    for attempt in (lambda: e.limit(1).write.format("append_log").mode("overwrite").options(path=folder, batch="2", keys="event_id").save(), lambda: appendlog.append_once(without_key, folder, "3", ["event_id"])):
        try:
            attempt()
        except Exception as said:
            if "Refused" not in str(said):
                raise
            refused += 1
    if refused != 2:
        raise AssertionError("a log was changed")
    return appendlog.read(spark, folder, e.schema).groupBy("kind").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("L16 L05", "SELECT user_id, COUNT(*) AS attempts, MAX(ts) AS last, CASE WHEN COUNT(*) >= 15 THEN 'failed' ELSE 'retry' END AS state FROM events WHERE event_type = 'error' GROUP BY 1")
def l_recorded_attempts(spark, sf_dir):
    """Attempts are rows of a log; counts of them tell which keys have none left."""
    folder, e = files.scratch(spark), _log(spark, sf_dir).where("kind = 'error'")
    appendlog.append_once(e, folder, "1", ["event_id"])
    counted = appendlog.read(spark, folder, e.schema).groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    return counted.withColumn("state", ledger.attempts_state(F.col("attempts"), 15))


@query(
    "L17",
    """SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS done, COUNT(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN COUNT(*) FILTER (WHERE event_type = 'error') = 0 THEN 'complete' WHEN COUNT(*) FILTER (WHERE event_type = 'click') = 0 THEN 'failed' ELSE 'partial' END AS state
       FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""",
)
def l_partial_downloads(spark, sf_dir):
    """One state event for each key, appended: how many of its parts came, and what that makes."""
    folder, e = files.scratch(spark), _log(spark, sf_dir)
    counted = e.where(F.col("kind").isin("click", "error")).groupBy("user_id").agg(F.count_if(F.col("kind") == "click").alias("done"), F.count_if(F.col("kind") == "error").alias("failed"))
    state = F.when(F.col("failed") == 0, F.lit("complete")).when(F.col("done") == 0, F.lit("failed")).otherwise(F.lit("partial"))
    said = counted.withColumn("state", state)
    appendlog.append_once(said, folder, "1", ["user_id"])
    return appendlog.read(spark, folder, said.schema)


#: Users' events as a log of asked steps: what each type asks for; sign-ups grant a redrive where their value is high.
STEP_OF = {"view": "processing", "click": "retry_scheduled", "purchase": "dead_lettered", "signup": "accepted"}


def _job_log(spark, sf_dir):
    kind = F.col("event_type")
    target = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in STEP_OF.items()], F.when(F.col("value") < 5, F.lit("succeeded")).otherwise(F.lit("retry_scheduled")))
    error = F.when((F.col("value") > 2) & kind.isin("click", "purchase", "error"), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), target.alias("target"), F.lit("worker").alias("owner"), error.alias("error"), (F.col("value") > 20).alias("granted"), F.lit(dt.datetime(2024, 1, 28)).alias("deadline"))


@query(
    "L05 L07 L09",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS job, ts AS "at", event_id AS seq, value > 20 AS granted, CASE WHEN value > 2 AND event_type IN ('click', 'purchase', 'error') THEN event_type END AS error,
          CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'retry_scheduled' WHEN 'purchase' THEN 'dead_lettered' WHEN 'signup' THEN 'accepted' ELSE CASE WHEN value < 5 THEN 'succeeded' ELSE 'retry_scheduled' END END AS target,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS "at", '' AS from_state, 'accepted' AS state, '' AS verdict, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS until, false AS lapsed, CAST(NULL AS TIMESTAMP) AS lapsed_at, '' AS lapsed_to, 0 AS lapsed_attempts, CAST(NULL AS TIMESTAMP) AS lapsed_until FROM e
          UNION ALL
          SELECT job, i, seq, "at", held, CASE WHEN said = 'ok' THEN target ELSE held END, said,
            CASE WHEN said <> 'ok' THEN attempts WHEN target = 'processing' THEN attempts + 1 WHEN target = 'accepted' THEN 0 ELSE attempts END,
            CASE WHEN said <> 'ok' THEN held_until WHEN target = 'processing' THEN "at" + INTERVAL 86400 SECOND WHEN target = 'retry_scheduled' THEN "at" + to_seconds(delay) WHEN target = 'accepted' THEN "at" END,
            over, CASE WHEN over THEN until END, held, attempts, held_until
          FROM (SELECT *, CASE WHEN NOT CASE held WHEN 'accepted' THEN target = 'processing' WHEN 'processing' THEN target IN ('succeeded', 'retry_scheduled', 'dead_lettered') WHEN 'retry_scheduled' THEN target IN ('processing', 'dead_lettered') WHEN 'dead_lettered' THEN target = 'accepted' ELSE false END THEN 'invalid'
              WHEN target = 'processing' AND "at" > TIMESTAMP '2024-01-28' THEN 'deadline' WHEN target = 'processing' AND attempts >= 3 THEN 'exhausted' WHEN target IN ('retry_scheduled', 'dead_lettered') AND error IS NULL THEN 'no error'
              WHEN target = 'retry_scheduled' AND attempts >= 3 THEN 'exhausted' WHEN target = 'accepted' AND NOT granted THEN 'not granted' ELSE 'ok' END AS said
            FROM (SELECT *, CASE WHEN over AND attempts < 3 THEN 'retry_scheduled' WHEN over THEN 'dead_lettered' ELSE state END AS held, CASE WHEN over AND attempts < 3 THEN until + to_seconds(delay) WHEN over THEN NULL ELSE until END AS held_until
              FROM (SELECT *, least(3600, doubled + CAST('0x' || substr(sha256(job || ':' || attempts), 1, 4) AS INTEGER) % (greatest(1, doubled // 5) + 1)) AS delay
                FROM (SELECT e.job, e.i, e.seq, e."at", e.granted, e.error, e.target, r.state, r.attempts, r.until, r.state = 'processing' AND r.until <= e."at" AS over, least(3600, 30 * CAST(pow(2, greatest(r.attempts, 1) - 1) AS INTEGER)) AS doubled FROM r JOIN e ON e.job = r.job AND e.i = r.i + 1)))))
        SELECT job, seq, "at", from_state, state AS to_state, verdict, attempts, until FROM r WHERE i > 0 UNION ALL SELECT job, NULL, lapsed_at, 'processing', lapsed_to, 'lapsed', lapsed_attempts, lapsed_until FROM r WHERE lapsed""",
)
def l_job_steps(spark, sf_dir):
    return jobs.run(_job_log(spark, sf_dir), jobs.Policy(first_state="accepted", lease_seconds=86400))


@query(
    "L08 L10",
    """SELECT c_custkey AS operation, CASE WHEN o.d IS NULL THEN 'new' WHEN o.d = c_mktsegment THEN 'reuse' ELSE 'conflict' END AS decision FROM customer LEFT JOIN (SELECT o_custkey, CASE MIN(o_orderkey) % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS d FROM orders WHERE o_totalprice > 300000 GROUP BY 1) o ON o_custkey = c_custkey""",
)
def l_replay(spark, sf_dir):
    first = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg((F.min("o_orderkey") % 3).alias("m"))
    done = first.select(F.col("o_custkey").alias("operation"), F.when(F.col("m") == 0, F.lit("BUILDING")).when(F.col("m") == 1, F.lit("MACHINERY")).otherwise(F.lit("HOUSEHOLD")).alias("payload"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("operation"), F.col("c_mktsegment").alias("payload"))
    return ledger.replay(asked, done).select("operation", "decision")


@query(
    "L11 L12 E15 G04",
    f"""WITH p AS (SELECT user_id, MIN(ts) AS since, MAX(ts) AS alerted FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-19' GROUP BY 1 HAVING COUNT(*) > 8), c AS (SELECT user_id FROM events WHERE event_type = 'error' AND ts < {EVENTS_NOW_SQL} GROUP BY 1 HAVING COUNT(*) > 9)
        SELECT COALESCE(p.user_id, c.user_id) AS user_id, CASE WHEN c.user_id IS NULL THEN 'recovered' WHEN p.user_id IS NULL THEN 'new' WHEN epoch_us({EVENTS_NOW_SQL}) - epoch_us(alerted) >= 24 * 3600e6 THEN 'remind' ELSE 'quiet' END AS action,
        COALESCE(since, {EVENTS_NOW_SQL}) AS since FROM p FULL JOIN c ON p.user_id = c.user_id""",
)
def l_alert_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    previous = e.where(F.col("ts") < ntz(dt.datetime(2024, 1, 19))).groupBy("user_id").agg(F.min("ts").alias("since"), F.max("ts").alias("alerted"), F.count("*").alias("n")).where("n > 8").drop("n")
    current = e.where(F.col("ts") < ntz(EVENTS_NOW)).groupBy("user_id").agg(F.count("*").alias("n")).where("n > 9").drop("n")
    return ledger.alert_plan(previous, current, "user_id", ntz(EVENTS_NOW)).select("user_id", "action", "since")


@query(
    "L04 L10 I08-I10",
    f"""WITH a AS (SELECT user_id, COUNT(*) AS n, MAX(ts) AS last FROM events WHERE event_type = 'error' AND ts < {EVENTS_NOW_SQL} GROUP BY 1) SELECT user_id, n < 15 AND epoch_us(last) + 86400000000 <= epoch_us({EVENTS_NOW_SQL}) AS due FROM a""",
)
def l_retry_due(spark, sf_dir):
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("ts") < ntz(EVENTS_NOW)))
    a = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return a.select("user_id", ledger.retry_due(F.col("n"), 15, F.col("last"), F.lit(86400), ntz(EVENTS_NOW)).alias("due"))


@query(
    "A02 A04 A39",
    """SELECT 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, CAST(o_totalprice AS DECIMAL(18,2)) AS initial_price, 'RUB' AS currency, '{"o_custkey":"' || CAST(o_custkey AS VARCHAR) || '","status":"' || o_orderstatus || '"}' AS raw FROM orders""",
)
def a_canonical_records(spark, sf_dir):
    from ..sources import files

    o = table(spark, sf_dir, "orders")
    texts = o.select(F.lit(" Orders").alias("source"), F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("initial_price"), F.lit("rub").alias("currency"), F.col("o_custkey").cast("string"), F.col("o_orderstatus").alias("status"))
    return files.records(texts, "file").select("source", "external_id", "title", "initial_price", "currency", "raw")


@query("A24-A26 A47 A48")
def a_extracted_texts(spark, sf_dir):
    from ..sources import documents

    p = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, F.lit(".bin")).otherwise(F.lit(".html"))).alias("name"), F.col("html").cast("binary").alias("content"))
    return documents.texts(p).select("name", "title", "status", "gap", F.length("text").alias("chars"))
