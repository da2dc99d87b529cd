"""Jobs: leases, attempts, deadlines and redrives; the stream gives what the batch gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkweir.operators import folds, jobs
from sparkweir.streaming import jobs as stream_jobs

T = dt.datetime(2024, 1, 1)
LOG = "job string, at timestamp, seq long, target string, owner string, error string, granted boolean, deadline timestamp, until string, state string"
POLICY = jobs.Policy(first_state="accepted", max_attempts=2, lease_seconds=60)


def log(spark, rows):
    """rows: (job, seconds, target, owner, error, granted, deadline in seconds)."""
    after = lambda s: None if s is None else T + dt.timedelta(seconds=s)
    return spark.createDataFrame([(j, after(s), i, t, o, e, g, after(d), "u", "s") for i, (j, s, t, o, e, g, d) in enumerate(rows)], LOG)


ROWS = [
    ("a", 0, "processing", "w", None, None, None),
    ("a", 10, "succeeded", None, None, None, None),
    ("a", 20, "processing", "w", None, None, None),  # after its end
    ("b", 0, "processing", None, None, None, None),  # no owner
    ("b", 1, "processing", "w", None, None, None),
    ("b", 100, "processing", "w", None, None, None),  # the lease ran out at 61
    ("b", 130, "retry_scheduled", None, "E", None, None),  # no attempt is left
    ("b", 131, "dead_lettered", None, None, None, None),  # no error
    ("b", 132, "dead_lettered", None, "E", None, None),
    ("b", 140, "accepted", None, None, None, None),  # nobody has granted it
    ("b", 141, "accepted", None, None, True, None),
    ("b", 150, "processing", "w", None, None, 149),  # too late
    ("b", 151, "processing", "w", None, None, 500),
    ("c", 5, "processing", "w", None, None, None),
    ("c", 200, "cancelled", None, None, None, None),
    (None, 5, "processing", "w", None, None, None),
    ("d", None, "processing", "w", None, None, None),
    ("e", 7, None, None, None, None, None),
]


def told(df):
    return sorted(((r.job, r.seq if r.seq is not None else -1, r.to_state, r.verdict, r.attempts) for r in df.collect()))


def test_steps_of_a_log(spark):
    got = told(jobs.run(log(spark, ROWS).repartition(3), POLICY, until=T + dt.timedelta(seconds=1000)))
    assert got == sorted(
        [
            ("a", 0, "processing", "ok", 1), ("a", 1, "succeeded", "ok", 1), ("a", 2, "succeeded", "invalid", 1),
            ("b", 3, "accepted", "no owner", 0), ("b", 4, "processing", "ok", 1), ("b", -1, "retry_scheduled", "lapsed", 1), ("b", 5, "processing", "ok", 2), ("b", 6, "processing", "exhausted", 2), ("b", 7, "processing", "no error", 2),
            ("b", 8, "dead_lettered", "ok", 2), ("b", 9, "dead_lettered", "not granted", 2), ("b", 10, "accepted", "ok", 0), ("b", 11, "accepted", "deadline", 0), ("b", 12, "processing", "ok", 1), ("b", -1, "retry_scheduled", "lapsed", 1),
            ("c", 13, "processing", "ok", 1), ("c", -1, "retry_scheduled", "lapsed", 1), ("c", 14, "cancelled", "ok", 1), ("e", 17, "accepted", "invalid", 0),
        ]
    )
    assert jobs.run(log(spark, []), POLICY).count() == 0


def test_delays_double_up_to_a_cap():
    seconds = [jobs.Policy().delay("x", n).total_seconds() for n in range(1, 12)]
    assert all(30 * 2**n <= s <= min(3600, 30 * 2**n * 1.2) for n, s in enumerate(seconds[:7])) and seconds[8:] == [3600] * 3


def test_stream_and_batch_agree(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r for r in ROWS if r[0] and r[1] is not None]
    later = [("z", 100_000, "processing", "w", None, None, None)]
    folder = str(tmp_path / "in")
    try:
        for part in (lambda s: s < 100, lambda s: 100 <= s < 145, lambda s: 145 <= s):
            whole = log(spark, rows + later)
            some = whole.where(F.udf(lambda at: part((at - T).total_seconds()), "boolean")("at"))
            some.coalesce(1).write.mode("append").parquet(folder)
            steps = stream_jobs.run(spark.readStream.schema(whole.schema).parquet(folder), "1 second", POLICY)
            # Each run goes on from the checkpoint of the one before.
            steps.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(90)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert told(spark.read.parquet(str(tmp_path / "out"))) == told(jobs.run(log(spark, rows + later), POLICY, until=T + dt.timedelta(seconds=99_999)))


def test_a_key_of_many_rows_is_folded_in_order(spark):
    """One key with most of the rows: the task holds a number, not the rows."""
    df = spark.range(300_000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("n"), "id")
    schema = spark.createDataFrame([], "k string, n long, place long").schema

    def step(state, row):
        assert row["n"] >= state[1]
        state[:] = state[0] + 1, row["n"]
        return [(row["k"], row["n"], state[0])]

    got = folds.fold(df, ["k"], ["n"], schema, lambda key: [0, -1], step).groupBy("k").agg(F.count("*").alias("n"), F.max("place").alias("last"))
    expected = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert {r.k: (r.n, r["last"]) for r in got.collect()} == {k: (n, n) for k, n in expected.items()}


@pytest.mark.parametrize("rows", [[], [(None, 1, 5), (None, 2, 7), ("a", 1, None)]])
def test_folds_of_null_keys_and_no_rows(spark, rows):
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = folds.fold(df, ["k"], ["o"], spark.createDataFrame([], "k string, s long").schema, lambda key: [key[0], 0], lambda s, r: s.__setitem__(1, s[1] + (r["v"] or 0)) or (), lambda s: [tuple(s)])
    assert sorted(((r.k or ""), r.s) for r in got.collect()) == ([("", 12), ("a", 0)] if rows else [])
