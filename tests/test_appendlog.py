"""A log that only grows: batches that come again, tasks that fail, rows without keys."""

import os

import pytest
from pyspark.sql import functions as F

from sparkweir.sources import appendlog

KIND = "k long, v string"


def held(spark, path):
    return sorted(tuple(r) for r in appendlog.read(spark, path, KIND).collect())


def test_batches_and_keys_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *some: spark.createDataFrame(list(some), KIND).repartition(3)
    assert held(spark, path) == [] and appendlog.commits(spark, path) == []
    appendlog.append_once(rows((1, "a"), (2, "b"), (2, "b")), path, "one", ["k"])
    appendlog.append_once(rows((1, "x"), (3, "c")), path, "two", ["k"])
    assert held(spark, path) == [(1, "a"), (2, "b"), (3, "c")]
    # The same batch again, and another one of that name: neither counts, and no file of theirs stays.
    files = set(os.listdir(f"{path}/rows"))
    appendlog.append(rows((1, "a"), (2, "b")), path, "one", ["k"])
    appendlog.append(rows((9, "z")), path, "two", ["k"])
    assert held(spark, path) == [(1, "a"), (2, "b"), (3, "c")] and set(os.listdir(f"{path}/rows")) == files
    appendlog.append_once(rows((4, None)).limit(0), path, "none", ["k"])
    assert [c["rows"] for c in appendlog.commits(spark, path)] == [0, 2, 1]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    appendlog.append_once(spark.createDataFrame([(0, "a")], KIND), path, "one", ["k"])
    failing = spark.range(1, 4000, numPartitions=4).select(F.col("id").alias("k"), F.when(F.col("id") == 3500, F.raise_error(F.lit("lost"))).otherwise(F.lit("v")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        appendlog.append(failing, path, "two", ["k"])
    assert held(spark, path) == [(0, "a")] and [c["batch"] for c in appendlog.commits(spark, path)] == ["one"]
    appendlog.append(failing.select("k", F.lit("v").alias("v")), path, "two", ["k"])
    assert len(held(spark, path)) == 4000


def test_rows_without_keys_and_overwriting_are_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    appendlog.append_once(spark.createDataFrame([(0, "a")], KIND), path, "one", ["k"])
    mixed = spark.createDataFrame([(1, "b"), (None, "c")], KIND).repartition(2)
    with pytest.raises(Exception, match="rows without k"):
        appendlog.append_once(mixed, path, "two", ["k"])
    with pytest.raises(Exception, match="only appended to"):
        mixed.write.format("append_log").mode("overwrite").options(path=path, batch="three", keys="k").save()
    assert held(spark, path) == [(0, "a")]
