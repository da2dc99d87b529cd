from pyspark.sql import functions as F

from sparkweir.functions import dates
from sparkweir.streaming import logs


def test_streams_of_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.unionAll(events).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing new the second time
        logs.write_once(logs.first_versions(stream(), ["event_id"], "ts", "60 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    logs.write_once(logs.window_counts(stream(), "ts", "1 day", "1 hour", ["event_type"]), str(tmp_path / "counts"), str(tmp_path / "state2")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "counts"))
    total = events.groupBy(F.to_date("ts").alias("d"), "event_type").agg((2 * F.count("*")).alias("n"))
    joined = found.join(total, (F.to_date("start") == F.col("d")) & (found.event_type == total.event_type))
    assert joined.count() == found.count() > 0 and joined.where(found.n != total.n).count() == 0


def test_past_dates_go_with_their_preposition(spark):
    df = spark.createDataFrame([("ship by 01.02.2020 or by 01.02.2030",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.without_past_dates("2024-01-01")("t")).collect()] == ["ship or by 01.02.2030", None]
