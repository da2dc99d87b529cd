"""Plans and results that the third review asked for: what grows with the output is neither sent nor shuffled, and the rest agrees with its SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkweir.functions import jsonx
from sparkweir.operators import excerpts, joins, lexicon, matching, near, rules
from sparkweir.plans import REGISTRY
from sparkweir.sources import documents

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_texts_sends_no_stretches(spark):
    """F1"""
    df = spark.createDataFrame([(1, 1, "some words that are told here"), (1, 2, "some words that are told there")], "g int, at int, text string")
    assert "BroadcastHashJoin" not in plan(near.without_near(df, "g", "at", "text"))


def test_either_key_gives_each_pair_once_without_a_shuffle_of_pairs(spark):
    """F2"""
    left = spark.createDataFrame([(1, 5, 7), (1, 5, 8), (2, 6, 5), (3, None, 9), (None, 6, 7), (None, 6, 7), (4, 5, 5)], "id int, a int, b int")
    right = spark.createDataFrame([(5, 7), (5, 5), (6, 5), (6, 5), (None, 9), (8, 8)], "x int, y int")
    got = joins.either_key(left, right, [("a", "x"), ("b", "y")], "id").select("id", "x", "y")
    rows = {(l.id, r.x, r.y) for l in left.collect() for r in right.collect() if (l.a is not None and l.a == r.x) or (l.b is not None and l.b == r.y)}
    order = lambda some: sorted(map(tuple, some), key=str)
    assert order(got.collect()) == order(rows)
    assert got._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "Union"


def test_scalars_are_those_of_their_sql(spark, tmp_path):
    """F3"""
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, 0, 250_000), "error", v, "{}") for v in (1.005, 0.285, -0.285, 2.675, 29.27)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    q = REGISTRY["d_scalars"]
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        assert tuple(q.run(spark, str(tmp_path)).first()) == c.execute(q.sql).fetchone()


@pytest.mark.parametrize(("place", "spans"), [(161, [(0, 180)]), (162, [(0, 180), (82, 325)])])
def test_a_window_with_just_its_share_in_common_is_left_out(spark, place, spans):
    """99 of 180 characters are 0.55 of them, though 0.55 * 180 is more than 99 in doubles."""
    text = "x" * 17 + "the" + "x" * (place - 20) + "the" + "x" * 200
    got = spark.createDataFrame([(text,)], "t string").select(excerpts.budgeted(F.col("t"), [(["the"], 3)], 80, 160, 10).alias("s")).first().s
    assert [tuple(x) for x in got] == spans


def test_each_word_is_looked_for_once(spark):
    """F5"""
    df = spark.createDataFrame([("a",)], "t string").select(excerpts.budgeted(F.col("t"), [(["ab", "c."], 2), (["d"], 1)], 5, 5, 4).alias("s"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert (text.count("split("), text.count("regexp_extract_all(")) == (3, 0)


def test_a_small_lexicon_is_sent_before_runs_are_shuffled(spark):
    """F6"""
    df, lex = spark.createDataFrame([(1, "one two")], "id int, text string"), spark.createDataFrame([("g", "two")], "group string, phrase string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = lexicon.hits(df, lex, "id", "text")
        assert "BroadcastHashJoin" in plan(hits)
        assert [tuple(r) for r in hits.collect()] == [(1, "g", "two", 0, 1, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_readiness_groups_parts_without_a_join(spark):
    """F7"""
    required = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 3), (3, None), (None, 4)], "k int, d int")
    processed = spark.createDataFrame([(1, 1, True), (1, 1, False), (1, 2, False), (2, 9, True), (3, None, True), (None, 4, True), (2, 3, None)], "k int, d int, has_text boolean")
    got = rules.readiness(required, processed, "k", "d")
    assert {r.k: tuple(r)[1:] for r in got.collect()} == {1: (2, 1, 0, 1, "not_processed"), 2: (1, 0, 1, 0, "missing"), 3: (1, 0, 1, 0, "missing"), None: (1, 0, 1, 0, "missing")}
    assert "Join" not in plan(got)


def test_stretches_meet_by_short_keys_and_are_not_sent(spark):
    """F8"""
    df = spark.createDataFrame([("s", "some longer address"), ("s", "longer address")], "g string, t string")
    text = plan(matching.within(df, df))
    assert "unhex(md5(" in text and "BroadcastHashJoin" not in text


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_stretches_that_no_inner_text_has_are_not_shuffled(spark):
    """F8"""
    texts = spark.range(3000).select(F.lit("s").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    some = texts.limit(20).select("g", F.explode(F.array(F.col("t").substr(9, 20), F.col("t").substr(30, 7))).alias("t"))
    before = shuffled(spark)
    got = matching.within(texts, some).collect()
    assert len(got) == 40 and all(r.inner in r.outer for r in got)
    assert shuffled(spark) - before < 20_000  # there are 333,000 stretches


def test_texts_come_back_in_parts(spark):
    """F9"""
    df = documents.texts(spark.createDataFrame([("a.txt", bytearray(b"one")), ("b.bin", None)], "name string, content binary"))
    assert "MapInArrow" in plan(df)
    assert [tuple(r) for r in df.collect()] == [("a.txt", "a.txt", "extracted", "one", None), ("b.bin", "b.bin", "empty", None, None)]


def test_one_worker_searches_json(spark):
    """F10"""
    df = REGISTRY["j_recursive_search"].run(spark, SF)
    assert plan(df).count("ArrowEvalPython") == 1
    texts = spark.createDataFrame([('{"b": [1, {"api_key": null}], "a": 1.50}',), (None,), ("null",)], "j string")
    one = texts.select(jsonx.has_secret_key("j"), jsonx.corpus(30000)("j"), jsonx.canonical_json("j"), jsonx.structure("j").alias("s")).select("*", "s.*").drop("s")
    assert [tuple(r) for r in texts.select(jsonx.searched()("j").alias("f")).select("f.*").collect()] == [tuple(r) for r in one.collect()]
