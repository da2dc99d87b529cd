"""Near texts of large groups in blocks, and of many small groups without a row for each stretch."""

import difflib
import random

from pyspark.sql import functions as F

from sparkweir.operators import near


def alike(a, b):
    x, y = sorted((a, b), key=lambda t: (len(t), t))
    return len(x) >= 24 and x in y or difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.86


def test_blocks_of_a_large_group_find_each_pair_once(spark, monkeypatch):
    """F2"""
    monkeypatch.setattr(near, "TEXTS", 7)
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    base = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(12)]
    texts = sorted({t for b in base for t in (b, b.replace("word1", "wort1"), b[10:50], b + " and more")})
    rows = [(g, f"{g}{i}".encode(), i, t) for g in (1, None) for i, t in enumerate(texts)]
    got = near.near_texts(spark.createDataFrame(rows, "g int, k binary, p int, t string")).collect()
    close = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and alike(a, b)}
    assert len(close) > 50
    assert sorted((bytes(r.k).decode(), r.p) for r in got) == sorted((f"{g}{i}", j) for g in (1, None) for i, j in close)


def test_near_texts_shuffle_texts_and_not_their_stretches(spark):
    """F2"""
    df = spark.range(400).select((F.col("id") % 200).alias("g"), F.col("id").alias("at"), F.concat(*[F.sha2((F.col("id") * 9 + i).cast("string"), 256) for i in range(8)]).alias("text")).repartition(3)
    sc = spark.sparkContext

    def shuffled():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert all(r.kept and r.near == [] for r in near.without_near(df, "g", "at", "text").collect())
    assert shuffled() - before < 10_000  # 204,400 pairs of neighbouring characters


def test_common_subsequences_bound_what_matches():
    """F2"""
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 30))) for _ in range(2))
        masks = {c: sum(1 << i for i, x in enumerate(b) if x == c) for c in set(b)}
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_next(row, x, b)]
        assert near._common(masks, len(b), a) == row[-1] >= near.matching(a, b)


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out[1:]
