"""Windows and budgeted excerpts against plain loops over whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkweir.operators import excerpts

SF = "/root/testdata/sf0.001"


def bodies(spark):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(["ab", "AB", "c.", " x ", "é", "12 ", "\n"]) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:40]
    return [*texts, *made, None, "", "ab" * 30_000, "c." + "-" * 500 + "ab"]


def plain_windows(text, pattern, before, after, most):
    out = []
    for m in re.finditer(pattern, text or ""):
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if len(out) < most and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def plain_budgeted(text, groups, before, after, most, each, share):
    kept = []

    def take(word, own, room):
        added = 0
        for m in re.finditer(re.escape(word), text or "", re.I):
            a, b = max(0, m.start() - before), min(len(text), m.end() + after)
            close = any((c := min(b, y) - max(a, x)) > 0 and c >= share * max(1, min(b - a, y - x)) for x, y in kept)
            if len(kept) < most and added < own and added < room and not close:
                kept.append((a, b))
                added += 1
        return added

    for words, budget in groups:
        used = 0
        for w in words:
            used += take(w, each, budget - used)
    for w in dict.fromkeys(w for words, _ in groups for w in words):
        take(w, 10**9, 10**9)
    return kept


@pytest.fixture(scope="module")
def table(spark):
    texts = bodies(spark)
    return texts, spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], "id int, text string, start string, kept string")


def test_windows(spark, table):
    texts, df = table
    got = {r.id: r for r in df.select("id", excerpts.windows(F.col("text"), ["ab", "c."], 5, 9, 7).alias("w"), excerpts.windows(F.col("text"), r"\d+", 3, 3, 4).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i].w] == plain_windows(t, r"(?i)ab|c\.", 5, 9, 7)
        assert [tuple(x) for x in got[i].n] == plain_windows(t, r"[0-9]+", 3, 3, 4)


def test_budgets_of_groups(spark, table):
    texts, df = table
    groups = [(["ab", "c."], 3), (["x", "the"], 2), (["12"], 1)]
    spans = excerpts.budgeted(F.col("text"), groups, 6, 10, 9)
    got = {r.id: r for r in df.select("id", spans.alias("w"), excerpts.cut(F.col("text"), spans).alias("t")).collect()}
    for i, t in enumerate(texts):
        expected = plain_budgeted(t, groups, 6, 10, 9, 2, 0.55)
        assert [tuple(x) for x in got[i].w] == expected and got[i].t == [t[a:b] for a, b in expected]


def test_sections(spark, table):
    from sparkweir.operators import rules

    texts, df = table
    texts = texts + ["the a\nb\n" * 500, "\n".join(["the x" + "y" * 90] * 200), " THE end\r\n\nla"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for start, stop, most in ((r"^\s*(the|der|la|ab)\b", r"^\s*$|^[A-Z]{2,}", 6000), ("ab|the", "c|12", 40)):
        got = {r.id: [tuple(x) for x in r.s] for r in df.select("id", excerpts.sections(F.col("text"), start, stop, most).alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(x["start"], x["end"], x["title"]) for x in rules.sections(t, start, stop, most)], (i, (t or "")[:80])


def test_no_python_in_the_plan(table):
    plan = table[1].select(excerpts.budgeted(F.col("text"), [(["ab"], 2)], 5, 5, 4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
