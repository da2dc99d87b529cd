"""Texts within texts, and the four rules by which stored files are wanted documents, against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkweir.operators import matching


def test_within_equals_a_plain_loop(spark):
    rnd = random.Random(2)
    words = ["", "a", "ab", "abc", "xyz", "report", "annual report 2024", "annual report", "ééé", "ééé and more of it", None]
    texts = words + ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30))) for _ in range(80)]
    outer, inner = ([(rnd.choice(["g", "h", None]), t) for t in rnd.choices(texts, k=150)] for _ in range(2))
    got = {tuple(r) for r in matching.within(*(spark.createDataFrame(x, "g string, t string") for x in (outer, inner))).collect()}
    assert got == {(g, o, i) for g, o in outer for h, i in inner if g and g == h and o is not None and i is not None and i in o}


def test_common_tails_and_heads_make_no_pairs(spark):
    n = 100_000
    urls = spark.range(n).select(F.col("id"), F.lit("one.host").alias("g"), F.concat(F.lit("https://one.host/catalogue/items/"), F.sha2(F.col("id").cast("string"), 256).substr(1, 20), F.lit("?utm_source=newsletter&utm_medium=email")).alias("t"))
    extra = spark.createDataFrame([(n, "one.host", "https://one.host/catalogue/items/x"), (n + 1, "one.host", "see https://one.host/catalogue/items/x now")], "id long, g string, t string")
    start = time.time()
    found = matching.within(urls.unionByName(extra), urls.unionByName(extra))
    assert found.where(F.col("outer") != F.col("inner")).count() == 1
    assert time.time() - start < 90  # all pairs of the tail would be ten thousand millions


def compacted(name):
    name = re.sub(r"\.[a-z0-9]{1,8}\b", " ", (name or "").lower().replace("ё", "е"))
    return " ".join(re.sub(r"[^\w]+|_", " ", name).split())


def rule(s, w):
    _, _, url, filename, path = s
    _, _, i, w_url, names = w
    clean = lambda x: (x or "").strip(" ")
    if clean(i):
        if clean(url) and clean(url) == clean(w_url):
            return 1
        if clean(filename).startswith((f"{clean(i)}_", f"{clean(i)}-")):
            return 2
        if f"/{clean(i)}_" in clean(path).replace("\\", "/"):
            return 3
    have = [h for h in map(compacted, (filename, path)) if h]
    return 4 if any(n in h or h in n for h in have for n in map(compacted, names or []) if n) else None


def test_document_matches_equal_the_rules(spark):
    rnd = random.Random(9)
    ids = ["7", "12", "a_b", "x-1", "", None, " 7 "]
    names = ["Technical spec.pdf", "spec", "Смета.xlsx", "тЁмный лес", "contract v2.docx", "", None, "...", "7"]
    pick = lambda *x: rnd.choice(x)
    url = lambda: pick("http://d/7", "http://d/12", "", None, " http://d/7 ")
    stored = [(pick("t1", "t2", None), n, url(), pick(*names, "7_spec.pdf", "12-x.doc", "a_b_c.pdf", "x-1-2.pdf", "_.pdf"), pick("store/t1/7_a.pdf", "store\\12_b\\c.doc", "7_a.pdf", "", None, "/a_b_c/d")) for n in range(60)]
    wanted = [(pick("t1", "t2", None), 100 + n, pick(*ids), url(), pick([pick(*names), pick(*names)], [], None, [None])) for n in range(40)]
    s = spark.createDataFrame(stored, "tender string, stored_id int, url string, filename string, path string").withColumn("rule", F.lit(9))
    w = spark.createDataFrame(wanted, "tender string, wanted_id int, id string, url string, names array<string>").withColumn("outer", F.lit(1))
    got = {(r.stored_id, r.wanted_id): r.rule for r in matching.document_matches(s, w, "tender").collect()}
    expected = {(a[1], b[1]): rule(a, b) for a in stored for b in wanted if a[0] and a[0] == b[0]}
    assert got == {k: v for k, v in expected.items() if v}
    assert set(got.values()) == {1, 2, 3, 4}


@pytest.mark.parametrize("empty", ["stored", "wanted"])
def test_document_matches_of_an_empty_table(spark, empty):
    s = spark.createDataFrame([("t", 1, "u", "7_x.pdf", "p")][: empty != "stored"], "tender string, stored_id int, url string, filename string, path string")
    w = spark.createDataFrame([("t", 2, "7", "u", ["x"])][: empty != "wanted"], "tender string, wanted_id int, id string, url string, names array<string>")
    assert matching.document_matches(s, w, "tender").count() == 0
