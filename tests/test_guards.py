"""Guards with missing values, spans in texts against plain loops, and sources of one's own."""

import pytest
from pyspark.sql import functions as F

from sparkweir.operators import guards, rules
from sparkweir.plans import REGISTRY
from sparkweir.sources import documents, files, pluggable

SF = "/root/testdata/sf0.001"


def values(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def null(kind):
    return F.lit(None).cast(kind)


def test_missing_values_decide_nothing(spark):
    text, number, flag, texts = null("string"), null("int"), null("boolean"), null("array<string>")
    assert values(spark, guards.names_any(texts, ["a"]), guards.capped_decision(text), guards.capped_confidence(text, text, text, number, number)) == (False, None, None)
    assert values(spark, guards.lacks_specification(flag, [flag], [number, number]), guards.preliminary(number, flag, flag, flag, flag, flag)) == (False, False)
    assert values(spark, guards.important_unread(texts, number, ["a"], "a"), guards.no_go_reason(text, text, text, ("a",), ("b",)), guards.lacks_evidence(flag, text, number, texts, [])) == (False, "no_go", True)
    guard = guards.guarded_offer(flag, F.lit(True), texts, texts, text, ["safe"], "check")
    assert values(spark, guard["applied"], guard["offer"], guard["risks"], guard["level"]) == (False, None, [], None)


def test_a_guarded_offer_keeps_a_high_level_and_names_the_check_once(spark):
    guard = guards.guarded_offer(F.lit(True), F.lit(True), F.array(F.lit("x")), F.array(F.lit("check")), F.lit("high"), ["safe"], "check")
    assert values(spark, guard["applied"], guard["offer"], guard["risks"], guard["level"]) == (True, ["safe"], ["check"], "high")


def test_no_specification_is_known_only_by_counts(spark):
    lacks = lambda *counts: guards.lacks_specification(F.lit(False), [null("boolean")], [F.lit(c).cast("int") for c in counts])
    assert values(spark, lacks(None, None), lacks(0, None), lacks(None, 2), lacks(0, 2)) == (False, True, False, False)


def test_windows_and_sections_against_loops(spark):
    finder, sections = rules.window_finder(["the", "und", "que"], 40, 8), rules.section_finder(r"^\s*(the|der|la)\b", r"^\s*$|^[A-Z]{2,}")
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["", "the\n\nthe a\nAB\n la", "the the the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = {r.id: ([tuple(x) for x in r.w], [tuple(x) for x in r.s]) for r in df.select("id", finder("text").alias("w"), sections("text").alias("s")).collect()}
    for i, body in enumerate(texts):
        body, spans, at = body or "", [], 0
        low = body.lower()
        while at < len(body) and len(spans) < 8 and len(low) == len(body):
            word = next((w for w in ("the", "und", "que") if low.startswith(w, at)), None)
            if word:
                span = (max(0, at - 40), min(len(body), at + len(word) + 40))
                if not spans or span[0] >= spans[-1][1]:
                    spans.append(span)
            at += len(word or " ")
        if len(low) == len(body):
            assert found[i][0] == spans
        for a, b, title in found[i][1]:
            line = body[a:].split("\n")[0]
            assert title == line.strip()[:120] and line.strip().split()[0].lower().startswith(("the", "der", "la")) and (a == 0 or body[a - 1] == "\n") and a < b <= len(body)
            assert not any(x.strip() == "" for x in body[a:b].split("\n")[1:-1])


def test_pages_as_text(spark):
    page = "<head><title>T</title></head><body><p>One &amp; two</p><svg><text>no</text></svg><table><tr><td>a</td><td>b</td></tr></table><a href='/x?a=1&amp;b=2'>x</a><a href='#top'>t</a><a href='mailto:a@b.c'>m</a><script>var a = '<p>';</script></body>"
    got = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(documents.html_to_text("h").alias("t")).collect()
    assert got[0].t.links == ["/x?a=1&b=2"] and "One & two" in got[0].t.text.split("\n") and "a | b" in got[0].t.text and "no" not in got[0].t.text and "var" not in got[0].t.text
    assert got[1].t.text == "" == got[2].t.text


def test_a_source_that_repeats_its_cursor_is_an_error(spark):
    class Endless(pluggable.PagedSource):
        @classmethod
        def name(cls):
            return "weir_endless"

        def schema(self):
            return "n int"

        def fetch(self, shard, cursor):
            return [(1,)], "same"

    with pytest.raises(Exception, match="twice"):
        pluggable.read(spark, Endless).count()


def test_a_cursor_covers_all_files_of_a_folder(spark, tmp_path):
    path = str(tmp_path / "rows")
    files.write_separated(spark.range(6).select(F.col("id").cast("string")).repartition(3), path)
    first, cursor = files.page(spark, path, "tsv", ["id"], "id", None, 4)
    assert [r.id for r in first.collect()] == ["0", "1", "2", "3"]
    assert [r.id for r in files.page(spark, path, "tsv", ["id"], "id", cursor, 4)[0].collect()] == ["4", "5"]
    spark.range(6, 8).select(F.col("id").cast("string")).coalesce(1).write.mode("append").option("header", True).option("sep", "\t").csv(path)
    with pytest.raises(files.Refused):
        files.page(spark, path, "tsv", ["id"], "id", cursor, 4)
    with pytest.raises(files.Refused):
        files.page(spark, path, "tsv", ["id"], "id", limits=files.Limits(bytes=3))


def test_new_queries_are_registered_for_their_rows():
    assert {i for q in REGISTRY.values() for i in q.ids} >= {"A01", "A03", "A09", "A37", "H28", "H41", "K55", "K63", "L01", "M06"}
