"""Ties, nulls and boundaries that the supplied tables don't have."""

import datetime as dt

from pyspark.sql import functions as F

from sparkweir.functions import dates, jsonx, text
from sparkweir.operators import cascade, checks, evaluation, joins, latest, ledger, quality, ranking, rules, upsert

T = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **values):
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], schema).select(column).first()[0]


def test_latest_takes_the_larger_id_in_a_tie_and_null_times_first(spark):
    df = spark.createDataFrame([(1, T, 1), (1, T, 2), (2, None, 3), (2, T, 4)], "k int, ts timestamp, id int")
    assert rows(latest.latest(df, ["k"], [F.col("ts").desc_nulls_first(), F.col("id").desc()]).select("k", "id")) == [(1, 2), (2, 3)]


def test_filter_before_latest_differs_from_filter_after(spark):
    df = spark.createDataFrame([(1, 1, "go"), (1, 2, "no_go")], "k int, id int, v string")
    order = [F.col("id").desc()]
    assert rows(latest.latest(df.where("v = 'go'"), ["k"], order).select("k", "id")) == [(1, 1)]
    assert rows(latest.latest(df, ["k"], order).where("v = 'go'").select("k", "id")) == []
    assert rows(latest.join_latest(df.select("k").distinct(), df, ["k"], order, where=F.col("v") == "go").select("k", "id")) == [(1, 1)]


def test_fan_out_is_kept_by_replace_kind_and_not_by_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert rows(upsert.replace_kind(target, new, ["k"])) == [(1, "x"), (1, "y"), (2, "b")]
    assert rows(upsert.upsert(target, new, ["k"], [F.col("v").desc()])) == [(1, "y"), (2, "b")]
    assert rows(upsert.insert_once(target, new.unionAll(spark.createDataFrame([(3, "z")], "k int, v string")), ["k"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, "z")]
    assert rows(upsert.delete(target, new, ["k"])) == [(2, "b")]
    assert rows(upsert.set_column(target, spark.createDataFrame([(2, "q")], "k int, v string"), "k", "v")) == [(1, "a"), (2, "q")]


def test_price_bands_are_half_open(spark):
    band = quality.price_band(F.col("p"), [3e6, 1e7, 5e7], ["<3M", "3-10M", "10-50M", "50M+"])
    df = spark.createDataFrame([(x,) for x in (None, 0.0, -1.0, float("nan"), 2999999.0, 3e6, 1e7, 5e7)], "p double")
    assert [r[0] for r in df.select(band).collect()] == ["unknown"] * 4 + ["<3M", "3-10M", "10-50M", "50M+"]


def test_missing_times_pass_or_not(spark):
    null = F.lit(None).cast("timestamp")
    now = F.lit(T)
    assert one(spark, dates.not_before(null, now)) is True
    assert one(spark, dates.after(null, now)) is False
    assert one(spark, dates.fresh(null, now, 10)) is False
    assert one(spark, dates.cooling(null, now, 10)) is True
    assert one(spark, dates.fresh(F.lit(T - dt.timedelta(seconds=10)), now, 10)) is True
    assert one(spark, dates.cooling(F.lit(T - dt.timedelta(seconds=10)), now, 10)) is False
    assert one(spark, dates.days_left(F.lit(T - dt.timedelta(hours=1)), now)) == -1


def test_date_texts(spark):
    assert one(spark, dates.parsed(F.lit("2024-05-01T10:00:00Z")).cast("string")) == "2024-05-01 10:00:00"
    assert one(spark, dates.parsed(F.lit("soon"))) is None
    assert one(spark, dates.deadline(F.lit("2024-05-01")).cast("string")) == "2024-05-01 23:59:59"
    assert str(one(spark, dates.short_date(F.lit("1.2.24")))) == "2024-02-01"
    assert one(spark, dates.short_date(F.lit("31.02.2024"))) is None
    assert str(one(spark, dates.decimal(F.lit("1 234,50")))) == "1234.50"
    assert str(one(spark, dates.decimal(F.lit("1,234.50")))) == "None"
    assert one(spark, dates.money(F.lit(1234567.5))) == "1 234 568"


def test_cyrillic_and_short_tokens(spark):
    assert one(spark, text.normal(F.lit("ЁЛКА"))) == "елка"
    assert one(spark, text.collapsed(F.lit("  Ёж\n\t Б "))) == "еж б"
    assert one(spark, text.token_match(F.lit("пикап"), "пик")) is False
    assert one(spark, text.token_match(F.lit("серверный"), "сервер")) is True
    assert one(spark, text.phone_core(F.lit("+7 (999) 123-45-67"))) == "9991234567"
    assert one(spark, text.phones_found(F.lit("8 999 123 45 67; 123"), F.lit("tel 79991234567"))) == ["8 999 123 45 67"]
    assert one(spark, text.stems_found(F.lit("Иванов Пётр"), F.lit("иванова петра"))) is True
    assert one(spark, text.first_filled(F.lit(" "), F.lit(None), F.lit(" x "))) == "x"
    assert one(spark, text.disposition_name(F.lit("attachment; filename=\"a.txt\"; filename*=UTF-8''b%20c.txt"))) == "b c.txt"
    assert one(spark, text.cell_value(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, text.safe_member(F.lit("a/../../b"))) is False
    assert one(spark, text.meta_refresh(F.lit('<meta http-equiv="refresh" content="0; url=/x">'))) == "/x"
    assert one(spark, text.article_tokens(F.lit("switch AB-1200X and 100GB"))) == ["AB-1200X"]
    assert one(spark, text.days_near(F.lit("delivery within 7 days, warranty 90 days"), "deliver")) == [7]
    assert one(spark, text.distinct_ignoring_case(F.array(F.lit("A "), F.lit("a"), F.lit("b")), 5)) == ["A", "b"]
    assert one(spark, text.host_allowed(F.lit("https://a.example.com/x"), ["example.com"])) is True
    assert one(spark, text.host_allowed(F.lit("https://example.com.evil.net/"), ["example.com"])) is False
    assert one(spark, text.public_host(F.lit("http://127.0.0.1/"))) is False


def test_json(spark):
    assert one(spark, jsonx.as_object(F.lit("[1]"))) == "{}"
    assert one(spark, jsonx.as_object(F.lit("oops"))) == "{}"
    assert one(spark, jsonx.envelope(F.lit('{"report":{"a":1}}'))) == '{"a":1}'
    assert one(spark, jsonx.array_size(F.lit('{"a":[1,2]}'), "$.a")) == 2
    assert one(spark, jsonx.array_size(F.lit('{"a":3}'), "$.a")) == 0
    assert one(spark, jsonx.outer_object(F.lit('see {"a":1} end'))) == '{"a":1}'
    df = spark.createDataFrame([('{"a":[{"API-Key":1}]}',), ('{"keyboard":1}',), (None,), ("x",)], "j string")
    assert [r[0] for r in df.select(jsonx.has_secret_key("j")).collect()] == [True, False, None, False]
    assert one(spark, jsonx.canonical_json(F.lit('{"b": 1.50, "a": [2]}'))) == '{"a":[2],"b":1.5}'


def test_cascade_counts_every_row(spark):
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    out = cascade.shown_or_hidden(df, cascade.first_match([("zero", F.col("v") == 0)]), [F.col("id").asc()], 4)
    assert rows(cascade.reason_counts(out)) == [("over_limit", 2), ("shown", 4), ("zero", 4)]
    assert cascade.shown_or_hidden(df.where("id < 0"), cascade.first_match([("zero", F.col("v") == 0)]), [F.col("id").asc()], 4).count() == 0


def test_temporal_anti_join(spark):
    starts = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "k int, at int")
    ends = spark.createDataFrame([(1, 4), (2, 5), (3, 6), (3, 1)], "k int, at int")
    assert rows(joins.without_later(starts, ends, "k", "at")) == [(1, 5), (4, 5)]


def test_spans_and_bins(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 4, 12), (1, 9, 20)], "k int, a int, b int")
    assert rows(joins.overlapping(spans, ["k"], "a", "b", 0.55)) == [(1, 0, 10), (1, 9, 20)]
    packed = ranking.packed(spark.createDataFrame([(1, 1, 40), (1, 2, 70), (1, 3, 20), (1, 4, 300)], "k int, i int, n int"), ["k"], ["i"], F.col("n"), 100)
    assert [r["bin"] for r in packed.orderBy("i").collect()] == [0, 1, 1, 2]


def test_evaluation_edges(spark):
    cases = spark.createDataFrame([("a", "x", 1, []), ("b", "x", 1, ["y"]), ("c", "y", 2, []), ("d", "y", 1, ["failed"])], "case_id string, expected string, weight decimal(18,4), critical array<string>".replace("weight decimal(18,4)", "w int")).withColumn("weight", F.col("w").cast("decimal(18,4)"))
    kind = "case_id string, status string, predicted string, latency_ms int, cost decimal(20,8), fallback boolean, review_required boolean, review_completed boolean"
    predictions = spark.createDataFrame([("a", "ok", "x", None, None, None, None, None), ("b", "ok", "y", None, None, None, None, None), ("d", "failed", None, None, None, None, None, None)], kind)
    m = evaluation.gate(evaluation.metrics(evaluation.match_predictions(cases, predictions))).first()
    assert (m.n_cases, m.accuracy, m.critical_errors, m.failed, m.review_completion, m.latency_p95, m.mean_cost) == (4, 0.25, 3, 1, 1.0, None, None)
    assert m.weighted_loss == 0.8 and not m.released
    assert evaluation.unknown_predictions(cases.limit(0), predictions).count() == 3
    ranks = spark.range(1, 31).select(F.lit("c").alias("case_id"), F.lit("x").alias("expected"), F.lit(1).cast("decimal(18,4)").alias("weight"), F.array().cast("array<string>").alias("critical"), F.lit("ok").alias("status"), F.lit("x").alias("predicted"), F.col("id").cast("int").alias("latency_ms"), F.lit(None).cast("decimal(20,8)").alias("cost"), *[F.lit(None).cast("boolean").alias(c) for c in ("fallback", "review_required", "review_completed")])
    assert evaluation.metrics(ranks).first().latency_p95 == 29
    assert evaluation.confusion_map(ranks).first()[0] == {"x->x": 30}


def test_ledgers(spark):
    log = spark.createDataFrame([(1, 1, "claimed"), (1, 2, "released"), (2, 1, "sent")], "k int, at int, state string")
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert rows(ledger.claimable(items, log, ["k"], ["at"])) == [(1,), (3,)]
    wait = ledger.backoff_seconds(F.lit(20), F.lit("job"))
    assert 3600 <= one(spark, wait) <= 3615 and one(spark, wait) == one(spark, wait)
    assert one(spark, ledger.retry_due(F.lit(1), 2, F.lit(None).cast("timestamp"), F.lit(60), F.lit(T))) is True


def test_rules(spark):
    df = spark.createDataFrame([(1, 120, 1), (1, 115, 2), (2, 100, 1), (3, 150, 1), (3, 150, 2), (4, 130, 1)], "k int, score int, id int")
    assert rows(rules.primary(df, ["k"], "score", "id").select("k", "id", "selection")) == [(1, 1, "ambiguous"), (2, 1, "below_threshold"), (3, 1, "ambiguous"), (4, 1, "selected")]
    always, never = F.lit(True), F.lit(False)
    assert one(spark, rules.additive_score([(always, 200)], never, never, never)) == 25
    assert one(spark, rules.additive_score([(always, 200)], always, always, never)) == 60
    assert rules.alike("The quick brown fox jumps over", "xx the quick  brown fox jumps over yy")
    assert not rules.alike("short", "short and more")
    assert rules.sections("a\nSPEC\nb\nEND\nc", "^spec", "^end") == [{"start": 2, "title": "SPEC", "end": 9}]
    assert [w["start"] for w in rules.windows("aa bb aa bb aa", ["aa"], 2, 9)] == [0, 4, 10]
    risk = spark.createDataFrame([(1, -2.5, 1.0), (1, 2.9, 1.0), (2, 50.0, 3.0)], "k int, w double, s double")
    assert rows(rules.weighted_risk(risk, ["k"], "w", "s")) == [(1, 0, "low"), (2, 100, "high")]


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, -1)], "k int, v int")
    assert rows(checks.violations(df, {"positive": F.col("v") > 0})) == [("positive", 1)]
    assert rows(checks.duplicates(df, ["k"])) == [(1, 2)]
    assert rows(checks.without_parent(df, "k", spark.createDataFrame([(1,)], "id int"), "id")) == [(2, -1)]


def test_near_texts_compare_whole_texts(spark, tmp_path):
    from sparkweir.plans import REGISTRY

    import difflib
    import random

    rnd = random.Random(2)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    start, piece = some(200), some(60)
    talks = {1: [start + some(900), start + some(900)], 2: [some(400) + piece + some(100), piece], 3: [start + "x", start + "x"], 4: [some(300), some(300) + some(300), start]}
    spark.createDataFrame([(c, i, t) for c, texts in talks.items() for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    def alike(a, b):
        x, y = sorted((" ".join(t.lower().split()) for t in (a, b)), key=len)
        return x == y or len(x) >= 24 and x in y or difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.86

    expected = {}
    for c, texts in talks.items():
        kept = []
        for t in texts:
            if not any(alike(t, k) for k in kept):
                kept.append(t)
        expected[c] = (alike(*texts[:2]), len(kept))
    assert expected[1] == (False, 2) and expected[2] == (True, 1)
    assert {r.conv_id: (r.alike, r.kept) for r in REGISTRY["k_near_texts"].run(spark, str(tmp_path)).collect()} == expected


def test_contained_texts(spark):
    from sparkweir.operators.joins import contained

    texts = ["", "a", "ab", "://h/ab", "http://h/ab", "http://h/abc", "x://h/?u=http://h/ab", "http://h/ab", "abc", "bcabc", None, "é://h/" + "z" * 70, "z" * 70, "z" * 33]
    rows = [(i, g, t) for i, t in enumerate(texts) for g in ["g"]] + [(100, "other", "ab"), (101, None, "ab")]
    got = {tuple(r) for r in contained(spark.createDataFrame(rows, "id int, g string, t string"), "id", "t", "g").collect()}
    expected = {(i, j) for i, g, t in rows for j, h, u in rows if i != j and g is not None and g == h and t is not None and u is not None and u in t}
    assert got == expected
