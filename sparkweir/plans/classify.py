"""Queries over the rule engine: documents and pages under a small lexicon, orders and events as cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import cascade, lexicon, near, rules
from .registry import query, table
from .selections import NOW, NOW_SQL, ntz

#: The lexicon of the queries: our own words, in the languages of the documents.
LEXICON = {"english": ["the ", " and "], "german": ["der ", " und "], "romance": ["que ", " de la "], "money": ["$$$", "price"], "contact": ["@", "http"]}
MARKERS = [("german", ["und ", "der "]), ("english", ["the ", "and "]), ("romance", ["que ", "los "])]


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_FLAGS = {k: _any("b", v) for k, v in LEXICON.items()}


@query(
    "K01 K02",
    f"""WITH d AS (SELECT doc_id, lower(substr(text, 1, 60)) AS t, lower(substr(text, 1, 60) || ' ' || text) AS b FROM documents)
        SELECT doc_id, ({_any("b", ["the ", "der "])} OR {_any("t", ["que "])}) AND NOT ({_any("b", ["!!", "***"])} AND NOT {_any("b", ["password"])}) AS accepted,
        list_filter([CASE WHEN contains(b, 'the ') THEN 'the ' END, CASE WHEN contains(b, 'der ') THEN 'der ' END, CASE WHEN contains(t, 'que ') THEN 'que ' END], lambda x: x IS NOT NULL)[1] AS hit FROM d""",
)
def k_lexical_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    g = rules.gate(F.substring("text", 1, 60), F.col("text"), ["the ", "der "], ["que "], ["!!", "***"], ["password"])
    return d.select("doc_id", g.alias("g")).select("doc_id", "g.accepted", "g.hit")


#: Rules over the groups of the lexicon, the first that holds; taken passages win over shouting, contacts over both.
RULES = [
    lexicon.Rule("contact", any=("contact",), unless=("taken",)),
    lexicon.Rule("taken", any=("taken",), least=2),
    lexicon.Rule("mixed", all=("english", "german")),
    lexicon.Rule("headed", title=("opening",), unless=("romance",)),
    lexicon.Rule("german", any=("german",)),
]
_TOKENS = r"list_filter(regexp_split_to_array(replace(lower(COALESCE({0}, '')), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(
    "K01-K03 K13 K17-K20 H05-H07",
    rf"""WITH own AS (SELECT unnest(['english', 'english', 'german', 'german', 'romance', 'romance', 'contact', 'contact']) AS g, unnest(['the', 'and', 'der', 'und', 'que', 'de la', 'password', 'token*']) AS phrase),
        open AS (SELECT 'opening' AS g, array_to_string({_TOKENS.format("title")}[1:2], ' ') AS phrase FROM (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)),
        taken AS (SELECT 'taken' AS g, unnest([array_to_string(w[1:5], ' '), array_to_string(w[6:10], ' '), array_to_string(w[11:15], ' ')]) AS phrase FROM (SELECT {_TOKENS.format("text")} AS w FROM benchmark)),
        x AS (SELECT DISTINCT g, ' ' || replace(phrase, '*', '') || CASE WHEN phrase LIKE '%*' THEN '' ELSE ' ' END AS phrase FROM (SELECT * FROM own UNION ALL SELECT * FROM open UNION ALL SELECT * FROM taken) WHERE phrase <> ''),
        d AS (SELECT doc_id, ' ' || array_to_string({_TOKENS.format("text")}, ' ') || ' ' AS b, ' ' || array_to_string({_TOKENS.format("substr(text, 1, 60)")}, ' ') || ' ' AS t FROM documents),
        n AS (SELECT doc_id, g, SUM(CAST((length(replace(b, ' ', '  ')) - length(replace(replace(b, ' ', '  '), replace(phrase, ' ', '  '), ''))) / length(replace(phrase, ' ', '  ')) AS BIGINT)) AS n FROM d JOIN x ON contains(b, phrase) GROUP BY 1, 2),
        h AS (SELECT doc_id, bool_or(g = 'opening') AS opening FROM d JOIN x ON contains(t, phrase) GROUP BY 1),
        f AS (SELECT d.doc_id, COALESCE(opening, false) AS opening, COALESCE(m['contact'], 0) AS contact, COALESCE(m['taken'], 0) AS taken, COALESCE(m['english'], 0) AS english, COALESCE(m['german'], 0) AS german, COALESCE(m['romance'], 0) AS romance, COALESCE(signals, '') AS signals
              FROM d LEFT JOIN (SELECT doc_id, map_from_entries(list((g, n))) AS m, string_agg(g, ',' ORDER BY g) AS signals FROM n GROUP BY 1) USING (doc_id) LEFT JOIN h USING (doc_id))
        SELECT doc_id, CASE WHEN contact > 0 AND taken = 0 THEN 'contact' WHEN taken >= 2 THEN 'taken' WHEN english > 0 AND german > 0 THEN 'mixed' WHEN opening AND romance = 0 THEN 'headed' WHEN german > 0 THEN 'german' ELSE 'other' END AS decision, signals FROM f""",
)
def k_lexicon_rules(spark, sf_dir):
    """Rules over a lexicon of which most is a table: openings of titles and runs of five words of benchmark items."""
    own = spark.createDataFrame([(g, p) for g, some in {"english": ["the", "and"], "german": ["der", "und"], "romance": ["que", "de la"], "contact": ["password", "token*"]}.items() for p in some], "group string, phrase string")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    opening = table(spark, sf_dir, "pages").select(F.lit("opening").alias("group"), F.array_join(F.slice(lexicon.words(title), 1, 2), " ").alias("phrase"))
    w = lexicon.words(F.col("text"))
    taken = table(spark, sf_dir, "benchmark").select(F.lit("taken").alias("group"), F.explode(F.array(*[F.array_join(F.slice(w, at, 5), " ") for at in (1, 6, 11)])).alias("phrase"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 60).alias("title"))
    decided = lexicon.decide(docs, own.unionByName(opening).unionByName(taken), "doc_id", "title", "text", RULES, "other")
    return decided.select("doc_id", "decision", F.array_join("signals", ",").alias("signals"))


@query(
    "K14 K17 K20",
    f"""WITH d AS (SELECT doc_id, lower(text) AS b FROM documents), f AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in _FLAGS.items())} FROM d),
        r AS (SELECT *, CASE WHEN money AND NOT contact THEN 'offer' WHEN contact AND english THEN 'lead' WHEN german AND english THEN 'mixed' WHEN romance THEN 'romance' ELSE 'plain' END AS reason FROM f)
        SELECT doc_id, reason, CASE reason WHEN 'offer' THEN 'none' WHEN 'lead' THEN 'good' WHEN 'mixed' THEN 'poor' WHEN 'romance' THEN 'good' ELSE 'poor' END AS fit, CASE reason WHEN 'offer' THEN 'no_go' WHEN 'lead' THEN 'go' WHEN 'mixed' THEN 'maybe' WHEN 'romance' THEN 'maybe' ELSE 'maybe' END AS recommendation,
        concat_ws(',', {", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in LEXICON)}) AS signals, CASE WHEN money AND NOT contact AND NOT english THEN 'noise' WHEN contact OR english THEN 'strong' WHEN german THEN 'weak' ELSE 'none' END AS strength FROM r""",
)
def k_assessment(spark, sf_dir):
    f = {group: F.col("f")[group] for group in LEXICON}
    made = rules.assessment(
        [("offer", f["money"] & ~f["contact"], "none", "no_go"), ("lead", f["contact"] & f["english"], "good", "go"), ("mixed", f["german"] & f["english"], "poor", "maybe"), ("romance", f["romance"], "good", "maybe")],
        ("poor", "maybe", "plain"),
    )
    n = lambda *names: sum(f[x].cast("int") for x in names[1:]) + f[names[0]].cast("int")
    strength = rules.signal_strength(n("contact", "english"), n("german"), f["money"])
    return table(spark, sf_dir, "documents").select("doc_id", rules.flagged(F.col("text"), LEXICON).alias("f")).select("doc_id", made.alias("a"), F.array_join(cascade.all_matches(list(f.items())), ",").alias("signals"), strength.alias("strength")).select("doc_id", "a.reason", "a.fit", "a.recommendation", "signals", "strength")


@query("K15", "SELECT o_orderkey, CASE WHEN r = 'go' AND fit = 'poor' THEN 'maybe' WHEN r = 'maybe' AND fit = 'none' THEN 'no_go' ELSE r END AS effective FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'go' WHEN 'P' THEN 'maybe' ELSE 'no_go' END AS r, CASE WHEN o_totalprice > 300000 THEN 'good' WHEN o_totalprice > 100000 THEN 'poor' ELSE 'none' END AS fit FROM orders)")
def k_effective(spark, sf_dir):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    recommendation = cascade.first_match([("go", s == "O"), ("maybe", s == "P")], "no_go")
    fit = cascade.first_match([("good", p > 300000), ("poor", p > 100000)], "none")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.effective(recommendation, fit).alias("effective"))


@query(
    "K18 K19 K21 K23 K73",
    f"""WITH d AS (SELECT doc_id, lower(text) AS b FROM documents), r AS (SELECT *, CASE WHEN {_any("b", ["@"])} THEN NULL WHEN {_any("b", ["!!"])} THEN 'shouting' WHEN {_any("b", ["***", "$$$"])} THEN 'marks' WHEN {_any("b", [" | "])} THEN 'table' END AS reason FROM d)
        SELECT doc_id, reason, CASE reason WHEN 'shouting' THEN 'hide' WHEN 'marks' THEN 'hide' WHEN 'table' THEN 'review' ELSE 'keep' END AS action,
        CASE WHEN reason = 'marks' THEN CASE WHEN {_FLAGS["contact"]} THEN 'contact' ELSE '' END ELSE concat_ws(',', {", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _FLAGS.items())}) END AS signals FROM r""",
)
def k_hard_noise(spark, sf_dir):
    t = F.col("text")
    reason = rules.hard_noise(t, [("shouting", ["!!"]), ("marks", ["***", "$$$"]), ("table", [" | "])], ["@"])
    action = F.when(reason.isin("shouting", "marks"), F.lit("hide")).when(reason == "table", F.lit("review")).otherwise(F.lit("keep"))
    d = table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"), action.alias("action"), rules.signals(t, LEXICON).alias("s"))
    return d.select("doc_id", "reason", "action", F.array_join(rules.tightened(F.col("s"), F.col("reason"), {"marks": ["contact"]}), ",").alias("signals"))


@query(
    "K22 K37 K53 K54 K65",
    """WITH d AS (SELECT doc_id, lower(substr(text, 1, 40)) AS t, lower(text) AS b FROM documents), c AS (SELECT *, len(regexp_extract_all(b, 'und ')) + len(regexp_extract_all(b, 'der ')) AS g, len(regexp_extract_all(b, 'the ')) + len(regexp_extract_all(b, 'and ')) AS e, len(regexp_extract_all(b, 'que ')) + len(regexp_extract_all(b, 'los ')) AS r FROM d)
       SELECT doc_id, CASE WHEN contains(t, 'und ') OR contains(t, 'der ') THEN 'german' WHEN contains(t, 'the ') OR contains(t, 'and ') THEN 'english' WHEN contains(t, 'que ') OR contains(t, 'los ') THEN 'romance'
       WHEN g > 0 AND g >= e AND g >= r THEN 'german' WHEN e > 0 AND e >= r THEN 'english' WHEN r > 0 THEN 'romance' ELSE 'other' END AS category FROM c""",
)
def k_category_by_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.category(F.substring("text", 1, 40), F.col("text"), MARKERS).alias("category"))


@query(
    "K24 K25 K38 K39",
    r"""WITH p AS (SELECT page_id, lower(url) AS n, lower(html) AS h FROM pages), t AS (SELECT page_id, CASE WHEN regexp_matches(n, 'page=\d') THEN 'listing' WHEN regexp_matches(n, '/fr/') THEN 'french' END AS named, CASE WHEN regexp_matches(h, '<article') THEN 'article' WHEN regexp_matches(h, '<table') THEN 'table' END AS read FROM p)
        SELECT page_id, COALESCE(named, read, 'other') AS type, CASE WHEN named IS NOT NULL THEN 'name' WHEN read IS NOT NULL THEN 'text' ELSE 'none' END AS by, CASE COALESCE(named, read) WHEN 'article' THEN 1 WHEN 'table' THEN 3 ELSE 9 END AS priority FROM t""",
)
def k_document_type(spark, sf_dir):
    t = rules.document_type(F.col("url"), F.col("html"), [("listing", r"page=\d"), ("french", "/fr/")], [("article", "<article"), ("table", "<table")])
    role = F.when(F.col("type") == "article", F.lit("specification")).when(F.col("type") == "table", F.lit("contract")).otherwise(F.lit("other"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", "t.type", "t.by").withColumn("priority", rules.download_priority(role, F.lit("html")))


@query(
    "K27 K35 K36 K30",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), e AS (SELECT doc_id, CAST(regexp_matches(line, '^\s*\d+[.)\s]') AS INTEGER) + CAST(regexp_matches(line, '(?i)\b(pcs|pc|kg|m|l|set|unit)\b') AS INTEGER) + CAST(regexp_matches(line, '\b\d+([.,]\d+)?\b') AS INTEGER) + CAST(regexp_matches(line, '\d[.,]\d{2}\b') AS INTEGER) + CAST(regexp_matches(line, '\S(\t|\s{2,}|\|)\S') AS INTEGER) + CAST(regexp_matches(line, '\b[A-Z]{1,4}-?\d{2,}\b') AS INTEGER) AS n FROM l)
        SELECT doc_id, COUNT(*) FILTER (n >= 2) AS product_lines FROM e GROUP BY doc_id""",
)
def k_product_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(rules.product_lines(F.col("text"), 2)).cast("long").alias("product_lines"))


@query(
    "K30-K33 K47 K66-K68",
    """WITH c AS (SELECT doc_id, n_chars AS chars, len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda w: w <> '')) AS words, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters FROM documents),
       q AS (SELECT *, CASE WHEN chars = 0 THEN 'empty' WHEN letters / CAST(chars AS DOUBLE) < 0.5 THEN 'garbled' WHEN words < 50 THEN 'short' ELSE 'good' END AS quality FROM c)
       SELECT doc_id, quality, CASE WHEN quality IN ('empty', 'garbled') THEN 'low' WHEN quality = 'short' THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN words % 3 = 0 THEN 'no_documents' WHEN words % 3 = 2 THEN 'partial' ELSE 'ready' END AS status,
       CASE WHEN words % 3 = 0 THEN 'search' WHEN words % 3 = 2 THEN 'review' ELSE 'none' END AS action FROM q""".replace("\\\\", "\\"),
)
def k_document_quality(spark, sf_dir):
    t = F.col("text")
    words = F.size(F.filter(F.split(t, r"[ \t\n]+"), lambda w: w != ""))
    q = rules.document_quality(F.col("n_chars"), words, F.length(F.regexp_replace(t, r"[^\p{L}]", "")))
    status = rules.document_status(words % 3, F.lit(1), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("q"), status.alias("status"), rules.status_action(status).alias("action")).select("doc_id", "q.quality", "q.confidence", "status", "action")


#: First bytes of pages dressed up as files, in hexadecimal, with the format that they name.
SIGNATURES = [("255044462d", "pdf"), ("504b0304", "zip"), ("526172211a07", "rar"), ("377abcaf271c", "7z"), ("d0cf11e0a1b11ae1", "ole"), ("1f8b", "gzip"), ("89504e47", "png"), ("ffd8ff", "jpeg"), ("", "html")]
SUFFIXES = ["html", "pdf", "bin", "docx", "xlsx", "rar", "7z", "doc", "gz", "png", "jpg"]
_HEAD = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, (h, _) in enumerate(SIGNATURES)) + " END"


@query(
    "K41-K43 A27",
    f"""WITH b AS (SELECT page_id, {_HEAD} || lower(hex(encode(html))) AS x, [{", ".join(f"'{x}'" for x in SUFFIXES)}][CAST((page_id // 9) % 11 AS INTEGER) + 1] AS suffix FROM pages),
        f AS (SELECT page_id, suffix, CASE WHEN starts_with(x, '255044462d') THEN 'pdf' WHEN starts_with(x, '504b0304') THEN 'zip' WHEN starts_with(x, '526172211a07') THEN 'rar' WHEN starts_with(x, '377abcaf271c') THEN '7z'
        WHEN starts_with(x, 'd0cf11e0a1b11ae1') THEN 'ole' WHEN starts_with(x, '1f8b') THEN 'gzip' WHEN starts_with(x, '89504e47') THEN 'png' WHEN starts_with(x, 'ffd8ff') THEN 'jpeg' ELSE 'html' END AS format FROM b)
        SELECT page_id, format, CASE WHEN suffix IN ('bin', 'gz', 'png', 'jpg') THEN 'unknown_suffix'
        WHEN (suffix, format) IN (('html', 'html'), ('pdf', 'pdf'), ('docx', 'zip'), ('xlsx', 'zip'), ('rar', 'rar'), ('7z', '7z'), ('doc', 'ole')) THEN 'ok'
        WHEN format = 'html' THEN 'html_instead' ELSE 'mismatch' END AS problem FROM f""",
)
def k_magic_bytes(spark, sf_dir):
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    page = F.col("page_id")
    name = F.concat(F.lit("file."), of(SUFFIXES, F.floor(page / 9) % len(SUFFIXES)))
    content = F.concat(F.unhex(of([h for h, _ in SIGNATURES], page % len(SIGNATURES))), F.col("html").cast("binary"))
    pages = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), rules.magic(content).alias("format"))
    return pages.select("page_id", "format", rules.format_check(F.col("name"), F.col("format")).alias("problem"))


#: What failed steps say, with a number in place of the mark.
MESSAGES = ["HTTP #", "status # from server", "Connection reset after # s", "read timed out (# s)", "Page # not found", "Rate limit: wait # s", "ACCESS FORBIDDEN for job #", "cannot parse line #", "SSL handshake failed, attempt #", "exit code #", "Malformed header at #", ""]
_SAID = "replace(CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END, '#', CAST(CAST(floor(value) AS BIGINT) % 140 + 400 AS VARCHAR))"


@query(
    "K44 K45",
    rf"""WITH s AS (SELECT event_id, lower({_SAID}) AS t FROM events), r AS (SELECT *, regexp_matches(t, 'timed? ?out|connection (reset|refused|aborted)|temporarily|\b50[234]\b|dns|ssl') AS transient FROM s)
        SELECT event_id, CASE WHEN regexp_matches(t, '\b429\b|too many requests|rate limit') THEN 'rate_limited' WHEN transient THEN 'transient' WHEN regexp_matches(t, '\b404\b|not found') THEN 'not_found'
        WHEN regexp_matches(t, '\b40[13]\b|forbidden|unauthorized') THEN 'denied' WHEN regexp_matches(t, 'invalid|malformed|cannot parse') THEN 'invalid' ELSE 'other' END AS class, transient FROM r""",
)
def k_failures(spark, sf_dir):
    number = (F.floor("value").cast("long") % 140 + 400).cast("string")
    said = F.replace(F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 12 + 1).cast("int")), F.lit("#"), number)
    e = table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return e.select("event_id", rules.failure_class(F.col("said")).alias("class"), rules.transient(F.col("said")).alias("transient"))


@query(
    "K48 K49 K34",
    """SELECT user_id, COALESCE(MAX(ts) FILTER (event_type = 'purchase') < MAX(ts) FILTER (event_type = 'signup'), FALSE) AS stale, CASE WHEN list_contains(list(CASE WHEN event_type = 'error' THEN 'no_go' ELSE 'go' END ORDER BY event_id) FILTER (value > 150), 'no_go') THEN 'no_go' ELSE (list(CASE WHEN event_type = 'error' THEN 'no_go' ELSE 'go' END ORDER BY event_id) FILTER (value > 150))[1] END AS recent FROM events GROUP BY user_id""",
)
def k_staleness(spark, sf_dir):
    kind = F.col("event_type")
    said = F.when(kind == "error", F.lit("no_go")).otherwise(F.lit("go"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max(F.when(kind == "purchase", F.col("ts"))).alias("report"), F.max(F.when(kind == "signup", F.col("ts"))).alias("document"), F.array_sort(F.collect_list(F.when(F.col("value") > 150, F.struct("event_id", said.alias("r"))))).alias("r")
    )
    return e.select("user_id", F.coalesce(F.col("report") < F.col("document"), F.lit(False)).alias("stale"), rules.any_no(F.transform("r", lambda x: x["r"])).alias("recent"))


@query("K50 K59")
def k_near_texts(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("at")
    told = near.without_near(table(spark, sf_dir, "conversations").select("conv_id", at, "text"), "conv_id", "at", "text")
    # A talk of one text is held against an empty one.
    alone = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.every(near.plain(F.col("text")) == "").alias("blank"))
    kept = told.groupBy("conv_id").agg(F.max(F.when(F.col("at") == 2, F.array_contains("near", 1))).alias("second"), F.count_if("kept").cast("int").alias("kept"))
    return kept.join(alone, "conv_id").select("conv_id", F.coalesce("second", "blank").alias("alike"), "kept")


@query(
    "K72",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'guarded' WHEN contains(lower(text), '@') AND n_chars < 2000 THEN 'preliminary' WHEN n_chars < 300 THEN 'lacks_text' WHEN contains(lower(text), 'http') THEN 'unprocessed_link' END AS reason,
       CASE WHEN contains(lower(text), 'password') THEN 'no_go' ELSE 'maybe' END AS verdict, n_chars < 100 OR contains(text, '____') AS blank FROM documents""",
)
def k_guardrails(spark, sf_dir):
    b, n = text.normal(F.col("text")), F.col("n_chars")
    has = lambda w: F.contains(b, F.lit(w))
    reason = cascade.first_match([("guarded", has("password")), ("preliminary", has("@") & (n < 2000)), ("lacks_text", n < 300), ("unprocessed_link", has("http"))])
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"), F.when(has("password"), F.lit("no_go")).otherwise(F.lit("maybe")).alias("verdict"), ((n < 100) | F.contains("text", F.lit("____"))).alias("blank"))


@query("K64 K23", "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END) AS shown_because FROM orders")
def k_shown_reason(spark, sf_dir):
    found = cascade.all_matches([("large", F.col("o_totalprice") > 400000), ("urgent", F.col("o_orderpriority") == "1-URGENT"), ("open", F.col("o_orderstatus") == "O")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, "; ").alias("shown_because"))


@query("K66-K68", f"SELECT o_orderkey, CASE WHEN o_orderdate < {NOW_SQL} THEN 'expired' WHEN o_totalprice < 50000 THEN 'hidden' WHEN o_orderstatus = 'O' THEN 'ready' ELSE 'waiting' END AS export_status FROM orders")
def k_export_status(spark, sf_dir):
    hidden = cascade.first_match([("cheap", F.col("o_totalprice") < 50000)])
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.export_status(hidden, F.col("o_orderstatus") == "O", F.col("o_orderdate") < ntz(NOW)).alias("export_status"))


@query(
    "K71 D29 D33",
    """WITH c AS (SELECT user_id, COUNT(*) FILTER (event_type = 'purchase') AS n_new, COUNT(*) AS n_found, COUNT(*) FILTER (event_type = 'error') AS n_errors, arg_max(event_type, event_id) AS status FROM events GROUP BY 1)
       SELECT user_id, CASE WHEN n_errors > 20 THEN 'rate_limited' WHEN status = 'signup' THEN 'retry_scheduled' WHEN status = 'error' THEN 'failed' WHEN n_errors > 12 AND n_new > 0 THEN 'partial' WHEN n_errors > 12 THEN 'errors' WHEN n_new > 10 THEN 'loaded' WHEN n_found > 0 THEN 'known' ELSE 'unknown' END AS outcome FROM c""",
)
def k_backfill_outcome(spark, sf_dir):
    kind = F.col("event_type")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("n_new"), F.count("*").alias("n_found"), F.count_if(kind == "error").alias("n_errors"), F.max_by("event_type", "event_id").alias("status"))
    many = F.when(F.col("n_errors") > 12, F.lit(1)).otherwise(F.lit(0))
    row = {
        "rate_limited": F.col("n_errors") > 20,
        "retry": F.col("status") == "signup",
        "status": F.when(F.col("status") == "error", F.lit("failed")).otherwise(F.lit("done")),
        "n_errors": many,
        "n_new": F.when((many == 1), F.col("n_new")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("n_new") - 10)),
        "n_found": F.col("n_found"),
    }
    return c.select("user_id", rules.backfill_outcome(row).alias("outcome"))


@query(
    "K74 K75",
    """SELECT p_partkey, printf('26.%02d.11.110-%08d', CAST(p_size % 90 AS INTEGER), CAST(p_partkey AS BIGINT)) AS code, p_name AS name, 'pcs' AS unit, floor(p_retailprice) AS quantity, CAST(1 AS INTEGER) AS header_at FROM part""",
)
def k_coded_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.concat_ws(" | ", F.format_string("26.%02d.11.110-%08d", (F.col("p_size") % 90), F.col("p_partkey")), "p_name", F.lit("pcs"), F.concat(F.floor("p_retailprice").cast("string"), F.lit(",0")))
    at = rules.header_position(F.split(F.concat(F.lit("intro\n"), F.lit("name | unit | quantity\n"), line), "\n"), ["name", "unit", "quantity"])
    return p.select("p_partkey", rules.coded_row(line).alias("r"), at.alias("header_at")).select("p_partkey", "r.*", "header_at")
