"""Queries over files: tables are written by a sink to the shared folder and read by the source under test."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..functions import dates
from ..sources import files, pluggable
from .registry import query, table


@query(
    "A01 A32 L01",
    "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 10 OFFSET 10",
)
def a_file_page(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = files.scratch(spark)
    files.write_separated(n, path)
    read = lambda cursor: files.page(spark, path, "tsv", n.columns, "n_nationkey", cursor, 10)
    _, cursor = read(None)
    return read(cursor)[0].select("n_nationkey", "n_name", "n_regionkey")


@query("A03", "SELECT text, CAST(strlen(text) AS BIGINT) AS length FROM (SELECT 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey) AS text FROM region)")
def a_guarded_text(spark, sf_dir):
    root = files.scratch(spark)
    files.write_separated(table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1).sortWithinPartitions("r_regionkey"), f"{root}/regions.csv", ",")
    return files.guarded(spark, f"{root}/regions.csv", root).select(files.decoded(F.col("content")).alias("text"), "length")


def tenders(spark, sf_dir) -> str:
    """The nations as a snapshot: a tender each, with a document for its region where the key is even."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    document = F.struct(F.col("r_regionkey").cast("string").alias("id"), F.lit("region").alias("title"), F.col("r_name").alias("text"))
    documents = F.filter(F.array(document), lambda d: F.col("n_nationkey") % 2 == 0)
    item = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), documents.alias("documents"))
    every = n.agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items")).first()["items"]
    return f'{{"schema_version":"1","tenders":{every}}}'


TENDERS = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS n_documents, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS text FROM nation JOIN region ON n_regionkey = r_regionkey"


def shown(items):
    return items.select("id", "title", F.size("documents").alias("n_documents"), F.get("documents", F.lit(0))["text"].alias("text"))


@query("A05", TENDERS)
def a_snapshot(spark, sf_dir):
    path = f"{files.scratch(spark)}/snapshot.json"
    files.put(spark, path, tenders(spark, sf_dir))
    return shown(files.snapshot(spark, path))


@query("A06 A07", TENDERS)
def a_bundle(spark, sf_dir):
    folder, snapshot = files.scratch(spark), tenders(spark, sf_dir)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    manifest = json.dumps({"snapshot_sha256": sha(snapshot)})
    commit = json.dumps({"snapshot_sha256": sha(snapshot), "manifest_sha256": sha(manifest)})
    for name, text in (("snapshot", snapshot), ("manifest", manifest), ("commit", commit)):
        files.put(spark, f"{folder}/{name}.json", text)
    return shown(files.bundle(spark, folder))


@query("A08", "SELECT c_custkey, c_name FROM customer")
def a_published(spark, sf_dir):
    """Published once; the second attempt is refused and leaves the first as it is."""
    folder = f"{files.scratch(spark)}/published"
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    files.publish(c, folder)
    try:
        files.publish(c.limit(0), folder)
    except files.Refused:
        return spark.read.parquet(folder)
    raise AssertionError("a folder was replaced")


@query("A09", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'no_text' END AS gap FROM nation WHERE n_nationkey % 4 <> 0")
def a_research_rows(spark, sf_dir):
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    card = F.when(key % 4 != 0, F.struct(key.cast("string").alias("id"), F.col("n_name").alias("title")))
    gaps = F.filter(F.array(F.struct(F.lit("no_text").alias("reason"))), lambda g: key % 3 == 0)
    every = n.agg(F.to_json(F.collect_list(F.struct(card.alias("card"), gaps.alias("gaps")))).alias("rows")).first()["rows"]
    path = f"{files.scratch(spark)}/research.json"
    files.put(spark, path, f'{{"rows":{every}}}')
    return files.research_rows(spark, path).select("card.id", "card.title", F.get("gaps", F.lit(0))["reason"].alias("gap"))


PROFILE = """\
articles: [" the ", " der ", " la "]
joins: [" and ", " und ", " y "]
marks: ["***", "$$$"]
"""


@query(
    "A30 A31",
    """WITH r(priority, rule, word) AS (VALUES (0, 'articles', ' the '), (0, 'articles', ' der '), (0, 'articles', ' la '), (1, 'joins', ' and '), (1, 'joins', ' und '), (1, 'joins', ' y '), (2, 'marks', '***'), (2, 'marks', '$$$'))
       SELECT priority, rule, word, (SELECT COUNT(*) FROM documents WHERE contains(text, word)) AS n_documents FROM r""",
)
def a_profile_rules(spark, sf_dir):
    rules = files.rules_table(spark, files.profile(PROFILE)["profile"])
    words = [r["word"] for r in rules.select("word").collect()]
    counts = table(spark, sf_dir, "documents").agg(F.array(*[F.struct(F.lit(w).alias("word"), F.count_if(F.contains("text", F.lit(w))).alias("n_documents")) for w in words]).alias("found"))
    return rules.join(F.broadcast(counts.select(F.inline("found"))), "word").select("priority", "rule", "word", "n_documents")


@query(
    "A33",
    """SELECT '## Regions' || chr(10) || chr(10) || '| r_name | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |' || chr(10), '' ORDER BY r_name) AS report
       FROM (SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)""",
)
def a_report(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counts = n.groupBy("n_regionkey").agg(F.count("*").alias("n")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n").orderBy("r_name")
    path = f"{files.scratch(spark)}/report.md"
    files.write_report([("Regions", counts)], path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("report"))


@query(
    "A37",
    """SELECT n_nationkey AS version, CASE n_nationkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' ELSE 'changed' END AS state FROM nation UNION ALL SELECT 100 + r_regionkey, 'undeclared' FROM region""",
)
def a_migrations(spark, sf_dir):
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    text = F.when(key % 3 == 1, F.col("n_name")).otherwise(F.lit("another text"))
    held = n.where(key % 3 != 0).select(key.alias("version"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    others = table(spark, sf_dir, "region").select((F.lit(100) + F.col("r_regionkey")).alias("version"), F.sha2(F.col("r_name").cast("binary"), 256).alias("sha256"))
    return files.migration_states(n.select(key.alias("version"), F.col("n_name").alias("text")), held.unionAll(others))


class Accounts(pluggable.PagedSource):
    """Numbers 1 to `most` in shards by remainder, 50 a page."""

    @classmethod
    def name(cls) -> str:
        return "weir_accounts"

    def schema(self) -> str:
        return "account long, title string"

    def shards(self) -> list[str]:
        return [str(i) for i in range(8)]

    def fetch(self, shard, cursor):
        first = int(cursor or int(shard) + 1)
        numbers = [n for n in range(first, first + 400, 8) if n <= int(self.options["most"])]
        return [(n, f"account {n}") for n in numbers], str(first + 400) if first + 400 <= int(self.options["most"]) else None


@query("M06", "SELECT c_custkey, 'account ' || c_custkey AS title, c_name FROM customer WHERE c_custkey >= 1")
def m_pluggable_source(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    most = c.agg(F.max("c_custkey")).first()[0]
    accounts = pluggable.read(spark, Accounts, most=str(most))
    return c.join(accounts, F.col("c_custkey") == F.col("account")).select("c_custkey", "title", "c_name")


@query("H28", r"""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END) AS decoded FROM documents""")
def h_charsets(spark, sf_dir):
    narrow = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
    content = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.encode(narrow, "ISO-8859-1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(files.decoded(content).cast("binary")).alias("decoded"))


@query(
    "H41",
    """SELECT o_orderkey, 'Call' || CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-06-17' THEN '' ELSE ' by ' || strftime(o_orderdate, '%d.%m.%Y') END || ', then write until 01.01.2030.' AS action FROM orders""",
)
def h_past_dates(spark, sf_dir):
    said = F.concat(F.lit("Call by "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(", then write until 01.01.2030."))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.without_past_dates("1995-06-17")(said).alias("action"))
