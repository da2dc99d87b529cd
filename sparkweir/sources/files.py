"""Files as tables, with the checks that guard them, and tables as files."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import decimal
from ..functions.jsonx import digest

#: A record as sources give it; other columns go to raw.
RECORD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("external_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("initial_price", T.DecimalType(18, 2)),
        T.StructField("currency", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("deadline_at", T.TimestampType()),
        T.StructField("url", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

SNAPSHOT = "schema_version string, tenders array<struct<id:string,title:string,customer_name:string,source_url:string,description:string,documents:array<struct<id:string,title:string,text:string>>>>"


@dataclass(frozen=True)
class Limits:
    bytes: int = 10 << 20
    records: int = 5000
    columns: int = 100
    cell: int = 200_000


class Refused(ValueError):
    """A source that breaks a limit or a rule."""


def guarded(spark: SparkSession, path: str, root: str, suffixes: tuple[str, ...] = (".csv", ".json", ".jsonl", ".tsv"), most: int = Limits.bytes) -> DataFrame:
    """(path, length, content) of one file under the root, with an allowed suffix and size."""
    clean = posixpath.normpath(path)
    if not clean.startswith(posixpath.normpath(root) + "/") or not clean.endswith(suffixes):
        raise Refused(f"not a file that may be read: {path}")
    df = spark.read.format("binaryFile").load(clean).select("path", "length", "content")
    size = df.agg(F.max("length")).first()[0]
    if size is None or size > most:
        raise Refused(f"a file of {size} bytes; {most} are allowed")
    return df


def scratch(spark: SparkSession) -> str:
    """A new folder's name where driver and executors share files: below spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/landed-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def file_digest(files: DataFrame) -> str:
    """SHA-256 of one file's bytes, or of several files' digests in order of their paths."""
    parts = files.select(F.sha2("content", 256).alias("sha"), "path").orderBy("path").collect()
    return parts[0]["sha"] if len(parts) == 1 else hashlib.sha256("".join(r["sha"] for r in parts).encode()).hexdigest()


def rows(spark: SparkSession, path: str, kind: str, columns: list[str]) -> DataFrame:
    """Rows of texts: CSV or TSV with a header, JSON lines, or an envelope {schema_version, records}. Blank lines are skipped, malformed ones are an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, schema=schema, header=True, sep="\t" if kind == "tsv" else ",", mode="FAILFAST", enforceSchema=False)
    if kind == "jsonl":
        return spark.read.json(path, schema=schema, mode="FAILFAST")
    if kind == "json":
        envelope = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("records", T.ArrayType(schema))])
        return spark.read.json(path, schema=envelope, multiLine=True, mode="FAILFAST").select(F.inline("records"))
    raise Refused(f"no such kind: {kind}")


def records(df: DataFrame, default_source: str) -> DataFrame:
    """Rows of texts as RECORD: the source in lower case, the currency in upper and RUB by default, unknown columns in raw as JSON."""
    have = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    known = [f.name for f in RECORD]
    others = [c for c in df.columns if c not in known]
    raw = F.to_json(F.struct(*others)) if others else F.lit("{}")
    return df.select(
        F.lower(F.coalesce(have("source"), F.lit(default_source))).alias("source"),
        have("external_id").alias("external_id"),
        have("title").alias("title"),
        decimal(have("initial_price")).alias("initial_price"),
        F.upper(F.coalesce(have("currency"), F.lit("RUB"))).alias("currency"),
        have("published_at").try_cast("timestamp").alias("published_at"),
        have("deadline_at").try_cast("timestamp").alias("deadline_at"),
        have("url").alias("url"),
        F.coalesce(have("raw"), raw).alias("raw"),
    )


def refused(df: DataFrame) -> Column:
    """Why a record can't be taken, null where it can."""
    return F.when(F.col("external_id").isNull(), F.lit("no_id")).when(F.col("title").isNull(), F.lit("no_title")).when(F.col("initial_price") < 0, F.lit("negative_price"))


def page(spark: SparkSession, path: str, kind: str, columns: list[str], order: str, cursor: tuple[str, int] | None = None, limit: int = 500, limits: Limits = Limits()) -> tuple[DataFrame, tuple[str, int] | None]:
    """A page of a bounded file's rows and the cursor of the next, (the file's digest, offset), None after the last. A file that has changed since the cursor is refused."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > limits.bytes:
        raise Refused(f"{size} bytes; {limits.bytes} are allowed")
    sha = file_digest(files.select("path", "content"))
    offset = 0
    if cursor:
        if cursor[0] != sha:
            raise Refused("the file has changed between pages")
        offset = cursor[1]
    if len(columns) > limits.columns:
        raise Refused(f"{len(columns)} columns; {limits.columns} are allowed")
    every = rows(spark, path, kind, columns)
    n = every.count()
    if n > limits.records:
        raise Refused(f"{n} records; {limits.records} are allowed")
    numbered = every.withColumn("_row", F.row_number().over(Window.orderBy(order)))  # within the limit of records
    rows_ = numbered.where((F.col("_row") > offset) & (F.col("_row") <= offset + limit)).drop("_row")
    return rows_, (sha, offset + limit) if offset + limit < n else None


def snapshot(spark: SparkSession, path: str, most: int = 500, documents: int = 20, chars: int = 1_000_000) -> DataFrame:
    """Rows of a snapshot, checked as a whole by one aggregate."""
    items = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("tenders"))
    text = F.aggregate(F.coalesce("documents", F.array().cast("array<struct<id:string,title:string,text:string>>")), F.lit(0).cast("long"), lambda s, d: s + F.coalesce(F.length(d["text"]), F.lit(0)))
    found = items.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(F.size("documents")).alias("documents"), F.sum(text).alias("chars"), F.count_if(F.col("id").isNull() | F.col("title").isNull()).alias("bare")).first()
    broken = [name for name, bad in (("rows", found["n"] > most), ("ids", found["ids"] != found["n"]), ("documents", (found["documents"] or 0) > documents), ("chars", (found["chars"] or 0) > chars), ("fields", found["bare"] > 0)) if bad]
    if broken:
        raise Refused(f"a snapshot that breaks: {', '.join(broken)}")
    return items


def bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot of a bundle whose manifest and commit name the right digests; checked at each call."""
    files = spark.read.format("binaryFile").load([f"{folder}/{name}.json" for name in ("snapshot", "manifest", "commit")])
    held = {r["name"]: r for r in files.select(F.regexp_extract("path", r"([a-z]+)\.json$", 1).alias("name"), F.sha2("content", 256).alias("sha"), F.when(~F.col("path").endswith("snapshot.json"), F.col("content")).alias("content")).collect()}
    manifest, commit = json.loads(held["manifest"]["content"]), json.loads(held["commit"]["content"])
    if not held["snapshot"]["sha"] == manifest["snapshot_sha256"] == commit["snapshot_sha256"] or held["manifest"]["sha"] != commit["manifest_sha256"]:
        raise Refused("the bundle's digests don't agree")
    return snapshot(spark, f"{folder}/snapshot.json")


def publish(df: DataFrame, folder: str) -> None:
    """Writes to a stage beside the folder and renames it; a folder that is there is never replaced."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, stage = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(f"{folder}._stage_{time.time_ns()}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise Refused(f"{folder} exists")
    df.write.mode("errorifexists").parquet(str(stage))
    if not fs.rename(stage, target):
        fs.delete(stage, True)
        raise Refused(f"{folder} could not be made")


def research_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a card of a package {rows: [{card, opportunity, gaps}]}; malformed ones are left out."""
    schema = "rows array<struct<card:struct<id:string,title:string,customer_name:string,source_url:string,description:string,documents:array<struct<id:string,title:string,text:string>>>,opportunity:struct<buyer:struct<inn:string>,status:string,publication_date:string,acceptance_end_date:string>,gaps:array<struct<reason:string>>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("rows")).where("card.id is not null")


def decoded(content: Column, charsets: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> Column:
    """Bytes as text by the first charset that fits; UTF-8 fits if its text gives the same bytes."""
    utf8 = content.cast("string")
    fits = (utf8.cast("binary") == content) & ~F.contains(utf8, F.lit("�"))
    return F.when(F.coalesce(F.is_valid_utf8(utf8), F.lit(False)) & fits, utf8).otherwise(F.decode(content, charsets[-1]))


def write_separated(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", separator).csv(path)


def write_report(sections: list[tuple[str, DataFrame]], path: str, most: int = 1000) -> str:
    """Small tables as Markdown, each of at most so many rows; the text is returned and written."""
    out = []
    for title, df in sections:
        cut = df.limit(most + 1).collect()
        if len(cut) > most:
            raise Refused(f"{title} has more than {most} rows")
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in cut] + [""]
    text = "\n".join(out)
    put(sections[0][1].sparkSession, path, text)
    return text


def migration_plan(declared: list[tuple[str, str]], applied: dict[str, str]) -> list[str]:
    """Versions to apply, in order. declared: (version, text). One applied with another checksum is refused."""
    todo = []
    for version, text in sorted(declared):
        sha = hashlib.sha256(text.encode()).hexdigest()
        if version not in applied:
            todo.append(version)
        elif applied[version] != sha:
            raise Refused(f"{version} was applied with another text")
    return todo


def migration_states(declared: DataFrame, applied: DataFrame) -> DataFrame:
    """(version, state) of declared(version, text) against a ledger applied(version, sha256): pending, applied, changed, or undeclared where only the ledger has it."""
    stated = declared.select("version", F.sha2(F.col("text").cast("binary"), 256).alias("_stated"))
    held = applied.select("version", F.col("sha256").alias("_held"))
    state = F.when(F.col("_held").isNull(), F.lit("pending")).when(F.col("_stated").isNull(), F.lit("undeclared")).when(F.col("_stated") == F.col("_held"), F.lit("applied")).otherwise(F.lit("changed"))
    return stated.join(held, "version", "full").select("version", state.alias("state"))


def profile(text: str, depth: int = 12, most: int = 1 << 20) -> dict:
    """A rule profile in YAML: no duplicate keys, no secret keys, a bounded size and depth. With its SHA-256 under `sha256`."""
    import yaml

    if len(text.encode()) > most:
        raise Refused("a profile that is too large")

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        seen = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(seen) != len(set(map(str, seen))):
            raise Refused("a key occurs twice")
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    value = yaml.load(text, Strict)  # noqa: S506 a safe loader

    def walk(x, level):
        if level > depth:
            raise Refused("a profile that is too deep")
        if isinstance(x, dict):
            for k, v in x.items():
                if re.search(r"(?i)password|secret|token|api_?key", str(k)):
                    raise Refused(f"a secret's key: {k}")
                walk(v, level + 1)
        elif isinstance(x, list):
            for v in x:
                walk(v, level + 1)

    walk(value, 1)
    return {"profile": value, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def rules_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(i, group, word) for i, (group, words) in enumerate(lexicon.items()) for word in words], "priority int, rule string, word string")


def budgeted(sizes: Iterator[tuple[str, int]], most: int, total: int) -> list[str]:
    """Members taken in turn within a count and a total; one that would exceed the total is skipped, not a stop."""
    taken, used = [], 0
    for name, size in sizes:
        if len(taken) < most and used + size <= total:
            taken.append(name)
            used += size
    return taken
