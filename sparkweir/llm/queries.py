"""Registered queries of the operators, with production parameters, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_topk, filter_audit, importance_resampling, language_id, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, suffix_dedup, toxicity
from .common import held_out, table
from .oracle import ORACLE_SQL  # noqa: F401


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.train(secret_scan.training_findings(spark))
    scanned = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), forest)
    return scanned.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(F.filter("findings", lambda f: f["secret"])).cast("long").alias("n_secrets"),
        F.filter("findings", lambda f: f["secret"]).alias("secrets"),
        F.sha2(F.coalesce("cleared", F.lit("")).cast("binary"), 256).alias("cleared_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Grades: 0 bad, 1 good but toxic, 2 good.
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    model = quality_classifier.learn(docs, ratings, ~held_out("doc_id"))
    judged = quality_classifier.judge(docs, model)
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "tail_probability", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, ~held_out("doc_id"))
    return language_id.identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontamination.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return decoded.select("doc_id", "n_tokens", bpe.digest("ids").alias("ids_sha256"), bpe.digest("decoded").alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_secret_scan, op3_suffix_dedup, op4_quality_classifier, op5_language_id, op6_simhash, op7_decontamination,
        op8_quality_rules, op9_byte_bpe, op10_toxicity, op11_exact_topk, op12_importance_resampling, op13_filter_audit,
    )
}
