"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before has kept, and calls one operator of the subpackage llm. All but the last
return the columns of documents, and any further ones that docs has. run()
writes each stage's rows as Parquet to the shared folder, reads them for the
next and deletes what no later stage reads.

Every stage takes null, empty and very long texts and empty tables. Rows with
null or repeated ids are rows like others: only the near-duplicate stage looks
at ids, to choose among copies. Ties there go to the smallest id. Helper
columns get names that docs doesn't have.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweir.llm import bpe, decontamination, secret_scan, simhash, toxicity
from sparkweir.llm.common import held_out, scratch, stored, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts have the score of no finding, and stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    (score,) = unused(docs, "_score")
    return docs.withColumn(score, toxicity.score_column(docs, model)).where(F.col(score) < 0.7).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one row stays: that of the smallest id; a null id stays only where no other row of the component has one."""
    return simhash.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: at least one word hit, and one in twenty. Texts without words stay."""
    (marks,) = unused(docs, "_marks")
    marked = docs.withColumn(marks, decontamination.marks(docs, table(spark, sf_dir, "benchmark")))
    return marked.where(~decontamination.contaminated(F.col(f"{marks}.n_hit"), F.col(f"{marks}.n_words"))).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind in brackets; n_chars follows the text where it changes. All rows stay."""
    forest = secret_scan.train(secret_scan.training_findings(spark))
    found, clear = unused(docs, "_findings", "_cleared")
    cleared = secret_scan.scan(docs, forest, findings_col=found, cleared_col=clear)
    changed = F.exists(found, lambda f: f["secret"])
    n_chars = F.when(changed, F.length(clear).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleared.withColumn("n_chars", n_chars).withColumn("text", F.col(clear)).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): token ids of each row, and whether they decode to its text. A null text has none."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select("text", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).alias("_row"))
    decoded = bpe.round_trip(rows, path, public_tokenizers.PATTERN, "_row")
    return decoded.select("_row.doc_id", "n_tokens", "ids", (bpe.digest("decoded") == F.col("_row.sha")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("byte_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as clear:
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
            clear()
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the learned stages nor the tokens.
ORACLE_SQL = None
