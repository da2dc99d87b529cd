"""Evaluation of a classifier's predictions against weighted gold decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import rate


def match_predictions(cases: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    """Every case with its prediction; cases without one have the status `missing`."""
    return cases.join(predictions, key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def unknown_predictions(cases: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    return predictions.join(cases.select(key), key, "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def metrics(matched: DataFrame) -> DataFrame:
    """One row. matched: expected, predicted, weight (decimal), critical (array of decisions), status, latency_ms, cost (decimal), fallback, review_required, review_completed.

    Rates divide by all cases; the 95th percentile is by nearest rank and, as
    the mean cost, over values that are there. Missing and invalid predictions
    are critical; abstained and failed ones lose their weight but are critical
    only if listed. Review completion is 1 where nothing needed review.
    """
    valid = F.col("status") == "ok"
    correct = valid & (F.col("predicted") == F.col("expected"))
    answer = F.when(valid, F.col("predicted")).otherwise(F.col("status"))
    critical = F.col("status").isin("missing", "invalid") | (~correct & F.coalesce(F.array_contains("critical", answer), F.lit(False)))
    n = F.count("*")
    return matched.agg(
        n.alias("n_cases"),
        rate(F.count_if(valid), n).alias("structured_rate"),
        rate(F.count_if(correct), n).alias("accuracy"),
        F.round((F.sum(F.when(~correct, F.col("weight")).otherwise(F.lit(0).cast("decimal(18,4)"))) / F.sum("weight")).cast("double"), 4).alias("weighted_loss"),
        F.count_if(critical).alias("critical_errors"),
        F.count_if(F.col("status") == "abstained").alias("abstained"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        rate(F.count_if(F.coalesce("fallback", F.lit(False))), n).alias("fallback_rate"),
        rate(F.count_if(F.coalesce("review_required", F.lit(False))), n).alias("review_rate"),
        F.coalesce(rate(F.count_if(F.col("review_required") & F.col("review_completed")), F.count_if(F.col("review_required"))), F.lit(1.0)).alias("review_completion"),
        F.percentile_disc("latency_ms", 0.95).alias("latency_p95") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("latency_p95"),
        F.round(F.avg("cost").cast("double"), 6).alias("mean_cost"),
    )


def gate(measured: DataFrame, accuracy: float = 0.8, structured: float = 1.0, loss: float = 0.2) -> DataFrame:
    """The metrics with `released`, and the names of the gates that failed."""
    failed = F.array_compact(
        F.array(
            F.when(F.col("accuracy") < accuracy, F.lit("accuracy")),
            F.when(F.col("structured_rate") < structured, F.lit("structured")),
            F.when(F.col("weighted_loss") > loss, F.lit("loss")),
            F.when(F.col("critical_errors") > 0, F.lit("critical")),
        )
    )
    return measured.withColumn("failed_gates", F.array_join(failed, ",")).withColumn("released", F.size(failed) == 0)


def confusion(matched: DataFrame) -> DataFrame:
    """(cell, n): cell is `expected->predicted`, with the status for predictions that aren't valid."""
    answer = F.when(F.col("status") == "ok", F.col("predicted")).otherwise(F.col("status"))
    return matched.groupBy(F.concat_ws("->", "expected", answer).alias("cell")).agg(F.count("*").alias("n"))


def confusion_map(matched: DataFrame) -> DataFrame:
    return confusion(matched).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell", "n")))).alias("confusion"))
