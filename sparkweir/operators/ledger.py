"""State kept as append-only logs: claims, attempts, jobs, replays, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest


def state(log: DataFrame, keys: list[str], order: list[str], column: str = "state") -> DataFrame:
    """The latest state of each key."""
    return log.groupBy(*keys).agg(F.max_by(column, F.struct(*order)).alias(column), F.max(F.struct(*order)).alias("_at")).drop("_at")


def claimable(items: DataFrame, log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Items that nobody holds or has sent: no state, or released."""
    return items.join(state(log, keys, order), keys, "left").where(F.col("state").isNull() | (F.col("state") == "released")).drop("state")


def attempts_state(n: Column, limit: int = 2) -> Column:
    return F.when(n >= limit, F.lit("failed")).when(n > 0, F.lit("retry")).otherwise(F.lit("new"))


def invalid_transitions(log: DataFrame, keys: list[str], order: list[str], allowed: dict[str, list[str]], column: str = "state") -> DataFrame:
    """Rows whose state may not follow the one before; the first state of a key needs to be one that allowed[""] lists."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(""))
    pairs = [f"{a}>{b}" for a, after in allowed.items() for b in after]
    return log.withColumn("from_state", before).where(~F.concat_ws(">", "from_state", column).isin(pairs))


def replay(requests: DataFrame, done: DataFrame, key: str = "operation", payload: str = "payload") -> DataFrame:
    """requests with `decision`: new, reuse if the operation was done with the same payload, else conflict."""
    digest = F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)
    known = done.select(F.col(key), F.sha2(F.coalesce(F.col(payload), F.lit("")), 256).alias("_done"))
    decision = F.when(F.col("_done").isNull(), F.lit("new")).when(F.col("_done") == digest, F.lit("reuse")).otherwise(F.lit("conflict"))
    return requests.join(known, key, "left").withColumn("decision", decision).drop("_done")


def backoff_seconds(attempt: Column, key: Column, base: float = 30.0, most: float = 3600.0, spread: int = 15) -> Column:
    """Doubling delays with a cap, and a spread that depends on the key and the attempt only."""
    seed = F.substring(F.sha2(F.concat_ws(":", key, attempt.cast("string")), 256), 1, 4)
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1)) + F.pmod(F.conv(seed, 16, 10).cast("long"), F.lit(spread + 1))


def retry_due(attempt: Column, limit: int, last: Column, wait: Column, now: Column) -> Column:
    """True if another try is allowed and its time has come; without a last try it has."""
    return (attempt < limit) & F.coalesce(F.unix_micros(last.cast("timestamp")) + wait.cast("long") * 1000000 <= F.unix_micros(now.cast("timestamp")), F.lit(True))


def alert_plan(previous: DataFrame, current: DataFrame, key: str, now: Column, remind_hours: int = 24) -> DataFrame:
    """What to tell: new problems, reminders of those told of long ago, and recoveries.

    previous: (key, since, alerted); current: (key).
    """
    joined = current.select(key, F.lit(True).alias("_now")).join(previous, key, "full_outer")
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("alerted").cast("timestamp"))) / 3.6e9
    action = (
        F.when(F.col("_now").isNull(), F.lit("recovered"))
        .when(F.col("since").isNull(), F.lit("new"))
        .when(hours >= remind_hours, F.lit("remind"))
        .otherwise(F.lit("quiet"))
    )
    told = F.col("action").isin("new", "remind")
    return joined.withColumn("action", action).withColumn("since", F.coalesce("since", now)).withColumn("alerted", F.when(told, now).otherwise(F.col("alerted"))).drop("_now")


def versions(df: DataFrame, keys: list[str], fingerprint: str, order: list[str]) -> DataFrame:
    """The first row of each version, with `is_update` where the key had another version before."""
    from pyspark.sql import Window

    first = latest(df, [*keys, fingerprint], [F.col(c).asc() for c in order])
    return first.withColumn("is_update", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)
