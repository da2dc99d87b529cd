"""Jobs over a stream of asked steps: state for each job, and event-time timers for leases that run out."""

from __future__ import annotations

import calendar
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import jobs

KEPT = "state string, attempts int, until timestamp_ntz"
OUT = "job string, seq long, at timestamp, from_state string, to_state string, verdict string, attempts int, until timestamp"


class Steps(StatefulProcessor):
    """One job's state; a timer at the end of its lease."""

    def __init__(self, policy: jobs.Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("job", KEPT)

    def _job(self, key: tuple) -> jobs.Job:
        held = self.kept.get() if self.kept.exists() else (self.policy.first_state, 0, None)
        return jobs.Job(key[0], held[0], held[1], None if pd.isna(held[2]) else pd.Timestamp(held[2]).to_pydatetime())

    def _keep(self, job: jobs.Job) -> None:
        self.kept.update((job.state, job.attempts, job.until))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if job.state == "processing":
            self.handle.registerTimer(calendar.timegm(job.until.timetuple()) * 1000 + job.until.microsecond // 1000)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        return frame.astype({"seq": "Int64", "at": "datetime64[us]", "until": "datetime64[us]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch's rows of a job, which a batch has few of, in order of time."""
        job, out = self._job(key), []
        for row in pd.concat(list(rows)).sort_values(["at", "seq"]).to_dict("records"):
            row = {k: None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for k, v in row.items()}
            out += jobs.advance(job, row, self.policy)
        self._keep(job)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._job(key)
        out = jobs.lapse(job, pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").to_pydatetime(), self.policy)
        if out:
            self._keep(job)
            yield self._frame(out)

    def close(self) -> None:
        pass


def run(log: DataFrame, late: str, policy: jobs.Policy = jobs.Policy()) -> DataFrame:
    """The steps of a stream of asked ones, as jobs.run gives them for a whole log, if rows of a job come in order of time from batch to batch.

    A lease lapses once the watermark is past its end. The session's time zone
    must be UTC and its state store one that supports this operator (RocksDB).
    """
    read = jobs.asked(log).withColumn("at", F.col("at").cast("timestamp")).withColumn("deadline", F.col("deadline").cast("timestamp")).withWatermark("at", late)
    return read.groupBy("job").transformWithStateInPandas(Steps(policy), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
