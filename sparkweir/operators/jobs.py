"""Jobs as a log of asked steps: leases that run out, attempts, deadlines, dead letters and their redrive.

A log has the columns job, at (timestamp), seq, target, owner, error, granted
and deadline; other columns are not read. Each row asks for a step of its job;
verdict() says whether it is taken. What comes out tells, for each row, the
state before and after, the verdict, the attempts, and until when the lease
runs or from when the job may be tried again. A lease that runs out before the
next row of its job is a row of its own, without seq.

The log is folded row by row for each job, in order of (at, seq): in batch by
folds.fold, in a stream by streaming.jobs, with the same functions.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folds import fold

#: Which state may follow which.
ALLOWED = {
    "received": {"validated", "dead_lettered", "cancelled"},
    "validated": {"accepted", "dead_lettered", "cancelled"},
    "accepted": {"processing", "cancelled"},
    "processing": {"succeeded", "retry_scheduled", "dead_lettered"},
    "retry_scheduled": {"processing", "dead_lettered", "cancelled"},
    "succeeded": {"reconciled"},
    "dead_lettered": {"accepted", "reconciled"},
    "reconciled": set(),
    "cancelled": set(),
}
#: What a row of the log has, and what comes out.
ASKED = ["job", "at", "seq", "target", "owner", "error", "granted", "deadline"]
STEPS = "job string, seq long, at timestamp_ntz, from_state string, to_state string, verdict string, attempts int, until timestamp_ntz"


@dataclass(frozen=True)
class Policy:
    first_state: str = "received"
    max_attempts: int = 3
    lease_seconds: int = 300
    base_seconds: int = 30
    most_seconds: int = 3600

    def delay(self, job: str, attempt: int) -> dt.timedelta:
        """Doubles with each attempt up to a cap; up to a fifth more, fixed by job and attempt."""
        doubled = min(self.most_seconds, self.base_seconds << (attempt - 1))
        spread = int.from_bytes(hashlib.sha256(f"{job}:{attempt}".encode()).digest()[:2], "big") % (max(1, doubled // 5) + 1)
        return dt.timedelta(seconds=min(self.most_seconds, doubled + spread))


@dataclass
class Job:
    """until: the end of a lease while the job is worked on, else when it may be tried."""

    name: str
    state: str
    attempts: int = 0
    until: dt.datetime | None = None


def lapse(job: Job, now: dt.datetime, policy: Policy) -> list[tuple]:
    """A lease that has run out by now: the job is to be tried again, or is a dead letter if no attempt is left."""
    if job.state != "processing" or job.until > now:
        return []
    before, at = job.state, job.until
    if job.attempts < policy.max_attempts:
        job.state, job.until = "retry_scheduled", at + policy.delay(job.name, job.attempts)
    else:
        job.state, job.until = "dead_lettered", None
    return [(job.name, None, at, before, job.state, "lapsed", job.attempts, job.until)]


def verdict(job: Job, row: dict, policy: Policy) -> str:
    """ok, or why the step isn't taken. A null error is none; a null grant is not granted; a null deadline never passes."""
    target = row["target"]
    if target not in ALLOWED.get(job.state, ()):
        return "invalid"
    if target == "processing":
        if row["deadline"] is not None and row["at"] > row["deadline"]:
            return "deadline"
        return "no owner" if not row["owner"] else "exhausted" if job.attempts >= policy.max_attempts else "ok"
    if target == "retry_scheduled":
        return "no error" if not row["error"] else "exhausted" if job.attempts >= policy.max_attempts else "ok"
    if target == "dead_lettered":
        return "ok" if row["error"] else "no error"
    if job.state == "dead_lettered" and target == "accepted":
        return "ok" if row["granted"] else "not granted"
    return "ok"


def advance(job: Job, row: dict, policy: Policy) -> list[tuple]:
    """The rows that come out for a row of the log; job changes with them."""
    out = lapse(job, row["at"], policy)
    before, said, target = job.state, verdict(job, row, policy), row["target"]
    if said == "ok":
        if target == "processing":
            job.attempts, job.until = job.attempts + 1, row["at"] + dt.timedelta(seconds=policy.lease_seconds)
        elif target == "retry_scheduled":
            job.until = row["at"] + policy.delay(job.name, job.attempts)
        elif target == "accepted" and before == "dead_lettered":
            job.attempts, job.until = 0, row["at"]
        else:
            job.until = None
        job.state = target
    return [*out, (job.name, row["seq"], row["at"], before, job.state, said, job.attempts, job.until)]


def asked(log: DataFrame) -> DataFrame:
    """The columns of a log with their kinds. Rows without a job or a time ask for nothing."""
    kinds = {"job": "string", "at": "timestamp_ntz", "seq": "long", "granted": "boolean", "deadline": "timestamp_ntz"}
    return log.where(F.col("job").isNotNull() & F.col("at").isNotNull()).select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in ASKED])


def run(log: DataFrame, policy: Policy = Policy(), until: dt.datetime | None = None) -> DataFrame:
    """STEPS of a whole log. until: leases that have run out by then lapse even if no row follows."""
    end = (lambda job: lapse(job, until, policy)) if until else None
    return fold(asked(log), ["job"], ["at", "seq"], StructType.fromDDL(STEPS), lambda key: Job(key[0], policy.first_state), lambda job, row: advance(job, row, policy), end)
