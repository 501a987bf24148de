"""The life of redaction jobs as a stream of events: what they are, until their time to live is over.

State is one row for each job, in the stream's state store, with a timer for
its end; it outlives the driver and every executor with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How far a job is: an event that is not further than what is known says nothing new.
RANK = {"queued": 0, "running": 1, "done": 2, "error": 2, "deleted": 3}
EVENTS = "job_id string, status string, at timestamp"
#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """Transitions of one job, each emitted once.

    Events of a batch are taken in the order of their time. A repeated event,
    one that is behind what is known (``running`` after ``done``) and one of an
    unknown status are ignored; a job whose first event is missing begins with
    the first that arrives. A deleted job is remembered until its time is over,
    so that nothing late brings it back, and then goes without a word; any
    other is ``expired`` at that time.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "rank int, ends bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.known.get() if self.known.exists() else None
        rank, ends = known if known is not None else (-1, 0)
        out = []
        for status, at in sorted(((s, t) for part in rows for s, t in zip(part["status"], part["at"])), key=lambda e: (e[1], RANK.get(e[0], -1))):
            if RANK.get(status, -1) <= rank:
                continue
            if rank < 0:
                ends = int(at.timestamp() * 1000) + self.ttl_ms
                self.handle.registerTimer(ends)
            rank = RANK[status]
            out.append((key[0], status, at))
        if out:
            self.known.update((rank, ends))
        yield pd.DataFrame(out, columns=["job_id", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rank, ends = self.known.get() if self.known.exists() else (RANK["deleted"], 0)
        self.known.clear()
        out = [] if rank == RANK["deleted"] else [(key[0], "expired", pd.Timestamp(ends, unit="ms"))]
        yield pd.DataFrame(out, columns=["job_id", "status", "at"])

    def close(self) -> None:
        pass


def lived(events: DataFrame, hours: float = 1.0, late: str = "5 minutes") -> DataFrame:
    """Transitions ``(job_id, status, at)`` of the jobs of a stream of events with these columns.

    A job lives ``hours`` from its first event; its time is over when the
    watermark, which waits ``late`` for stragglers, has passed that. Events
    without a job or a time are left out. The session needs STORE as its
    provider of state stores.
    """
    timed = events.filter("job_id is not null and at is not null").withWatermark("at", late)
    return timed.groupBy("job_id").transformWithStateInPandas(Lifecycle(int(hours * 3_600_000)), EVENTS, "append", "eventTime")


def standing(transitions: DataFrame) -> DataFrame:
    """``(job_id, status, at)``: where each job stands, by its last transition; jobs that are over are left out."""
    rank = F.create_map(*(F.lit(x) for s, r in {**RANK, "expired": 9}.items() for x in (s, r)))
    last = transitions.groupBy("job_id").agg(F.max_by(F.struct("status", "at"), F.struct(rank[F.col("status")], "at")).alias("s"))
    return last.select("job_id", "s.status", "s.at").filter(~F.col("status").isin("expired", "deleted"))
