"""Jobs and their deadlines as a stream: a job without a reply in time is expired when event time passes its deadline, whether or not another message comes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators.telemetry import REPLY_SECONDS

OUTCOME = "event_id long, user_id long, expired boolean"
_MICRO = 1_000_000
#: Jobs that one entry of the state holds at most, and rows told at once.
_PART = 4096


class Deadlines(StatefulProcessor):
    """Of each key the jobs that are not settled, with a timer at the first one's deadline.

    The next message of a key, by time and then id, is a job's reply. By the time
    that a timer fires, all messages up to it have come or are too late to count.
    State is read and written by parts of many jobs, of 16 bytes each: one call
    for each job would cost far more than the job.
    """

    def __init__(self, seconds: int = REPLY_SECONDS):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "part string", "jobs binary")

    def _wait(self, first: int) -> None:
        # Timers are of milliseconds; one that fires later than due finds no less.
        self.handle.registerTimer(-(-(first + self.seconds * _MICRO) // 1000))

    def _keep(self, jobs: np.ndarray) -> None:
        """Adds jobs (a row each: time, id) to the state."""
        for start in range(0, len(jobs), _PART):
            self.open.updateValue((uuid.uuid4().hex,), (jobs[start : start + _PART].tobytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            jobs = np.stack([part["at"].to_numpy(np.int64), part["event_id"].to_numpy(np.int64)], axis=1)
            if len(jobs):
                self._keep(jobs)
                least = int(jobs[:, 0].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wait(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All jobs whose deadline event time has passed; the next one's deadline is the next timer."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [np.frombuffer(jobs, np.int64).reshape(-1, 2) for _, (jobs,) in self.open.iterator()]
        if not parts:
            return
        jobs = np.concatenate(parts)
        jobs = jobs[np.lexsort((jobs[:, 1], jobs[:, 0]))]
        ends = jobs[:, 0] + self.seconds * _MICRO
        due = int(np.searchsorted(ends, now, "right"))
        if due:
            self.open.clear()
            self._keep(jobs[due:])
        if due < len(jobs):
            self._wait(int(jobs[due, 0]))
        expired = np.append(jobs[1:, 0] > ends[:-1], True)
        for start in range(0, due, _PART):
            own = slice(start, min(start + _PART, due))
            yield pd.DataFrame({"event_id": jobs[own, 1], "user_id": np.full(own.stop - start, key[0], np.int64), "expired": expired[own]})

    def close(self) -> None: ...


#: The state store that keyed maps and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expired_jobs(jobs: DataFrame, *, seconds: int = REPLY_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, expired) of a stream of jobs (event_id, user_id, ts), each once its deadline has passed by event time.

    Jobs that come later than ``late`` are left out, as are those without a time
    or key. State is what may still be answered; a job that comes twice counts
    twice, as in a table. Needs the RocksDB state store.
    """
    # A row without a key still moves event time on: the condition names the time, so that it is not tested before the watermark.
    known = jobs.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).where("if(ts is null, false, event_id is not null and user_id is not null)")
    return known.withColumn("at", F.unix_micros("ts")).groupBy("user_id").transformWithStateInPandas(Deadlines(seconds), OUTCOME, "append", "EventTime")
