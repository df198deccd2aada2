"""Late data, deadlines and state of streams, batch by batch."""

import datetime
import time

import pytest

from pagewright.plans.queries import QUERIES
from pagewright.streaming import deadlines
from pagewright.streaming import telemetry as live

DAY = datetime.datetime(2024, 5, 6, 12)
SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def batches(spark, tmp_path, parts):
    """A stream of one batch for each part."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        next((tmp_path / f"part{i}").glob("*.parquet")).rename(tmp_path / f"{i}.parquet")
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(tmp_path))


def run(result, tmp_path, store=None):
    """(rows, state rows after each batch that had any)."""
    found = []
    with live._state_store(result.sparkSession, store):
        query = result.writeStream.foreachBatch(lambda rows, _: found.extend(rows.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return found, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_late_rows_are_left_out(spark, tmp_path):
    rows = batches(spark, tmp_path, [[(1, 1, at(0), 1.0), (2, 1, at(50), 2.0)], [(3, 1, at(200), 4.0)], [(10, 1, at(201), 0.0)], [(4, 1, at(5), 8.0), (5, 1, at(-3 * 24 * 60), 16.0), (6, 1, at(195), 32.0)], [(7, 1, at(2000), 64.0)]])
    found, state = run(live.windowed(rows, "1 hour", "10 minutes"), tmp_path)
    told = {r.start: (r.samples, r.total, r.most) for r in found}
    assert told == {at(0): (2, 3.0, 2.0), at(180): (3, 36.0, 32.0)}  # three days late, and five minutes into a window that was told: neither counts
    assert len(found) == 2 and max(state) <= 2 and state[-1] == 1


def test_a_bounded_stream_tells_all(spark, tmp_path):
    rows = batches(spark, tmp_path, [[(1, 1, at(0), 1.0), (2, None, at(50), 2.0), (3, 1, None, 9.0)]])
    found, _ = run(live.windowed(live.ended(rows), "1 hour", "10 minutes", "user_id"), tmp_path)
    assert sorted((r.user_id or 0, r.samples, r.total) for r in found) == [(0, 1, 2.0), (1, 1, 1.0)]


def test_deadlines_pass_without_a_message(spark, tmp_path):
    parts = [
        [(1, 7, at(0), 0.0), (2, 7, at(1.5), 0.0), (3, 8, at(0), 0.0)],
        [(4, 9, at(100), 0.0)],  # another key's message moves event time past the deadlines of 7 and 8
        [(10, 9, at(100.5), 0.0)],  # rows are late by the event time of the batch before
        [(5, 7, at(3), 0.0), (6, 8, at(101), 0.0), (None, 8, at(101), 0.0), (7, None, at(102), 0.0)],  # an answer that comes too late to count, and rows without a key
        [(8, 9, at(102), 0.0), (9, 8, at(102.5), 0.0)],
    ]
    found, state = run(deadlines.expired_jobs(batches(spark, tmp_path, parts)), tmp_path, deadlines.ROCKS)
    assert {r.event_id: (r.user_id, r.expired) for r in found} == {1: (7, False), 2: (7, True), 3: (8, True)}
    assert state and max(state) >= 3


def test_state_falls_when_deadlines_have_passed(spark, tmp_path):
    jobs = [(i, i % 40, at(i / 60), 0.0) for i in range(400)]
    found, state = run(deadlines.expired_jobs(batches(spark, tmp_path, [jobs, [(1000, 1, at(600), 0.0)], [(1001, 1, at(1200), 0.0)]])), tmp_path, deadlines.ROCKS)
    assert len(found) == 401 and min(state[2:]) < max(state) / 20


def test_replies_at_the_very_deadline(spark, tmp_path):
    two = datetime.timedelta(seconds=120)
    tick = datetime.timedelta(microseconds=1)
    rows = [(1, 1, DAY, 0.0), (2, 1, DAY + two, 0.0), (3, 2, DAY, 0.0), (4, 2, DAY + two + tick, 0.0), (5, 3, DAY, 0.0), (6, 3, DAY, 0.0)]
    found, _ = run(deadlines.expired_jobs(live.ended(batches(spark, tmp_path, [rows]))), tmp_path, deadlines.ROCKS)
    assert {r.event_id: r.expired for r in found} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True}


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_equals_the_batch(spark, tmp_path, files):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    found, wanted = (QUERIES[name](spark, str(tmp_path)).select("event_id", "user_id", "expired") for name in ("stream_expired_jobs", "expired_jobs"))
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, wanted.collect())) and {r[2] for r in rows} == {True, False}


def test_state_is_moved_by_parts_not_by_jobs():
    import numpy as np
    import pandas as pd

    kept, calls, timers = {}, [], []

    class Map:
        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            kept[key] = value

        def removeKey(self, key):  # noqa: N802
            calls.append(key)
            kept.pop(key)

        def iterator(self):
            return iter(list(kept.items()))

        def clear(self):
            kept.clear()

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return Map()

        def registerTimer(self, at):  # noqa: N802
            timers.append(at)

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 9_000_000

    jobs = deadlines.Deadlines(120)
    jobs.init(Handle())
    rows = pd.DataFrame({"user_id": 7, "event_id": np.arange(10_000), "at": np.arange(10_000)[::-1] * 1_000_000})
    rows["ts"] = pd.to_datetime(rows["at"], unit="us")
    list(jobs.handleInputRows((7,), iter([rows[:5000], rows[5000:]]), Now()))
    told = pd.concat(list(jobs.handleExpiredTimer((7,), Now(), None)))
    assert len(told) == 8881 and not told["expired"].any() and set(told["event_id"]) == set(range(1119, 10_000))  # those of the last deadline's 120 s and later wait
    assert timers == [120_000, 9_001_000] and len(calls) < 20
