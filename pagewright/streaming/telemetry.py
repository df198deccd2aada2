"""Live counters and replies as streams: windows with late data, and state that outlives a batch."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.telemetry import REPLY_SECONDS
from pagewright.shared import shared_folder



def windowed(samples: DataFrame, width: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Count, sum and maximum of (ts, value) in tumbling windows, each told once, when no sample in time can fall into it any more.

    Samples that come later than ``late`` are left out. For append mode: what a
    window holds is dropped when it is told, so state is that of open windows.
    """
    return samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("samples"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), *keys, "samples", "total", "most")


#: A time after all others, in seconds (the year 9000).
_AFTER_ALL = 221_845_392_000


def ended(samples: DataFrame, time: str = "ts") -> DataFrame:
    """A bounded stream with one row after all others, null but for its time, so that event time passes all windows and deadlines.

    It comes with the last rows of a run over what is there now; in append mode
    its own window is never told.
    """
    spark = samples.sparkSession
    path = posixpath.join(shared_folder(spark), f"ended-{uuid.uuid4().hex}")
    kinds = dict(samples.dtypes)
    last = F.timestamp_seconds(F.lit(_AFTER_ALL)).cast(kinds[time])
    spark.range(1).select(*(last.alias(c) if c == time else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items())).write.parquet(path)
    return samples.unionByName(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))


REPLY = "key long, generation long, event_id long, stale boolean"
STATE = "generation long"


def mark_stale(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, forgets: bool = True) -> Iterator[pd.DataFrame]:
    """Replies of one key in the order of their ids; one of an earlier generation than any seen is stale."""
    rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame(columns=["key", "generation", "event_id"])
    if state.hasTimedOut:
        state.remove()
        return
    latest = state.get[0] if state.exists else -1
    rows = rows.sort_values("event_id", kind="stable")
    before = rows["generation"].cummax().shift(fill_value=latest).clip(lower=latest)
    rows["stale"] = rows["generation"] < before
    state.update((max(latest, int(rows["generation"].max())),))
    if forgets:
        state.setTimeoutDuration(REPLY_SECONDS * 1000)
    yield rows[["key", "generation", "event_id", "stale"]]


def stale_replies(replies: DataFrame, *, forgets: bool = True) -> DataFrame:
    """A stream of (key, generation, event_id) with ``stale``.

    State is one number a key. If it ``forgets``, a key's goes when no reply
    comes in time; keys that are a fleet's workers, and so few, need not go.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forgets else GroupStateTimeout.NoTimeout
    mark = mark_stale if forgets else lambda key, batches, state: mark_stale(key, batches, state, False)
    return replies.select("key", "generation", "event_id").groupBy("key").applyInPandasWithState(mark, REPLY, STATE, "append", timeout)


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, be it one file or a directory of part files, as a stream."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@contextmanager
def _state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, provider or before)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(result: DataFrame, mode: str, *, state_store: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now, written in the shared folder and read back.

    Each batch has a folder of its own, which a repeated batch writes anew; in
    ``complete`` mode the last one's holds everything.
    """
    spark = result.sparkSession
    base = posixpath.join(shared_folder(spark), f"settled-{uuid.uuid4().hex}")
    last: list[int] = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        last[:] = [batch]

    with _state_store(spark, state_store):
        run = result.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    path = f"{base}/out/batch={last[0]}" if mode == "complete" else f"{base}/out"
    return spark.read.schema(result.schema).parquet(path).select(result.columns)
