"""Counters while something runs: a stream of samples, and snapshots before and after."""

from __future__ import annotations

import glob
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from pagewright.operators import telemetry
from pagewright.sources import readers

#: Fixed value, in milliseconds: how often a counter is read.
SAMPLE_MS = 20


class _Counters(SimpleDataSourceStreamReader):
    """One row a counter and poll. Counters belong to the machine that runs them, so they are read where the query is driven."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = []
        for path in sorted(glob.glob(self.pattern)):
            try:
                with open(path, encoding="ascii") as counter:
                    rows.append((path, time.time(), float(counter.read())))
            except (OSError, ValueError):
                continue  # one that does not answer is no reason to stop
        return iter(rows), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(())  # a sample that was lost cannot be taken again


class CounterSource(DataSource):
    """``spark.readStream.format("counters").option("paths", pattern)``: (path, at, value)."""

    @classmethod
    def name(cls) -> str:
        return "counters"

    def schema(self) -> str:
        return "path string, at double, value double"

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Counters(self.options["paths"])


def samples(spark: SparkSession, pattern: str) -> DataFrame:
    spark.dataSource.register(CounterSource)
    return spark.readStream.format("counters").option("paths", pattern).load()


@contextmanager
def sampled(spark: SparkSession, pattern: str, folder: str) -> Iterator[None]:
    """Samples counters into ``folder`` (Parquet) for as long as the block runs."""
    stream = samples(spark, pattern).writeStream.format("parquet").option("path", f"{folder}/samples").option("checkpointLocation", f"{folder}/state").trigger(processingTime=f"{SAMPLE_MS} milliseconds").start()
    try:
        yield
    finally:
        stream.stop()


class Bracket:
    """What a block's counters did; ``gained`` is there once it has ended."""

    gained: DataFrame | None = None

    def result(self) -> DataFrame:
        if self.gained is None:
            raise RuntimeError("the block has not ended")
        return self.gained


@contextmanager
def bracketed(spark: SparkSession, fdinfo: str, folder: str) -> Iterator[Bracket]:
    """Snapshots of the counters of ``fdinfo`` (a pattern) before and after a block, also if it fails, kept in ``folder``."""
    keys = ["driver", "client", "pdev"]

    def snapshot(name: str) -> DataFrame:
        telemetry.parse_fdinfo(readers.counter_files(spark, fdinfo)).withColumn("device", F.col("pdev")).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    before, bracket = snapshot("before"), Bracket()
    try:
        yield bracket
    finally:
        bracket.gained = telemetry.bracketed(before, snapshot("after"), keys)
