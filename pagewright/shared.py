"""The folder that the driver and all executors share, and rows dealt out to all of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or that of the session's checkpoints.

    Only where neither is set and everything runs in one machine's processes
    (``local[...]``, as in tests) is a temporary folder made.
    """
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not (context.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that one task gets at most, once they are dealt out.
ROWS_A_TASK = 20_000


def spread(df: DataFrame, *, even: bool = False) -> DataFrame:
    """``df`` (a table as it is read) dealt out to at least as many tasks as there are cores, if its files do not: for steps that cost far more than a shuffle of their rows.

    A file is cut into tasks by its bytes, but each of its row groups goes to one
    task whole: one row group of 100 MB gives many tasks, and all rows to one of
    them. So the rows of tasks are counted, for which Spark reads no column.
    ``even``: also if the last tasks would leave cores without work (13 tasks on
    12 cores take as long as 24), for steps beside which a shuffle is nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    fewest = df.rdd.getNumPartitions() < cores
    counted = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    tasks, rows, most = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    share = rows / cores
    longest = min(-(-tasks // cores) * most, share + most)  # rows that a core has at most, one task after another
    if fewest or most > max(2 * share, 1) or (even and longest > max(1.25 * share, 1)):
        return df.repartition(cores * max(1, -(-rows // (ROWS_A_TASK * cores))))
    return df
