"""Where the operators of this subpackage put data that must outlive a lost executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import shared
from pagewright.shared import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a copy in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers each that one task reads back.
PAIRS_A_TASK = 1 << 17


def cut_pairs(df: DataFrame) -> DataFrame:
    """``cut`` for rows of a few numbers: read back in as many tasks as their count asks for.

    Otherwise a handful of rows would go on as one small shuffle file for each
    partition of the job before, at every step.
    """
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // PAIRS_A_TASK)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, *, spread: bool = True) -> DataFrame:
    """The table; where its files do not give all cores their share, its rows are dealt to all of them (``shared.spread``)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shared.spread(docs) if spread else docs


def not_remainder(column: str, modulus: int, remainder: int):
    """True for rows whose crc32 of the id, written as text (null: the empty text), leaves another remainder."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus != remainder


def unit_hash(column: str, salt: str):
    """A number in [0, 1) fixed by a column's text and the salt."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(salt)), 11).cast("double") / F.lit(2.0**53)
