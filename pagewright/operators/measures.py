"""What crops cost, read one by one, side by side or in groups: sums over timed reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def costs(reads: DataFrame, *keys: str) -> DataFrame:
    """Crops, megapixels, milliseconds, and milliseconds a crop and a megapixel of timed reads (ms, width, height)."""
    pixels = F.sum(F.col("width").cast("double") * F.col("height")) / 1e6
    ms = F.sum("ms")
    return reads.groupBy(*keys).agg(F.count("*").alias("crops"), pixels.alias("mpix"), ms.alias("ms"), F.try_divide(ms, F.count("*")).alias("ms_per_crop"), F.try_divide(ms, pixels).alias("ms_per_mpix"))


def call_overhead(one: Column, wide: Column, times: int) -> Column:
    """What a call costs besides its pixels: so many calls against one of as much content."""
    return (one * times - wide) / times


def speed_up(rows: DataFrame, way: str, ms: str, base: str) -> DataFrame:
    """Each way's time and how many times faster than ``base`` it is."""
    total = rows.groupBy(way).agg(F.sum(ms).alias("ms"))
    reference = F.max(F.when(F.col(way) == base, F.col("ms"))).over(Window.partitionBy(F.lit(0)))  # ways are few
    return total.select(way, "ms", F.try_divide(reference, "ms").alias("speed_up"))


def same_texts(rows: DataFrame, key: str, way: str, text: str, base: str) -> DataFrame:
    """(way, same, crops): of how many crops each way reads the text that ``base`` reads, nulls included."""
    wanted = rows.where(F.col(way) == base).select(key, F.col(text).alias("_wanted"))
    return rows.join(wanted, key).groupBy(way).agg(F.count_if(F.col(text).eqNullSafe(F.col("_wanted"))).alias("same"), F.count("*").alias("crops"))


def groups_of(place: Column, n: int) -> Column:
    """The group of a crop, if so many neighbours are read together."""
    return F.floor(place / n)


def packs(width: Column, widest: int) -> Column:
    """Whether a crop goes into the strip of narrow ones."""
    return width <= widest
