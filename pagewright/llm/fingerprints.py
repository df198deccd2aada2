"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of ``K`` code points is hashed at its offset. Of each window of ``W``
neighbouring hashes the smallest is kept, of equal ones the rightmost, with its
position. Two texts that share a run of at least ``W + K - 1`` code points share
a fingerprint, and runs shorter than ``K`` are never matched.

A text is taken as fixed four-byte code points, so that any run is one slice
however far into the text it lies, and is worked off in segments of windows, so
that what a very long text needs at once is a segment and what is kept of it.

Defined results: a null text is an empty one and has no fingerprint; a text
shorter than ``K`` is one run, one with fewer runs than ``W`` one window. Two
texts without fingerprints are alike to 1. Rows without an id come before all
others. Rows that repeat an id (or have none) follow one another in the order of their texts, and
each one's next document is the row after it; equal rows are next to each other.
An empty table gives an empty result; a single row is its own next. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm._session import documents, partitions

K, W = 8, 16
_SEGMENT = 4096
_PLACE = 16  # bits of a packed value that hold the byte offset within a segment
_EMPTY = "array<struct<hash:bigint,pos:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _least_of_runs(values: Column, w: int) -> Column:
    """The least of each ``w`` neighbours, by doubling; the last ``w - 1`` entries see fewer."""

    def wider(x: Column, have: int) -> Column:
        if have == w:
            return x
        step = min(have, w - have)
        return _let(F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.least(a, b)), lambda y: wider(y, have + step))

    return wider(values, 1)


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash: long, pos: int>>, by position, of a string column."""
    last = (1 << _PLACE) - 1
    assert 4 * (_SEGMENT + w) <= last
    # The hash's high bits, then the offset from the right: the least value is the rightmost of the least hashes.
    packed = lambda points, byte, size: F.xxhash64(F.substring(points, byte, size)).bitwiseAND(F.lit(~last)).bitwiseOR((F.lit(last) - byte).cast("long"))
    place = lambda v: F.shiftright(F.lit(last - 1) - v.bitwiseAND(F.lit(last)), 2).cast("int")
    kept = lambda v, first: F.struct(F.shiftright(v, _PLACE).alias("hash"), (place(v) + first).alias("pos"))

    def segment(points: Column, grams: Column, s: Column) -> Column:
        """The places that windows starting in the segment keep."""
        first = s * _SEGMENT
        some = F.least(F.lit(_SEGMENT + w - 1), grams - first)

        def run(part: Column) -> Column:
            values = F.transform(F.sequence(F.lit(1), F.length(part) - 4 * k + 1, F.lit(4)), lambda byte: packed(part, byte, F.lit(4 * k)))
            return _let(values, lambda x: F.slice(_least_of_runs(x, w), 1, F.size(x) - w + 1))

        least = _let(F.substring(points, first * 4 + 1, (some + k - 1) * 4), run)
        return F.transform(F.array_distinct(least), lambda v: kept(v, first))

    def whole(points: Column) -> Column:
        n = F.floor(F.length(points) / 4).cast("int")
        grams = n - k + 1
        parts = F.transform(F.sequence(F.lit(0), F.floor((grams - w) / _SEGMENT).cast("int")), lambda s: segment(points, grams, s))
        # Neighbouring segments may keep the same place.
        many = _let(F.flatten(parts), lambda x: F.filter(x, lambda v, i: (i == 0) | (v["pos"] != F.get(x, i - 1)["pos"])))
        run = F.least(F.lit(k), n)  # a short text is one run, few runs are one window
        few = F.array(kept(F.array_min(F.transform(F.sequence(F.lit(1), (n - run) * 4 + 1, F.lit(4)), lambda byte: packed(points, byte, run * 4))), F.lit(0)))
        return F.when(n == 0, F.array().cast(_EMPTY)).when(grams < w, few).otherwise(many)

    return _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), whole)


def winnow_edited(prints: Column, edited: Column, same: Column, k: int = K, w: int = W) -> Column:
    """``winnow(edited)``, where the first ``same`` code points are those of the text that has ``prints``.

    What a window keeps depends on the window alone, so only windows near or
    past the place where the texts part are worked off again.
    """

    def join(at: Column) -> Column:
        moved = F.transform(winnow(F.substring(edited, at["start"] + 1, F.char_length(edited)), k, w), lambda v: F.struct(v["hash"].alias("hash"), (v["pos"] + at["start"]).alias("pos")))
        return F.concat(F.filter(prints, lambda v: v["pos"] <= at["known"]), F.filter(moved, lambda v: v["pos"] > at["known"]))

    known = same - k + 1 - w  # places up to here have no window that the change reaches
    start = known - w + 2  # windows from here on hold all places beyond
    nothing = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("known"))
    return _let(F.when(start > 0, F.struct(start.alias("start"), known.alias("known"))).otherwise(nothing), join)


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: v["hash"]))

    def ratio(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["one"], pair["two"]))
        union = F.size(pair["one"]) + F.size(pair["two"]) - both
        return F.when(union > 0, both / union).otherwise(F.lit(1.0))

    return _let(F.struct(hashes(one).alias("one"), hashes(two).alias("two")), ratio)


def digest(prints: Column) -> Column:
    """128 bits of all hashes and positions."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), prints)), F.hex(F.xxhash64(F.lit(2), prints)))


def fingerprint(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, text, prints) for each row of ``docs``."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("prints", winnow(F.col("text"), k, w))


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` dealt out by ranges of ``doc_id``, with the first row of each range once more
    at the end of the range before (the first of all at the end of the last).

    Adds ``span`` (the range) and ``again``. The number of ranges is bounded by the
    parameter; only their first ids come to the driver.
    """
    least = F.lit(-(2**63)).cast("long")  # where rows without an id lie
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 100 * ranges)).first()[0] or []
    place = lambda firsts, key: F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= key))
    if not cuts:
        return docs.where("false").withColumn("span", F.lit(0)).withColumn("again", F.lit(False))
    firsts = sorted(r[0] for r in ids.groupBy(place(sorted(set(cuts)), F.col("doc_id"))).agg(F.min("doc_id")).select("min(doc_id)").collect())
    n = len(firsts)
    key = F.coalesce(F.col("doc_id").cast("long"), least)
    span = place(firsts, key) - 1
    own = F.struct(span.alias("span"), F.lit(False).alias("again"))
    also = F.struct(((span + n - 1) % n).alias("span"), F.lit(True).alias("again"))
    ends = F.array_contains(F.array(*map(F.lit, firsts)), key)
    return docs.withColumn("_to", F.explode(F.when(ends, F.array(own, also)).otherwise(F.array(own)))).select("*", "_to.span", "_to.again").drop("_to")


def compare_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text, and how like they are to its edited text's and the next text's."""
    spark = docs.sparkSession
    dealt = in_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 8 * partitions(spark)).repartition(partitions(spark), "span")
    order = Window.partitionBy("span").orderBy("again", "doc_id", "text")
    rows = dealt.withColumn("prints", winnow(F.col("text"), k, w)).withColumn("next_text", F.lead("text").over(order)).withColumn("next_prints", F.lead("prints").over(order)).where("not again")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_prints", winnow_edited(F.col("prints"), F.col("edited"), n - cut, k, w))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "edited", "prints", "edited_prints", "next_prints")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare_edited(documents(spark, sf_dir, spread=False))  # deals its rows itself
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("prints")).alias("fingerprint"), digest(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
        F.size("prints").cast("long").alias("n_prints"), F.hex(F.xxhash64(F.transform("prints", lambda v: v["pos"]))).alias("positions"),
    )
