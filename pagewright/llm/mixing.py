"""Mixing sources to target weights: raking and calibrated sampling.

Tokens are summed by source, language and topic. Iterative proportional fitting
scales the cells until their margins are the target shares; a cell's weight is
its fitted share over the share it has. Documents are sampled with probability
proportional to their cell's weight, the largest weight being kept whole, so
that the expected margins of the sample are the targets.

A dimension's targets are shares of what the table has: values that no document
has are left out, and the rest made to sum to one. Raking ends when all margins
are met or after ``rounds``; ``gap``, the same in every row, is the largest
difference that remains between a margin and its target, so targets that
contradict each other are seen.

The table of cells is fitted in one process while it is small (a documented
bound, checked) and by joins and sums otherwise; both give the same weights.

Defined results: a null in a dimension is a value of its own; a value without a
target has target 0 and is never sampled; if no value of a dimension has one,
nothing is sampled; a document without tokens counts one; equal ids get equal
decisions, null ids that of the empty text; very long texts are only counted; an
empty table gives an empty sample. Columns of the input pass through; those
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._session import cut, documents, unit_hash

#: So many cells at most are fitted in one process.
SMALL_CELLS = 1 << 16
#: A table of cells up to this size goes to all executors instead of the documents to the cells.
SMALL_BYTES = 16 << 20
NONE = "\x00none"
WORD_GAP = r"[\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A coarse topic by layout: table, list, noise, prose or empty."""
    n = F.char_length(text)
    times = lambda letter: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(times("|") * 40 > n, "table")
        .when(F.regexp_count(text, F.lit("[#$%&*!=<>]")) * 25 > n, "noise")
        .when(times("\n") * 80 > n, "list")
        .otherwise("prose")
    )


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda x: x != "")).cast("long")


def _rake_small(cells: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """(fitted shares, the largest gap of a margin)."""
    w = cells / cells.sum()
    gap = lambda: max(np.abs(np.bincount(c, w, len(t)) - t).max(initial=0) for c, t in zip(codes, targets, strict=True))
    for _ in range(rounds):
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, w, len(target))
            w = w * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if gap() < tolerance:
            break
    return w, float(gap())


def _rake_large(cells: DataFrame, by: Sequence[str], targets: DataFrame, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """``cells`` with ``fitted``, and the largest gap of a margin; ``targets``: (dimension, value, share) of all values."""
    total = cells.agg(F.sum("tokens")).first()[0]
    fitted = cells.withColumn("fitted", F.col("tokens") / F.lit(float(total)))
    wanted = {name: targets.where(F.col("dimension") == name).select(F.col("value").alias(name), "share") for name in by}
    margin = lambda name: fitted.groupBy(name).agg(F.sum("fitted").alias("have")).join(wanted[name], name)
    gap = float("inf")
    for _ in range(rounds):
        for name in by:
            factor = margin(name).select(name, F.when(F.col("have") > 0, F.col("share") / F.col("have")).otherwise(0.0).alias("factor"))
            fitted = fitted.join(cut(factor), name).withColumn("fitted", F.col("fitted") * F.col("factor")).drop("factor")
        fitted = cut(fitted)
        gap = max(margin(name).agg(F.max(F.abs(F.col("have") - F.col("share")))).first()[0] or 0.0 for name in by)
        if gap < tolerance:
            break
    return fitted, gap


def rake(cells: DataFrame, by: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None = None, *, temper: float = 0.9, rounds: int = 60, tolerance: float = 1e-9, small: int = SMALL_CELLS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``, the fitted share over the share it has, and ``gap``.

    Without ``targets`` a dimension's shares go as those it has, to the power ``temper``.
    """
    spark = cells.sparkSession
    by = list(by)
    if not cells.head(1):
        return cells.withColumn("weight", F.lit(1.0)).withColumn("gap", F.lit(0.0))
    if len(sample := cells.limit(small + 1).toPandas()) <= small:
        sample = sample.sort_values(by).reset_index(drop=True)
        tokens = sample["tokens"].to_numpy(float)
        codes, wanted = [], []
        for name in by:
            values, code = np.unique(sample[name].to_numpy(str), return_inverse=True)
            share = np.array([float(targets[name].get(v, 0.0)) for v in values]) if targets else np.bincount(code, tokens) ** temper
            codes.append(code), wanted.append(share / share.sum() if share.sum() else share)
        fitted, gap = _rake_small(tokens, codes, wanted, rounds, tolerance)
        sample["weight"], sample["gap"] = fitted * tokens.sum() / tokens, gap
        return spark.createDataFrame(sample, cells.withColumn("weight", F.lit(1.0)).withColumn("gap", F.lit(0.0)).schema)
    own = [cells.groupBy(F.lit(name).alias("dimension"), F.col(name).alias("value")).agg((F.sum("tokens").cast("double") ** temper).alias("share")) for name in by]
    wanted = reduce(DataFrame.unionByName, own)
    if targets:
        given = spark.createDataFrame([(name, v, float(s)) for name in by for v, s in targets[name].items()], "dimension string, value string, share double")
        wanted = wanted.drop("share").join(given, ["dimension", "value"], "left").fillna(0.0, ["share"])
    sums = wanted.groupBy("dimension").agg(F.sum("share").alias("all"))
    wanted = cut(wanted.join(sums, "dimension").select("dimension", "value", F.coalesce(F.try_divide("share", "all"), F.lit(0.0)).alias("share")))
    fitted, gap = _rake_large(cells, by, wanted, rounds, tolerance)
    total = float(cells.agg(F.sum("tokens")).first()[0])
    return fitted.select(*cells.columns, (F.col("fitted") * total / F.col("tokens")).alias("weight"), F.lit(gap).alias("gap"))


def mix(docs: DataFrame, by: Sequence[str], tokens: str, targets: Mapping[str, Mapping[str, float]] | None = None, *, salt: str = "mix", **how) -> DataFrame:
    """``docs`` with ``weight``, ``probability``, ``sampled`` and ``gap``."""
    results = ("weight", "probability", "sampled", "gap")
    docs = docs.drop(*results)
    keys = [f"by_{i}" for i in range(len(by))]
    keyed = docs.select(F.struct("*").alias("row"), *(F.coalesce(F.col(n).cast("string"), F.lit(NONE)).alias(k) for k, n in zip(keys, by, strict=True)))
    cells = cut(keyed.groupBy(*keys).agg(F.sum(F.greatest(F.col("row")[tokens], F.lit(1))).cast("long").alias("tokens")))
    named = {k: {NONE if v is None else v: s for v, s in targets[n].items()} for k, n in zip(keys, by, strict=True)} if targets else None
    weights = cut(rake(cells, keys, named, **how)).drop("tokens")
    size = weights.agg(F.max("weight").alias("most"), F.sum(F.octet_length(F.concat(*keys)) + 64).alias("bytes")).first()
    if (size["bytes"] or 0) <= SMALL_BYTES:
        weights = F.broadcast(weights)
    probability = F.col("weight") / F.lit(float(size["most"] or 1.0))
    return keyed.join(weights, keys).select("row.*", "weight", probability.alias("probability"), (unit_hash("row.doc_id", salt) < probability).alias("sampled"), "gap")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), n_words(F.col("text")).alias("n_tokens"))
    mixed = mix(docs, ["source", "lang", "topic"], "n_tokens")
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled", F.round("gap", 9).alias("gap"))
