"""Engines' results against a manifest, and against each other once all of them agree with it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators import scoring

#: So many ids of each problem are named in a refusal.
NAMED = 20


class Comparison(NamedTuple):
    summary: DataFrame
    variants: DataFrame


def expected_cases(cases: DataFrame) -> DataFrame:
    """(id, variant) of a manifest's cases; ids that repeat are refused."""
    twice = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").orderBy("id").limit(NAMED).collect()
    if twice:
        raise ValueError(f"the manifest lists ids twice: {', '.join(r['id'] for r in twice)}")
    return cases.select("id", "variant")


def problems(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(engine, id, problem, wanted, got) of every way in which an engine's rows differ from the cases expected.

    ``results``: engine, id, variant, place. Engines are few: each meets every case.
    """
    engines = F.array(*(F.lit(r["engine"]) for r in results.select("engine").distinct().orderBy("engine").collect())).cast("array<string>")
    key = F.struct("engine", "id").alias("id")
    wanted = expected.withColumn("engine", F.explode(engines)).select(key, "variant")
    found = scoring.case_parity(wanted, results.select(key, "variant", "place"))
    return found.select("id.engine", "id.id", "problem", "wanted", "got")


def refusal(found: DataFrame) -> str | None:
    """All problems in one text: by engine, then kind; of each kind the first ids and how many there are."""
    by = Window.partitionBy("engine", "problem")
    first = found.withColumn("at", F.row_number().over(by.orderBy("id"))).withColumn("n", F.count("*").over(by)).where(F.col("at") <= NAMED)
    order = F.array_position(F.array(*map(F.lit, scoring.PROBLEMS)), F.col("problem"))
    kinds = first.groupBy("engine", "problem", "n").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("ids")).orderBy("engine", order).collect()
    texts: dict[str, list[str]] = {}
    for r in kinds:
        texts.setdefault(r["engine"], []).append(f"{r['n']} {r['problem']}: {', '.join(r['ids'])}{', ...' if r['n'] > NAMED else ''}")
    return "\n".join(f"{engine}: {'; '.join(kinds)}" for engine, kinds in texts.items()) or None


def compare(results: DataFrame, cases: DataFrame) -> Comparison:
    """Summary by engine and error by variant and engine; nothing of it if any engine's rows differ from the cases."""
    expected = expected_cases(cases)
    if not results.head(1):
        raise ValueError("there are no results to compare")
    if said := refusal(problems(results, expected)):
        raise ValueError(f"results differ from the manifest:\n{said}")
    engines = [r["engine"] for r in results.select("engine").distinct().orderBy("engine").collect()]
    summary = scoring.engine_summary(results, "engine").orderBy("engine")
    return Comparison(summary, scoring.variant_pivot(results, "variant", "engine", engines).orderBy("variant"))


def label(engine: Column) -> Column:
    """What stands over an engine's column: the last part of its name, 13 letters at most."""
    return F.substring(F.element_at(F.split(engine, "/"), -1), 1, 13)


def summary_lines(summary: DataFrame) -> DataFrame:
    """(engine, line) as a table of fixed widths."""
    return summary.select("engine", F.format_string("%-34s %7.4f %7.4f %6.0f%% %8.1f %8.1f %8.1f", "engine", "cer", "wer", F.col("exact_rate") * 100, "p50", "p95", "seconds").alias("line"))


def variant_lines(variants: DataFrame) -> DataFrame:
    """(variant, line) as a table of fixed widths."""
    engines = [c for c in variants.columns if c != "variant"]
    return variants.select("variant", F.format_string("%-20s" + "%15.3f" * len(engines), "variant", *engines).alias("line"))


def report(comparison: Comparison) -> str:
    """The whole comparison as text; engines and variants are few."""
    engines = [c for c in comparison.variants.columns if c != "variant"]
    heads = [r["l"] for r in comparison.summary.select("engine", label(F.col("engine")).alias("l")).collect()]
    top = f"{'engine':34} {'CER':>7} {'WER':>7} {'exact':>7} {'ms p50':>8} {'ms p95':>8} {'total s':>8}"
    under = f"{'variant':20}" + "".join(f"{h:>15}" for h in heads[: len(engines)])
    lines = [top, "-" * len(top), *(r["line"] for r in summary_lines(comparison.summary).collect())]
    return "\n".join([*lines, "", under, "-" * len(under), *(r["line"] for r in variant_lines(comparison.variants).collect())])
