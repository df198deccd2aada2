"""Order statistics and running sums against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import ranks, scheduling, scoring


def groups(seed=4):
    r = random.Random(seed)
    return {
        "even": [float(i) for i in range(5000)], "ties": [7.0] * 3000 + [r.random() for _ in range(200)] + [9.0] * 4000, "skew": [math.exp(r.gauss(0, 6)) for _ in range(6001)],
        "one": [3.5], "two": [1.0, -2.0], "same": [4.0] * 999, None: [float(r.randrange(5)) for _ in range(400)], "odd": [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 1e-300],
        "low": [0.0] * 2 + [1.0] * 5000, "close": [1.0 + i * 2.0**-52 for i in range(700)],
    }


def key(x):
    return (x != x, x if x == x else 0.0)


def same(a, b):
    return a == b or (a != a and b != b)


@pytest.mark.parametrize(("cuts", "sent", "few"), [(128, 10_000, 4096), (128, 10_000, 10), (4, 10_000, 40), (2, 0, 0)])
def test_equals_sorting(spark, monkeypatch, cuts, sent, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "RANGES", cuts)
    monkeypatch.setattr(ranks, "MOST_SENT", sent)
    own = groups()
    if cuts == 2:
        own = {k: v[:60] for k, v in own.items()}
    rows = spark.createDataFrame([(g, v) for g, values in own.items() for v in [*values, None]] + [("nothing", None)], "engine string, ms double")
    N = F.col("n")  # noqa: N806
    asked = {"low": F.floor((N + 1) / 2), "high": F.ceil((N + 1) / 2), "p95": F.ceil(N * 95 / 100), "first": F.lit(1), "last": N, "never": N + 1}
    found = {r.engine: r for r in ranks.order_statistics(rows.repartition(5), "engine", "ms", asked).collect()}
    assert set(found) == set(own)
    for g, values in own.items():
        values, n = sorted(values, key=key), len(values)
        at = {"low": (n + 1) // 2, "high": n // 2 + 1, "p95": -(-n * 95 // 100), "first": 1, "last": n}
        assert found[g].n == n and found[g].never is None
        for name, place in at.items():
            assert same(found[g][name], values[place - 1]), (g, name)


def test_no_values(spark):
    rows = spark.createDataFrame([], "engine string, ms double")
    assert ranks.order_statistics(rows, "engine", "ms", {"p": F.lit(1)}).collect() == []


def test_summary_of_engines(spark):
    rows = [("a", 10.0, 1, 10, 0, 2, True), ("a", 30.0, 2, 10, 1, 2, False), ("a", None, 0, 5, 0, 1, True), ("b", None, 0, 0, 0, 0, True), (None, 5.0, 1, 2, 1, 1, False)]
    found = {r.engine: r for r in scoring.engine_summary(spark.createDataFrame(rows, "engine string, ms double, char_distance int, char_length int, word_distance int, word_length int, exact boolean"), "engine").collect()}
    assert (found["a"].p50, found["a"].p95, found["a"].cases, found["a"].cer, found["a"].seconds) == (20.0, 30.0, 3, 3 / 25, 0.04)
    assert (found["b"].p50, found["b"].p95, found["b"].cer) == (None, None, None) and found[None].p50 == 5.0


def test_no_plan_holds_a_group(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 3).alias("engine"), F.rand(1).alias("ms"), *(F.lit(1).alias(c) for c in ("char_distance", "char_length", "word_distance", "word_length")), F.lit(True).alias("exact"))
    monkeypatch.setattr(ranks, "FEW", 0)
    plan = scoring.engine_summary(rows, "engine")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan and "median" not in plan


@pytest.mark.parametrize("slices", [1, 7, 200])
def test_running_sums(spark, slices):
    r = random.Random(1)
    rows = [(g, i, r.randrange(50)) for g in ("a", "b", None) for i in range(1500 if g == "a" else 40)]
    r.shuffle(rows)
    found = ranks.running_sum(spark.createDataFrame(rows, "g string, o long, w long"), "g", "o", F.col("w"), "before", slices=slices).collect()
    total, wanted = {}, {}
    for g, o, w in sorted(rows, key=lambda x: x[1]):
        wanted[g, o] = total.get(g, 0)
        total[g] = wanted[g, o] + w
    assert {(x.g, x.o): x.before for x in found} == wanted and len(found) == len(rows)
    assert ranks.running_sum(spark.createDataFrame([], "g string, o long, w long"), "g", "o", F.col("w"), "before").collect() == []


def test_moving_cost(spark):
    r = random.Random(8)
    runs = {d: [r.uniform(0, 900) for _ in range(n)] for d, n in (("a", 1), ("b", 3), ("c", 63), ("d", 64), ("e", 65), ("f", 2000))}
    rows = [(d, i, x) for d, values in runs.items() for i, x in enumerate(values)]
    r.shuffle(rows)
    found = {x.d: x.cost for x in scheduling.cost_after(spark.createDataFrame(rows, "d string, at long, ms double"), "d", ["at"], "ms", 1.0).collect()}
    for d, values in runs.items():
        cost = 1.0
        for x in values:
            cost = (cost + x) / 2
        assert math.isclose(found[d], cost, rel_tol=1e-12)
