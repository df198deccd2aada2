"""Lines of pages of any size: pairs by cells against all pairs, components of long chains."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import graph, layout

REGION = "page_id long, region_id int, center_x double, center_y double, thickness double, length double, angle double, vertical boolean, text string, confidence double, box_score double"


def axis(angle, vertical):
    x, y = math.sin(math.radians(angle)), -math.cos(math.radians(angle))
    turn = y < 0 if vertical else x < 0
    return (-x, -y) if turn else (x, y)


def on_line(a, b):
    """Whether b, of a later id, lies on the visual line of a."""
    if a["vertical"] != b["vertical"]:
        return False
    (ax, ay), (bx, by) = axis(a["angle"], a["vertical"]), axis(b["angle"], b["vertical"])
    dx, dy = b["center_x"] - a["center_x"], b["center_y"] - a["center_y"]
    thick = max(a["thickness"], b["thickness"])
    gap = abs(dx * ax + dy * ay) - (a["length"] + b["length"]) / 2
    return (
        ax * bx + ay * by >= math.cos(math.radians(12)) and abs(-dx * ay + dy * ax) <= 0.6 * thick
        and -min(2 * thick, 0.5 * min(a["length"], b["length"])) <= gap <= 4 * thick
    )


def pairs_of(rows):
    return sorted((a["page_id"], a["region_id"], b["region_id"]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a["page_id"] == b["page_id"] and on_line(a, b))


def region(page, i, x, y, t, n, angle=90.0, vertical=False):
    return {"page_id": page, "region_id": i, "center_x": x, "center_y": y, "thickness": t, "length": n, "angle": angle, "vertical": vertical, "text": "word", "confidence": 0.9, "box_score": 0.9}


@pytest.mark.parametrize("kind", ["straight", "leaning", "any angle", "sizes", "vertical", "few"])
def test_cells_give_all_pairs(spark, kind):
    r = random.Random(kind)
    rows = []
    for page in range(3):
        lean = r.uniform(-40, 40) if page else 0.0
        for i in range(20 if kind == "few" else 350):
            t = r.choice([5.0, 20.0, 21.0, 300.0]) if kind == "sizes" else r.uniform(10, 20)
            n = t * r.choice([0.5, 1, 4, 60 if kind in ("leaning", "sizes") else 8])
            angle = {"straight": 90 + lean, "leaning": 90 + lean + r.uniform(-6, 6), "any angle": r.uniform(-90, 180)}.get(kind, 90 + lean + r.choice([0, 0, 3]))
            vertical = kind == "vertical" and r.random() < 0.5
            rows.append(region(page, i, r.uniform(0, 1500), r.uniform(0, 700), t, n, angle - 90 * vertical, vertical))
    wanted = pairs_of(rows)
    found = layout.same_line_pairs(spark.createDataFrame(rows, REGION)).collect()
    assert sorted((p.page_id, p.i, p.j) for p in found) == wanted
    assert wanted


def test_regions_without_numbers_are_alone(spark):
    rows = [region(1, i, x, 0.0, t, n) for i, (x, t, n) in enumerate([(0.0, 20.0, 50.0), (60.0, 20.0, 50.0), (None, 20.0, 50.0), (120.0, 20.0, float("inf")), (float("nan"), 20.0, 50.0), (1e300, 20.0, 50.0)])] + [region(None, 0, 0.0, 0.0, 20.0, 50.0)]
    rows += [region(2, i, 60.0 * (i % 9), 40.0 * (i // 9), 20.0, 50.0) for i in range(40)]
    found = layout.components(spark.createDataFrame(rows, REGION)).collect()
    label = {(r.page_id, r.region_id): r.component for r in found}
    assert len(found) == len(rows)
    assert [label[1, i] for i in range(6)] == [0, 0, 2, 3, 4, 5] and all(label[2, i] == i // 9 * 9 for i in range(40)) and label[None, 0] == 0


def test_a_page_of_many_words(spark):
    lines, words = 5000, 40
    rows = spark.range(lines * words).select(
        F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("region_id"), (F.col("id") % words * 60.0).alias("center_x"), (F.floor(F.col("id") / words) * 24.0).alias("center_y"),
        F.lit(20.0).alias("thickness"), F.lit(50.0).alias("length"), F.lit(90.0).alias("angle"), F.lit(False).alias("vertical"), F.lit("w").alias("text"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("box_score"),
    )
    assert layout.candidate_pairs(rows).count() <= 20 * lines * words
    # Neighbours, and those with one word between: 60 apart, less 50 is 10; 120 less 50 is 70; 180 is too far.
    found = layout.same_line_pairs(rows)
    assert found.count() == lines * (words - 1 + words - 2)
    assert found.where("i div 40 <> j div 40 or j - i > 2").count() == 0
    labels = layout.components(rows).groupBy("component").count()
    assert labels.count() == lines and labels.where(f"count <> {words} or component % {words} <> 0").count() == 0


def test_least_labels():
    r = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (500, 300), (500, 490), (4000, 3999)):
        a, b = r.integers(0, n, (2, m)) if m < n - 1 or n < 3 else np.stack([np.arange(n - 1), np.arange(1, n)])[:, r.permutation(n - 1)]
        up = list(range(n))
        for _ in range(n):
            before = list(up)
            for x, y in zip(a, b, strict=True):
                up[x] = up[y] = min(up[x], up[y])
            if up == before:
                break
        assert graph.least_labels(a, b, n).tolist() == up


def plain_labels(edges):
    near = {}
    for p, i, j in edges:
        near.setdefault((p, i), set()).add((p, j))
        near.setdefault((p, j), set()).add((p, i))
    out = {}
    for node in sorted(near):
        if node not in out:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = node[1]
                    todo += near[x]
    return sorted((p, i, label) for (p, i), label in out.items())


@pytest.mark.parametrize("local_edges", [1 << 18, 40, 3])
def test_components_of_large_and_small_pages(spark, local_edges):
    r = random.Random(7)
    edges = [(1, i, i + 1) for i in range(300) if i % 50] + [(2, r.randrange(400), r.randrange(400)) for _ in range(200)] + [(p, r.randrange(5), r.randrange(5)) for p in range(3, 40) for _ in range(3)]
    edges += [(50, 9, 2), (50, 2, 9), (50, 9, 2), (51, 4, 4)] + [(52, 0, i) for i in range(1, 120)]
    table = spark.createDataFrame([*edges, (None, 1, 2)], "page_id long, i int, j int")
    found = graph.components(table, local_edges=local_edges).collect()
    wanted = [x for x in plain_labels(edges) if (x[0], x[1]) != (51, 4) or local_edges > 3]
    assert sorted(tuple(x) for x in found if (x.page_id, x.node) != (51, 4)) == [x for x in wanted if x[0] != 51]


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "page_id string, i int, j int")).collect() == []
