"""Lines of pages that a task puts together by itself, against all pairs."""

import random

import pytest
from test_large_pages import REGION, pairs_of, plain_labels, region

from pagewright.operators import layout


@pytest.mark.parametrize("local", [1 << 12, 30, 0])
def test_components_in_tasks_and_by_cells(spark, local):
    r = random.Random(5)
    rows = []
    for page in range(12):
        lean = r.choice([0, 0, 25, -40, 80])
        for i in range(r.choice([1, 4, 20, 31, 120])):
            t = r.choice([10.0, 12.0, 15.0, 90.0])
            vertical = page % 4 == 3 and r.random() < 0.5
            rows.append(region(page, i, r.uniform(0, 2500), r.uniform(0, 900), t, t * r.choice([0.5, 2, 5, 9]), 90 + lean + r.uniform(-7, 7) - 90 * vertical, vertical))
    wanted = {(p, i): label for p, i, label in plain_labels(pairs_of(rows))}
    found = layout.components(spark.createDataFrame(rows, REGION).repartition(3), local_regions=local).collect()
    assert len(found) == len(rows) and len({(x.page_id, x.component) for x in found}) < len(rows)
    assert {(x.page_id, x.region_id): x.component for x in found} == {(x["page_id"], x["region_id"]): wanted.get((x["page_id"], x["region_id"]), x["region_id"]) for x in rows}


def test_small_pages_are_not_kept_or_met_in_joins(spark):
    rows = spark.createDataFrame([region(p, i, 60.0 * i, 40.0, 20.0, 50.0) for p in range(5) for i in range(40)], REGION)
    plan = layout.components(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
