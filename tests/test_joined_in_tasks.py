"""Lines that tasks join by themselves against those of groups."""

import math
import random

import pyarrow as pa
import pytest
from test_large_pages import REGION, region

from pagewright.operators import layout


def pages(seed):
    r = random.Random(seed)
    for page in range(14):
        lean = r.choice([0, 0, 20, -35, 85])
        for i in range(r.choice([1, 3, 20, 60])):
            t = r.choice([10.0, 12.0, 15.0])
            vertical = page % 5 == 3 and r.random() < 0.5
            row = region(page, i // 2 if page == 6 else i, r.uniform(0, 900), r.uniform(0, 250), t, t * r.choice([0.5, 2, 5]), 90 + lean + r.uniform(-5, 5) - 90 * vertical, vertical)
            text = r.choice(["word", "(", "a,", ".", "שלום", "שלום a", "12", "«é", "花」", "", "x ", "　y"])
            yield row | {"text": text, "confidence": r.choice([0.0, 0.3, 0.7]), "box_score": r.random()}


def rows_of(lines):
    rounded = lambda v: f"{v:.7g}" if isinstance(v, float) else v
    return sorted((tuple(rounded(v if not v or not math.isclose(v, 0, abs_tol=1e-9) else 0.0) if isinstance(v, float) else v for v in row) for row in lines.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_lines_in_tasks_and_by_groups(spark, seed):
    rows = spark.createDataFrame(list(pages(seed)), REGION).repartition(3)
    found, wanted = layout.reconstruct(rows), layout.reconstruct(rows, local_regions=0)
    assert found.dtypes == wanted.dtypes
    found, wanted = rows_of(found), rows_of(wanted)
    assert found == wanted and max(x[-1] for x in found) > 3


def test_pages_with_nulls_go_by_groups(spark):
    more = [region(90, i, 60.0 * i, 40.0, 20.0, 50.0) | {"confidence": None if i == 2 else 0.5} for i in range(5)]
    more += [region(91, i, 60.0 * i, 40.0, 20.0, 50.0) | {"text": None if i == 1 else "a"} for i in range(3)]
    more += [region(None, i, 60.0 * i, 40.0, 20.0, 50.0) for i in range(2)]
    rows = spark.createDataFrame([*pages(3), *more], REGION)
    found = rows_of(layout.reconstruct(rows))
    assert found == rows_of(layout.reconstruct(rows, local_regions=0))
    assert {x[0] for x in found} >= {90, 91, None}


def test_a_page_too_large_to_be_held(monkeypatch):
    monkeypatch.setattr(layout, "_AT_ONCE", 50)
    sizes = {1: 40, 2: 200, 3: 30, 4: 61, 5: 3}
    rows = [{"page_id": p, "region_id": i, "plain": True, "thickness": 1.0} for p, n in sizes.items() for i in range(n)]
    monkeypatch.setattr(layout, "_joined_lines", lambda own: own.select(["page_id", "region_id"]).append_column("members", [[1] * own.num_rows]))
    schema = pa.schema([("page_id", pa.int64()), ("region_id", pa.int64()), ("members", pa.int64())])
    for step in (1, 16, 1000):
        found = [r for b in layout._joined(schema, 60)(iter(pa.Table.from_pylist(rows).to_batches(step))) for r in b.to_pylist()]
        assert sorted((r["page_id"], r["region_id"]) for r in found) == [(r["page_id"], r["region_id"]) for r in rows]
        assert all((r["members"] is None) == (sizes[r["page_id"]] > 60) for r in found)


def test_words_are_not_grouped_or_dealt_out_again(spark):
    rows = spark.createDataFrame([region(p, i, 60.0 * i, 40.0, 20.0, 50.0) for p in range(5) for i in range(40)], REGION)
    plan = layout._lines_in_tasks(rows, 4096)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
