"""Table functions in SQL, and programs that stay open."""

import sys
import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import tables
from pagewright.plans.queries import QUERIES
from pagewright.plans.read_pages import wrapped
from pagewright.plans.readers_kept import read_kept

FOLDER = "/root/testdata/sf0.001"


def test_sql_equals_the_dataframe_form(spark):
    rows = [sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in QUERIES[name](spark, FOLDER).collect()) for name in ("detect_boxes", "detect_boxes_sql")]
    assert rows[0] and rows[0] == rows[1]


def test_odd_arguments(spark):
    tables.register(spark)
    assert spark.sql("SELECT * FROM map_regions(CAST(NULL AS ARRAY<DOUBLE>), 8, 1.0D)").collect() == []
    assert spark.sql("SELECT * FROM map_regions(ARRAY(1.0D, 2.0D, 3.0D), 2, 1.0D)").collect() == []
    assert spark.sql("SELECT * FROM text_lines(CAST(NULL AS STRING))").collect() == []
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_lines('a\\n\\nb')").collect()] == [(1, "a"), (2, ""), (3, "b")]


def test_words_to_lines(spark):
    tables.register(spark)
    texts = {1: "one two three four five six seven", 2: "averyveryverylongword a b", 3: "", 4: "x"}
    rows = [(k, i, w) for k, t in texts.items() for i, w in enumerate(t.split())] + [(5, 0, None)]
    spark.createDataFrame(rows, "key long, n int, word string").orderBy(F.rand(3)).repartition(3).createOrReplaceTempView("words")
    found = spark.sql("SELECT * FROM wrapped_words(TABLE(words), 10) ORDER BY key, line").collect()
    assert [(r.key, r.line, r.text) for r in found] == [(k, i + 1, line) for k, t in texts.items() for i, line in enumerate(wrapped(t, 10)) if line]
    for bad in ("wrapped_words(TABLE(words), 0)", "wrapped_words(TABLE(SELECT 1 AS key), 5)"):
        with pytest.raises(Exception, match="columns|no n, word"):
            spark.sql(f"SELECT * FROM {bad}").collect()


PROGRAM = """
import json, os, sys, time
with open(sys.argv[1] + "/started-%d" % os.getpid(), "w"):
    pass
for line in sys.stdin:
    said = open(line.strip()).read()
    if said == "die":
        sys.exit(3)
    if said == "sleep":
        time.sleep(30)
    print("nonsense" if said == "odd" else json.dumps([sys.argv[2], said, " "]), flush=True)
"""


def test_programs_stay_open(spark, tmp_path):
    (tmp_path / "program.py").write_text(PROGRAM)
    commands = {s: [sys.executable, str(tmp_path / "program.py"), str(tmp_path), s] for s in ("one", "two")}
    cases = spark.createDataFrame([(f"c{i:03}", "one" if i % 2 else "two", f"page {i}".encode()) for i in range(100)], "id string, selection string, image binary").coalesce(1)
    rows = read_kept(cases, commands).collect()
    assert {r.id: r.observed_lines for r in rows} == {f"c{i:03}": ["one" if i % 2 else "two", f"page {i}"] for i in range(100)}
    assert all(r.error is None and r.ms > 0 for r in rows) and len(list(tmp_path.glob("started-*"))) == 2


def test_programs_that_fail(spark, tmp_path):
    (tmp_path / "program.py").write_text(PROGRAM)
    commands = {"one": [sys.executable, str(tmp_path / "program.py"), str(tmp_path), "one"], "gone": ["/no/such/program"]}
    said = ["a", "die", "b", "odd", "c", "sleep", "d"]
    rows = [(f"c{i}", "one", s.encode()) for i, s in enumerate(said)] + [("x", "gone", b"a"), ("y", "unknown", b"a"), ("z", "one", None)]
    began = time.monotonic()
    found = {r.id: r for r in read_kept(spark.createDataFrame(rows, "id string, selection string, image binary").coalesce(1), commands, seconds=4.0).collect()}
    assert time.monotonic() - began < 60
    assert [found[f"c{i}"].observed_lines for i in (0, 2, 4, 6)] == [["one", x] for x in "abcd"]
    errors = {i: r.error for i, r in found.items() if r.error}
    assert set(errors) == {"c1", "c3", "c5", "x", "y"} and "exit 3" in errors["c1"] and "no answer in 4 s" in errors["c5"] and "no program" in errors["y"]
    assert len(list(tmp_path.glob("started-*"))) == 4
