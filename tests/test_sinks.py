"""Sinks that show all their files or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import manifest
from pagewright.sources import corpora, readers, sinks


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files if not f.endswith(".crc"))


def test_corpus_as_made(spark, tmp_path):
    made = corpora.cases(spark, "orientation").orderBy("place").collect()
    rows = spark.createDataFrame([(r.place, r.case, r.image, bytes(r.content)) for r in reversed(made)], "place long, case string, image string, content binary").repartition(3)
    assert sinks.write_corpus(rows, str(tmp_path)) == 4
    assert listed(tmp_path) == sorted(["ground-truth.json", *(r.image for r in made)])
    for r in made:
        assert (tmp_path / r.image).read_bytes() == bytes(r.content)
    document = json.loads((tmp_path / "ground-truth.json").read_text())
    assert document == {"schema_version": manifest.VERSION, "cases": [json.loads(r.case) for r in made]}
    assert readers.cases(spark, str(tmp_path)).count() == 4


def test_a_failed_task_shows_nothing(spark, tmp_path):
    made = corpora.cases(spark, "orientation").collect()
    rows = spark.createDataFrame([(r.place, r.case, r.image, bytes(r.content) if r.place != 2 else None) for r in made], "place long, case string, image string, content binary")
    with pytest.raises(Exception, match="(?i)writ|bytes|failed"):
        sinks.write_corpus(rows, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []


def test_a_bad_case_stops_before_any_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, '{"id": "x"}', "x.png", b"1")], "place long, case string, image string, content binary")
    with pytest.raises(ValueError, match="x|case"):
        sinks.write_corpus(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_results_in_many_documents(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 2).cast("string").alias("engine"), F.lit("cpu").alias("device"), F.format_string("case%05d", "id").alias("id"), F.lit(None).cast("string").alias("variant"), (F.col("id") % 7).alias("char_distance"), F.lit(10).cast("long").alias("char_length"), F.lit('é "quoted"').alias("note"))
    sinks.write_results(rows, str(tmp_path / "results"), document_rows=700)
    files = listed(tmp_path / "results")
    assert len(files) >= 7 and all(f.endswith(".json") and "staging" not in f for f in files)
    documents = [json.loads((tmp_path / "results" / f).read_text()) for f in files]
    assert {tuple(sorted(d)) for d in documents} == {("device", "engine", "rows")} and max(len(d["rows"]) for d in documents) < 1500
    for engine in "01":
        ids = [r["id"] for d in documents if d["engine"] == engine for r in d["rows"]]
        assert ids == sorted(ids) and len(ids) == 2500
    assert documents[0]["rows"][0]["variant"] is None and documents[0]["rows"][0]["note"] == 'é "quoted"'
    assert readers.results(spark, str(tmp_path / "results" / "*.json")).count() == 5000


def test_nothing_to_write(spark, tmp_path):
    sinks.write_results(spark.createDataFrame([], "engine string, device string, id string"), str(tmp_path / "none"))
    assert listed(tmp_path / "none") == []
