"""A corpus run: every case read and timed, scored, checked against the manifest, written."""

from __future__ import annotations

import os
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.backends import DICTIONARY, InferenceBackend, TemplateBackend
from pagewright.engine import Engine
from pagewright.operators import layout, manifest, pixels, scoring
from pagewright.shared import shared_folder
from pagewright.sources import readers

_REGION = "region_id int, center_x double, center_y double, thickness double, length double, angle double, vertical boolean, text string, confidence double, box_score double"
_READ = f"id string, selection string, ms double, error string, regions array<struct<{_REGION.replace(' ', ':').replace(',:', ',')}>>"
_TYPES = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

Factory = Callable[[str], InferenceBackend]


def stand_in(selection: str) -> InferenceBackend:
    """One back end for every selection."""
    return TemplateBackend()


def timed(cases: DataFrame, factory: Factory = stand_in, dictionary: list[str] = DICTIONARY) -> DataFrame:
    """(id, selection, ms, error, regions) of cases (id, selection, height, width, data).

    A task holds one engine a selection. The first page of each is read once
    more beforehand, so that no time contains the warming of an engine.
    """
    region = pa.struct([(n, _TYPES[t]) for n, t in (f.split() for f in _REGION.split(", "))])
    names = region.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines: dict[str, Engine] = {}
        try:
            for batch in batches:
                for case, selection, height, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page = np.frombuffer(data or b"", np.uint8)
                    error, found, took = None, [], None
                    try:
                        page = page.reshape(height, width, 3)[..., ::-1]
                        if selection not in engines:
                            engines[selection] = Engine(lambda s=selection: factory(s), dictionary)
                            engines[selection].read(page)
                        began = time.perf_counter()
                        found = engines[selection].read(page)
                        took = (time.perf_counter() - began) * 1000
                    except ValueError as refused:
                        error = str(refused)
                    rows = [dict(zip(names, (i, r.center_x, r.center_y, r.thickness, r.length, r.angle, bool(r.vertical), text, confidence, r.score), strict=True)) for i, (r, text, confidence) in enumerate(found)]
                    yield pa.record_batch([pa.array([case], pa.string()), pa.array([selection], pa.string()), pa.array([took], pa.float64()), pa.array([error], pa.string()), pa.array([rows], pa.list_(region))], ["id", "selection", "ms", "error", "regions"])
        finally:
            for engine in engines.values():
                engine.close()

    return cases.select("id", "selection", "height", "width", "data").mapInArrow(run, _READ)


def run_corpus(spark: SparkSession, folder: str, *, engine: str, device: str, selector: str = "pagewright", factory: Factory = stand_in) -> DataFrame:
    """Result rows of all cases of a corpus folder, scored; refused where the ids that came are not those listed.

    Cases must each declare what ``selector`` is to read them with. The reads are
    kept in the shared folder, so that no page is read and timed twice.
    """
    listed = readers.cases(spark, folder).withColumn("selection", manifest.selection_key(F.to_json(F.try_element_at("recognition", F.lit(selector)))))
    if not listed.head(1):
        raise ValueError("a run needs a case")
    if lacking := listed.where("selection is null").select("id").orderBy("id").limit(20).collect():
        raise ValueError(f"no {selector} model is declared for {', '.join(r['id'] for r in lacking)}")
    pages = readers.images(spark, folder).withColumn("image", F.element_at(F.split("origin", "/"), -1))
    joined = listed.join(pages, F.element_at(F.split(listed["image"], "/"), -1) == pages["image"]).select("id", "selection", "height", "width", "data")
    kept = f"{shared_folder(spark)}/run-{time.time_ns()}"
    timed(joined.repartition(spark.sparkContext.defaultParallelism, "selection", "id"), factory).write.parquet(kept)
    reads = spark.read.parquet(kept)
    if failed := reads.where("error is not null").select("id", "error").orderBy("id").limit(20).collect():
        raise ValueError("; ".join(f"{r['id']}: {r['error']}" for r in failed))
    regions = reads.select(F.col("id").alias("page_id"), F.inline("regions"))
    lines = layout.assemble(regions)[0].groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "text"))).alias("l")).select(F.col("page_id").alias("id"), F.transform("l", lambda x: x["text"]).alias("observed_lines"))
    rows = listed.select("id", "variant", "selection", F.col("lines").alias("truth_lines")).join(reads.select("id", "ms"), "id").join(lines, "id", "left").withColumn("observed_lines", F.coalesce("observed_lines", F.array().cast("array<string>")))
    if differ := scoring.id_multiset_parity(listed.select("id"), reads.select("id")).orderBy("side", "id").limit(20).collect():
        raise ValueError("results differ from the manifest: " + ", ".join(f"{r['side']} {r['id']}" for r in differ))
    # The scored columns hold normalised lines; results keep the lines as they were read.
    scored = scoring.score_cases(rows).select("id", "char_distance", "char_length", "word_distance", "word_length", "cer", "wer", "exact")
    return rows.join(scored, "id").withColumn("engine", F.lit(engine)).withColumn("device", F.lit(device))


def progress(rows: DataFrame) -> DataFrame:
    """(id, line): a case's outcome in one line."""
    return rows.select("id", F.format_string("%-34s cer=%.3f wer=%.3f %7.1f ms", "id", "cer", "wer", "ms").alias("line"))


def read_with(cases: DataFrame, command: Sequence[str]) -> DataFrame:
    """(id, ms, error, observed_lines) of cases (id, image: PNG or JPEG bytes) by another program.

    ``command`` gets the image's path as its last argument, in the place of
    ``{}`` if it has one; what it prints, but for blank lines, is what it read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch:  # for the program's input alone, in the task that runs it
            for batch in batches:
                for case, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    path = os.path.join(scratch, "page")
                    with open(path, "wb") as out:
                        out.write(image)
                    line = [x.replace("{}", path) for x in command]
                    began = time.perf_counter()
                    done = subprocess.run(line if line != list(command) else [*line, path], capture_output=True, text=True)
                    took = (time.perf_counter() - began) * 1000
                    lines = [x for x in done.stdout.split("\n") if x.strip()] if not done.returncode else []
                    error = f"exit {done.returncode}: {done.stderr.strip()[:200]}" if done.returncode else None
                    yield pa.record_batch([pa.array([case], pa.string()), pa.array([took]), pa.array([error], pa.string()), pa.array([lines], pa.list_(pa.string()))], ["id", "ms", "error", "observed_lines"])

    return cases.select("id", "image").mapInArrow(run, "id string, ms double, error string, observed_lines array<string>")


def phases(pages: DataFrame, factory: Factory = stand_in, dictionary: list[str] = DICTIONARY) -> DataFrame:
    """(page_id, phase, calls, ms) of pages (page_id, height, width, data): what finding, cutting, turning and reading took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Engine(lambda: factory(""), dictionary) as engine:
            for batch in batches:
                for page, height, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    image = np.frombuffer(data, np.uint8).reshape(height, width, 3)[..., ::-1]
                    spent: dict[str, list[float]] = {}

                    def clocked(phase: str, step: Callable, *values):
                        began = time.perf_counter()
                        try:
                            return step(*values)
                        finally:
                            spent.setdefault(phase, []).append((time.perf_counter() - began) * 1000)  # noqa: B023

                    for region in clocked("detect", engine.detect, image):
                        patch = clocked("crop", pixels.crop, image, region)
                        if patch.size:
                            clocked("recognise", engine.logits, clocked("orient", engine.upright, patch)[0])
                    names = list(spent)
                    yield pa.record_batch([pa.array([page] * len(names), pa.int64()), pa.array(names), pa.array([len(spent[n]) for n in names], pa.int64()), pa.array([sum(spent[n]) for n in names])], ["page_id", "phase", "calls", "ms"])

    return pages.select(F.col("page_id").cast("long"), "height", "width", "data").mapInArrow(run, "page_id long, phase string, calls long, ms double")
