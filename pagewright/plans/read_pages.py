"""From page images to lines of text: detection, crops, orientation, recognition, decoding, assembly.

Each step is a stage over a DataFrame, with tasks and, on a cluster, resources of
its own. A page's crops are dealt out again before the networks read them, so one
large page keeps all tasks busy. What cannot be read comes along as a row with
``error`` (code, detail) through all stages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagewright.backends import DICTIONARY, InferenceBackend, TemplateBackend
from pagewright.engine import Engine, chosen_nets, pixels_of, target_side
from pagewright.errors import Refused
from pagewright.functions import text as tx
from pagewright.operators import layout, pixels, scoring
from pagewright.shared import cut
from pagewright.sources.corpus import VARIANTS, render

Factory = Callable[[], InferenceBackend]

_ERROR = "error struct<code:string,detail:string>"
_BOX = "center_x double, center_y double, thickness double, length double, angle double, vertical boolean, box_score double"
#: What each stage gives.
DETECTED = f"page_id long, height int, width int, data binary, boxes array<struct<{_BOX.replace(' ', ':').replace(',:', ',')}>>, {_ERROR}"
CROPS = f"page_id long, region_id int, {_BOX}, patch_width int, patch binary, {_ERROR}"
ORIENTED = f"page_id long, region_id int, {_BOX}, patch_width int, patch binary, turned int, turn_score double, {_ERROR}"
LOGITS = f"page_id long, region_id int, {_BOX}, steps int, classes int, logits binary, {_ERROR}"
REGION = f"page_id long, region_id int, {_BOX}, text string, confidence double, {_ERROR}"


@dataclass(frozen=True)
class Reader:
    """What pages are read with; a task opens one engine for its stage."""

    factory: Factory = TemplateBackend
    dictionary: Sequence[str] = field(default_factory=lambda: DICTIONARY)
    target: int = pixels.TARGET
    offset: int = 1
    angles: Sequence[int] = (0, 180)
    nets: Sequence[str] = ("det", "ori", "rec")

    def open(self) -> Engine:
        return Engine(self.factory, self.dictionary, target=self.target, nets=self.nets, offset=self.offset, angles=self.angles)


def _refused(failure: Refused) -> dict[str, str]:
    return {"code": failure.code, "detail": failure.detail}


def _stage(rows: DataFrame, reader: Reader, body: Callable[[Engine, dict], list[dict]], schema: str, profile: ResourceProfile | None) -> DataFrame:
    """``body`` of each row without an error, with the task's engine; a row that it refuses, or that came with an error, goes on as an error."""
    spark = rows.sparkSession
    kinds = spark.createDataFrame([], schema).toArrow().schema
    ids = [n for n in ("page_id", "region_id") if n in rows.columns and n in kinds.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with reader.open() as engine:
            for batch in batches:
                for i in range(batch.num_rows):  # a page or a crop at a time: their sizes differ widely
                    row = batch.slice(i, 1).to_pylist()[0]
                    if row.get("error") is not None:
                        out = [{**{n: row[n] for n in ids}, "error": row["error"]}]
                    else:
                        try:
                            out = body(engine, row)
                        except Refused as failure:
                            out = [{**{n: row[n] for n in ids}, "error": _refused(failure)}]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(run, schema, profile=profile)


def detect(pages: DataFrame, reader: Reader = Reader(), profile: ResourceProfile | None = None) -> DataFrame:
    """``DETECTED`` of pages (page_id, height, width, data: BGR by row)."""

    def body(engine: Engine, row: dict) -> list[dict]:
        if (row["height"] or 0) < 1 or (row["width"] or 0) < 1 or len(row["data"] or b"") != row["height"] * row["width"] * 3:
            raise Refused("image-invalid", f"{row['height']} x {row['width']} with {len(row['data'] or b'')} bytes")
        image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)[..., ::-1]
        found = [dict(zip(("center_x", "center_y", "thickness", "length", "angle", "vertical", "box_score"), (*r[:5], bool(r.vertical), r.score), strict=True)) for r in engine.detect(image)]
        return [row | {"boxes": found, "error": None}]

    return _stage(pages.select(F.col("page_id").cast("long"), "height", "width", "data"), reader, body, DETECTED, profile)


def crops(detected: DataFrame, reader: Reader = Reader(), profile: ResourceProfile | None = None) -> DataFrame:
    """``CROPS``: each region set upright, 48 high, RGB by row; regions of no size are left out."""

    def body(_: Engine, row: dict) -> list[dict]:
        image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)[..., ::-1]
        out = []
        for i, box in enumerate(row["boxes"]):
            patch = pixels.crop(image, pixels.Region(*(box[n] for n in ("center_x", "center_y", "thickness", "length", "angle", "vertical", "box_score"))))
            if patch.size:
                out.append({"page_id": row["page_id"], "region_id": i, **box, "patch_width": patch.shape[1], "patch": patch.tobytes(), "error": None})
        return out

    return _stage(detected, reader, body, CROPS, profile)


def _patch(row: dict) -> np.ndarray:
    return np.frombuffer(row["patch"], np.uint8).reshape(pixels.PATCH_HEIGHT, row["patch_width"], 3)


def orient(cropped: DataFrame, reader: Reader = Reader(), profile: ResourceProfile | None = None) -> DataFrame:
    """``ORIENTED``: crops turned upright, with the angle and its score."""

    def body(engine: Engine, row: dict) -> list[dict]:
        patch, angle, score = engine.upright(_patch(row))
        return [row | {"patch": np.ascontiguousarray(patch).tobytes(), "turned": angle, "turn_score": score}]

    return _stage(cropped, reader, body, ORIENTED, profile)


def logits(cropped: DataFrame, reader: Reader = Reader(), profile: ResourceProfile | None = None) -> DataFrame:
    """``LOGITS`` of crops: scores (float32) by time step and class."""

    def body(engine: Engine, row: dict) -> list[dict]:
        scores = engine.logits(_patch(row))
        scores = scores[0] if scores.ndim == 3 and scores.shape[0] == 1 else scores
        if scores.ndim != 2:
            raise Refused("recognition-output-invalid", f"{scores.shape} is not steps by classes")
        kept = {n: row[n] for n in ("page_id", "region_id", *(x.split()[0] for x in _BOX.split(", ")))}
        return [kept | {"steps": scores.shape[0], "classes": scores.shape[1], "logits": np.ascontiguousarray(scores, np.float32).tobytes(), "error": None}]

    return _stage(cropped, reader, body, LOGITS, profile)


def decode(scored: DataFrame, reader: Reader = Reader(), profile: ResourceProfile | None = None) -> DataFrame:
    """``REGION`` of logits."""

    def body(engine: Engine, row: dict) -> list[dict]:
        text, confidence = engine.decode(np.frombuffer(row["logits"], np.float32).reshape(row["steps"], row["classes"]))
        kept = {n: row[n] for n in ("page_id", "region_id", *(x.split()[0] for x in _BOX.split(", ")))}
        return [kept | {"text": text, "confidence": confidence, "error": None}]

    return _stage(scored, reader, body, REGION, profile)


def recognise_page(rgb: np.ndarray, backend: InferenceBackend, dictionary: list[str], offset: int = 1) -> list[tuple]:
    """(region, text, confidence) of each region of a page."""
    with Engine(lambda: backend, dictionary, offset=offset) as engine:
        return engine.read(rgb)


def recognise(pages: DataFrame, factory: Factory = TemplateBackend, dictionary: Sequence[str] = DICTIONARY, *, target: Any = pixels.TARGET, nets: Sequence[str] | None = None, spread: int | None = None, profiles: dict[str, ResourceProfile] | None = None) -> DataFrame:
    """``REGION`` of pages, stage by stage; a page or crop that is refused is one row with ``error``.

    What no page could be read with is refused before any task starts. Crops are
    dealt to ``spread`` tasks (the session's parallelism). ``profiles``: resources
    by stage (detect, crops, orient, logits, decode).
    """
    reader = Reader(factory, list(dictionary), target_side(target), nets=chosen_nets(nets, True))
    own = profiles or {}
    cropped = crops(detect(pages, reader, own.get("detect")), reader, own.get("crops"))
    dealt = cropped.repartition(spread or pages.sparkSession.sparkContext.defaultParallelism, "page_id", "region_id")
    upright = orient(dealt, reader, own.get("orient")) if "ori" in reader.nets else dealt
    return decode(logits(upright, reader, own.get("logits")), reader, own.get("decode"))


def recognise_fused(pages: DataFrame, factory: Factory = TemplateBackend, dictionary: Sequence[str] = DICTIONARY, *, target: Any = pixels.TARGET, nets: Sequence[str] | None = None) -> DataFrame:
    """The same with all steps of a page in one task, without a shuffle: for many small pages."""
    reader = Reader(factory, list(dictionary), target_side(target), nets=chosen_nets(nets, True))

    def body(engine: Engine, row: dict) -> list[dict]:
        if (row["height"] or 0) < 1 or (row["width"] or 0) < 1 or len(row["data"] or b"") != row["height"] * row["width"] * 3:
            raise Refused("image-invalid", f"{row['height']} x {row['width']} with {len(row['data'] or b'')} bytes")
        image = pixels_of(np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)[..., ::-1])
        names = [x.split()[0] for x in _BOX.split(", ")]
        return [{"page_id": row["page_id"], "region_id": i, **dict(zip(names, (*r[:5], bool(r.vertical), r.score), strict=True)), "text": text, "confidence": confidence, "error": None} for i, (r, text, confidence) in enumerate(engine.read(image))]

    return _stage(pages.select(F.col("page_id").cast("long"), "height", "width", "data"), reader, body, REGION, None)


@dataclass(frozen=True)
class Reading:
    """``lines`` in reading order, ``refusals`` (page_id, region_id, code, detail), and how many regions and refusals there were."""

    lines: DataFrame
    refusals: DataFrame
    regions: int
    refused: int


def read(pages: DataFrame, *, fused: bool = False, **how: Any) -> Reading:
    """Lines of pages and what was refused, from one pass over the images, kept in the shared folder."""
    seen = Observation()
    found = (recognise_fused if fused else recognise)(pages, **how)
    found = cut(found.observe(seen, F.count_if(F.col("error").isNull()).alias("regions"), F.count_if(F.col("error").isNotNull()).alias("refused")))
    lines = layout.assemble(found.where("error is null").drop("error"))[0]
    refusals = found.where("error is not null").select("page_id", "region_id", "error.code", "error.detail")
    return Reading(lines, refusals, seen.get["regions"], seen.get["refused"])


def read_pages(pages: DataFrame, **how: Any) -> DataFrame:
    """Lines of pages in reading order; raises at the end of the read if anything was refused, as a caller of one page is told."""
    found = read(pages, **how)
    if found.refused:
        told = found.refusals.orderBy("page_id", "region_id").limit(20).collect()
        raise Refused(told[0]["code"], "; ".join(f"page {r['page_id']}: {r['code']}: {r['detail']}" for r in told) + (f" and {found.refused - 20} more" if found.refused > 20 else ""))
    return found.lines


def rendered(texts: DataFrame, variant: str = "clean", columns: int = 60) -> DataFrame:
    """Page images of (page_id, text), set in lines of at most so many letters."""
    degrade = VARIANTS[variant]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = np.ascontiguousarray(degrade(render(wrapped(text or "", columns)))[..., ::-1])
                yield pa.record_batch({"page_id": pa.array([page], pa.int64()), "height": pa.array([image.shape[0]], pa.int32()), "width": pa.array([image.shape[1]], pa.int32()), "data": pa.array([image.tobytes()], pa.binary())})

    return texts.select(F.col("page_id").cast("long"), "text").mapInArrow(run, "page_id long, height int, width int, data binary")


def wrapped(text: str, columns: int) -> list[str]:
    lines = [""]
    for word in text.split():
        if lines[-1] and len(lines[-1]) + 1 + len(word) > columns:
            lines.append("")
        lines[-1] += (" " if lines[-1] else "") + word
    return lines


def read_and_score(spark: SparkSession, texts: DataFrame, variant: str = "clean") -> DataFrame:
    """(page_id, observed lines, character distance and length, cer) of texts rendered and read back."""
    lines = read_pages(rendered(texts, variant))
    observed = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("center_y", "center_x", "text"))).alias("l")).select("page_id", F.transform("l", lambda x: x["text"]).alias("observed_lines"))
    truth = texts.select("page_id", F.array(tx.composed(F.regexp_replace("text", r"\s+", " "))).alias("truth_lines"))
    joined = truth.join(observed, "page_id", "left").withColumn("observed_lines", F.array(F.array_join(F.coalesce("observed_lines", F.array()), " ")))
    return scoring.score_cases(joined).select("page_id", "char_distance", "char_length", "cer", "exact")
