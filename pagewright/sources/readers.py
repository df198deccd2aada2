"""Scans and sinks: images, manifests, results, dictionaries, counters."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import Refused
from pagewright.operators import manifest


def images(spark: SparkSession, path: str, *, drop_invalid: bool = False) -> DataFrame:
    """(origin, height, width, n_channels, data) of images; data is BGR by row. Undecodable files have height -1."""
    rows = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return rows.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def image_error(n_channels: Column, height: Column, width: Column) -> Column:
    """Why a row is no page, or null."""
    bad = (height < 1) | (width < 1) | (n_channels != 3)
    return F.when(bad, F.struct(F.lit("image-invalid").alias("code"), F.format_string("%d x %d x %d", height, width, n_channels).alias("detail")))


def manifest_path(path: str) -> str:
    return path if path.endswith(".json") else os.path.join(path, "ground-truth.json")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's cases, one row each; another version is refused."""
    document = spark.read.schema(manifest.SCHEMA).option("multiLine", True).json(manifest_path(path))
    versions = [r[0] for r in document.select("schema_version").limit(2).collect()]
    if versions != [manifest.VERSION]:
        raise ValueError(f"a manifest has schema_version {manifest.VERSION}, not {versions}")
    return document.select(F.inline("cases"))


def results(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of all results documents with their engine, device and document, by the document's path, then their place in it."""
    documents = spark.read.schema(manifest.RESULTS_SCHEMA).option("multiLine", True).json(pattern)
    rows = documents.select("engine", "device", F.col("_metadata.file_path").alias("document"), F.posexplode("rows").alias("place", "row"))
    return rows.select("engine", "device", "document", "place", "row.*").orderBy("document", "place")


def dictionary(spark: SparkSession, path: str) -> list[str]:
    """One class a line; a last line that is a single space is a class, one empty last line is not."""
    text = spark.read.text(path, wholetext=True).first()[0]
    classes = text.split("\n")
    if classes and classes[-1] == "":
        classes.pop()
    if len(classes) < 2:
        raise Refused("dictionary-invalid", f"{len(classes)} classes")
    return classes


def counter_files(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the counter files of a folder; files that vanish are skipped."""
    return spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True)


def write_manifest(path: str, document: dict) -> None:
    if document.get("schema_version") != manifest.VERSION or not isinstance(document.get("cases"), list):
        raise ValueError("not a manifest")
    spark = SparkSession.active()
    listed = [(i, json.dumps(case, ensure_ascii=False)) for i, case in enumerate(document["cases"])]
    manifest.validated(spark.createDataFrame(listed, "place long, case string"))
    with open(path, "w", encoding="utf-8") as out:
        json.dump(document, out, ensure_ascii=False, indent=2)


def hex_number(text: Column) -> Column:
    """A number in hexadecimal digits, 0x before them or not; null for anything else."""
    digits = F.regexp_extract(F.trim(text), r"^(?:0[xX])?([0-9a-fA-F]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def files_of(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, value) of the files of a pattern, in the order of paths; files that vanish are skipped."""
    rows = spark.read.option("ignoreMissingFiles", True).option("wholetext", True).text(pattern)
    return rows.select(F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("path"), "value").orderBy("path")


def busy_devices(spark: SparkSession, root: str = "/sys/class/drm") -> DataFrame:
    """Devices with a busy counter (path, name, vendor_id, device_id, drm_node) below ``root``; the node is part of the path."""
    beside = lambda name: files_of(spark, f"{root}/card*/device/{name}").select(F.regexp_extract("path", r"/([^/]+)/device/[^/]+$", 1).alias("node"), hex_number(F.col("value")).alias(f"{name}_id"))
    counters = files_of(spark, f"{root}/card*/device/gpu_busy_percent").select("path", F.regexp_extract("path", r"/([^/]+)/device/[^/]+$", 1).alias("node"))
    found = counters.join(beside("vendor"), "node", "left").join(beside("device"), "node", "left")
    return found.select("path", F.col("node").alias("name"), "vendor_id", "device_id", F.col("node").alias("drm_node"))
