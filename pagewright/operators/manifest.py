"""The corpus manifest, version 4: its schema, its rules as columns, its parity with results."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators import schema

# The version and the fields of a manifest and of a results document.
VERSION = 4
SCHEMA = (
    "schema_version int, cases array<struct<id string, script string, language string, direction string, lines array<string>,"
    " font struct<family string, file string, source string, version string, license string>, palette struct<foreground string, background string>,"
    " size struct<font_px int, width_px int, height_px int>, background_objects array<struct<kind string, bounds array<int>, fill string>>,"
    " content_label string, known_false_readings array<string>, recognition map<string, map<string, string>>, variant string, image string>>"
)
RESULTS_SCHEMA = (
    "engine string, device string, rows array<struct<id string, variant string, ms double, truth_lines array<string>, observed_lines array<string>, selection string,"
    " char_distance bigint, char_length bigint, word_distance bigint, word_length bigint, cer double, wer double, exact boolean>>"
)

# Patterns and enumerations of the schema.
ID = r"^[a-z0-9][a-z0-9._-]*$"
SCRIPT = r"^[A-Z][a-z]{3}$"
LANGUAGE = r"^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$"
COLOUR = r"^#[0-9A-Fa-f]{6}$"
IMAGE = r"^(?!/)(?!.*(^|/)\.\.(/|$)).+\.(png|jpg|jpeg)$"
DIRECTIONS = ("ltr", "rtl")
LABELS = ("text", "positive-cjk", "negative-glyph-icon", "negative-background-object")
OBJECTS = ("rectangle", "circle", "line", "polygon")


def violations(case: dict[str, Column]) -> Column:
    """The names of the rules that a case breaks, in the order of its fields."""
    rules = {
        "id": ~case["id"].rlike(ID), "script": ~case["script"].rlike(SCRIPT), "language": ~case["language"].rlike(LANGUAGE), "direction": ~case["direction"].isin(*DIRECTIONS),
        "lines": F.exists(case["lines"], lambda x: x == ""), "palette": ~(case["foreground"].rlike(COLOUR) & case["background"].rlike(COLOUR)),
        "size": (case["width_px"] < 1) | (case["height_px"] < 1) | (case["font_px"] < 1),
        "content_label": ~case["content_label"].isin(*LABELS), "known_false_readings": (F.size(case["readings"]) != F.size(F.array_distinct(case["readings"]))) | F.exists(case["readings"], lambda x: x == ""),
        "variant": case["variant"] == "", "image": ~case["image"].rlike(IMAGE),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(name != "size")), F.lit(name)) for name, broken in rules.items())))


#: The rules of a case, as a JSON Schema document.
CASE_SCHEMA = os.path.join(os.path.dirname(__file__), "case.schema.json")


def case_problems(case: Column, rules: Mapping[str, Any] | None = None) -> Column:
    """All rules that a case (a string of JSON) breaks, as ``path: what``, in the order of paths; the first is the one to report.

    ``rules``: another JSON Schema document than that of this version's cases.
    """
    return schema.compiled(rules or schema.load(CASE_SCHEMA), root="case")(case)


def validated(cases: DataFrame) -> DataFrame:
    """``cases`` (place, case: JSON) as they are, if all keep the rules and no id is listed twice; else refused with the first problem."""
    broken = cases.select("place", F.get(case_problems(F.col("case")), F.lit(0)).alias("problem")).where("problem is not null").orderBy("place").head(1)
    if broken:
        raise ValueError(f"invalid manifest at cases.{broken[0]['place']}: {broken[0]['problem']}")
    if repeated_ids(cases.select(F.get_json_object("case", "$.id").alias("id"))).head(1):
        raise ValueError("invalid manifest: case ids repeat")
    return cases


def flat(cases: DataFrame) -> dict[str, Column]:
    """The columns that ``violations`` takes, of a scanned manifest's cases."""
    c = F.col
    return {n: c(n) for n in ("id", "script", "language", "direction", "lines", "content_label", "variant", "image")} | {
        "foreground": c("palette.foreground"), "background": c("palette.background"), "width_px": c("size.width_px"), "height_px": c("size.height_px"), "font_px": c("size.font_px"), "readings": c("known_false_readings")
    }


def repeated_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def without_selection(cases: DataFrame, selections: DataFrame) -> DataFrame:
    """Cases for which an engine has declared no selection (selections: id)."""
    return cases.join(selections.select("id").distinct(), "id", "left_anti")


def selection_key(selection: Column) -> Column:
    """One text for equal selections (a string of JSON): fields in order, at every depth."""
    return F.to_json(F.parse_json(selection))
