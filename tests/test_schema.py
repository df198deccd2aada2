"""JSON Schema documents as columns, keyword by keyword, against values that keep and break them."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import manifest, schema


def problems(spark, rules, *values):
    texts = [v if isinstance(v, str) and v.startswith("{bad") else json.dumps(v) for v in values]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.p for r in rows.select("i", schema.compiled(rules)(F.col("text")).alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("rules", "good", "bad"),
    [
        ({"type": "string"}, ["", "x"], [1, None, ["x"], {}]),
        ({"type": "integer"}, [0, -5, 2**40], [1.5, "1", True, None]),
        ({"type": ["number", "null"]}, [0, 1.5, None], ["1", False]),
        ({"type": "boolean"}, [True, False], [0, "true"]),
        ({"enum": ["a", 1, None]}, ["a", 1, None], ["b", 2, "1", False]),
        ({"const": {"b": 1, "a": [2]}}, [{"a": [2], "b": 1}], [{"a": [2]}, 1]),
        ({"pattern": "^a+$"}, ["aa", 7], ["b", ""]),
        ({"minLength": 2, "maxLength": 3}, ["ab", "aé中", 5], ["a", "abcd"]),
        ({"minimum": 2, "maximum": 4}, [2, 4, 3.5, "1"], [1.9, 5]),
        ({"exclusiveMinimum": 2, "exclusiveMaximum": 4}, [3, 2.1], [2, 4]),
        ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], "text"], [[], [1, 2, 3]]),
        ({"uniqueItems": True}, [[1, 2], [], [[1], [2]], 5], [[1, 1], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
        ({"items": {"type": "integer"}}, [[1, 2], [], "x"], [[1, "a"], ["b"]]),
        ({"required": ["a"]}, [{"a": None}, 5], [{}, {"b": 1}]),
        ({"properties": {"a": {"type": "string"}}}, [{"a": "x"}, {}, {"b": 3}], [{"a": 1}, {"a": None}]),
        ({"properties": {"a": {}}, "additionalProperties": False}, [{"a": 1}, {}], [{"b": 1}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 3, "type": "integer"}]}, ["x", 3], [2, None]),
        ({"$defs": {"n": {"type": "integer"}}, "properties": {"x": {"$ref": "#/$defs/n"}}}, [{"x": 1}], [{"x": "1"}]),
        (False, [], [1, None]),
    ],
)
def test_keywords(spark, rules, good, bad):
    found = problems(spark, rules, *good, *bad)
    assert all(p == [] for p in found[: len(good)]) and all(p for p in found[len(good) :])


def test_paths_in_order(spark):
    rules = {
        "type": "object", "required": ["id", "size"], "additionalProperties": False,
        "properties": {"id": {"type": "string", "title": "no id"}, "list": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"enum": ["a"]}}}}, "it's": {"type": "null"}, "size": {"properties": {"w": {"minimum": 1}}}},
    }
    found = problems(spark, rules, {"id": 5, "list": [{"k": "a"}, {}, {"k": "b"}], "zzz": 1, "size": {"w": 0}}, [1], {"id": "x", "size": {}, "it's": 3}, "{bad")
    assert found[0] == ["$: unknown zzz", "id: no id", "list.1: no k", "list.2.k: unknown", "size.w: minimum"]
    assert found[1] == ["$: no object"] and found[2] == ["it's: no null"] and found[3] == ["$: no JSON"]


def test_what_cannot_be_checked_is_refused(spark):
    for rules in ({"patternProperties": {}}, {"properties": {"a": {"oneOf": []}}}, {"additionalProperties": {"type": "string"}}, {"$ref": "#"}, {"properties": {"a": {"$ref": "#"}}}, {"$ref": "http://elsewhere"}):
        with pytest.raises(ValueError, match="cannot check|reference"):
            schema._Compiler(rules).rules(rules, F.lit(None), F.lit(""))


def test_nulls_and_another_schema_of_cases(spark):
    own = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^[0-9]+$", "title": "no number"}}}
    rows = spark.createDataFrame([(0, '{"id": "12"}'), (1, '{"id": "x"}'), (2, None)], "place long, case string")
    found = [r.p for r in rows.select("place", manifest.case_problems(F.col("case"), own).alias("p")).orderBy("place").collect()]
    assert found == [[], ["id: no number"], ["case: no JSON"]]
