"""Breaches inside a nested object."""

from pyspark.sql import functions as F

from pagewright.operators import schema


def test_breaches_of_a_nested_object(spark):
    inner = {"type": "object", "required": ["b"], "properties": {"b": {"type": "string", "pattern": "^x", "minLength": 2}}, "additionalProperties": False}
    rules = schema.compiled({"type": "object", "properties": {"a": inner}})
    rows = spark.createDataFrame([('{"a": {"b": "xy"}}',), ('{"a": {"b": "y"}}',), ('{"a": {"c": 1}}',)], "text string").select(rules(F.col("text")).alias("p"))
    assert [r.p for r in rows.collect()] == [[], ["a.b: pattern", "a.b: minLength"], ["a: no b", "a: unknown c"]]
