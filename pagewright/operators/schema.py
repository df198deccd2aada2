"""JSON Schema documents (draft 2020-12) as column expressions: which rules a row's JSON breaks, and where.

Known keywords: type, enum, const, pattern, minLength, maxLength, minimum,
maximum, exclusiveMinimum, exclusiveMaximum, properties, required,
additionalProperties (false), items, minItems, maxItems, uniqueItems, anyOf, and
$ref within the document. Any other that would restrict a value is refused when
the schema is compiled, as is a reference that leads back to itself: what a
column cannot check must not pass unseen. A subschema's ``title`` is what its
breach is called; without one, breaches are called by their keyword.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.geometry import let

_SILENT = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
_KNOWN = _SILENT | {
    "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "properties", "required", "additionalProperties", "items",
    "minItems", "maxItems", "uniqueItems", "anyOf", "$ref",
}
#: The start of a variant's type for each type of JSON.
_TYPES = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "null": r"^VOID$", "array": r"^ARRAY", "object": r"^OBJECT"}

_NONE = "array<string>"


def _kind(value: Column) -> Column:
    """A variant's type, "ABSENT" where there is none."""
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _get(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _field(value: Column, name: str) -> Column:
    quote = '"' if "'" in name else "'"
    if quote in name or "\\" in name:
        raise ValueError(f"cannot check a property of the name {name!r}")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def _text(value: Column) -> Column:
    """One text for equal values."""
    return F.to_json(value)


class _Compiler:
    def __init__(self, root: Mapping[str, Any]):
        self.root = root

    def resolved(self, schema: Any, seen: tuple[str, ...]) -> tuple[Any, tuple[str, ...]]:
        while isinstance(schema, Mapping) and "$ref" in schema:
            ref = schema["$ref"]
            if not ref.startswith("#") or ref in seen:
                raise ValueError(f"a reference that {'leads back to itself' if ref in seen else 'leaves the document'}: {ref}")
            target: Any = self.root
            for part in ref.removeprefix("#").split("/")[1:]:
                part = part.replace("~1", "/").replace("~0", "~")
                target = target[int(part)] if isinstance(target, list) else target[part]
            others = {k: v for k, v in schema.items() if k != "$ref"}
            if set(others) - _SILENT:
                target = {"anyOf": [target], **others} if not isinstance(target, Mapping) else {**target, **others}
            elif isinstance(target, Mapping):
                target = {**target, **others}
            schema, seen = target, (*seen, ref)
        return schema, seen

    def rules(self, schema: Any, value: Column, path: Column, seen: tuple[str, ...] = ()) -> Column:
        """array<string> of ``path: what`` for a value that is there, in the order of paths: its own breaches, then those of what it holds."""
        schema, seen = self.resolved(schema, seen)
        if schema is True or schema == {}:
            return F.array().cast(_NONE)
        if schema is False:
            return F.array(F.concat(path, F.lit(": not allowed")))
        if unknown := set(schema) - _KNOWN:
            raise ValueError(f"cannot check {', '.join(sorted(unknown))}")
        title = schema.get("title")
        kind = _kind(value)
        out: list[Column] = []

        def breach(bad: Column, what: str) -> None:
            out.append(F.when(bad, F.array(F.concat(path, F.lit(f": {what}")))).otherwise(F.array().cast(_NONE)))

        types = schema.get("type")
        types = [types] if isinstance(types, str) else types
        own: list[tuple[Column, str]] = []
        if types:
            own.append((~kind.rlike("|".join(_TYPES[t] for t in types)), f"no {' or '.join(types)}"))
        if "enum" in schema:
            own.append((~_text(value).isin(*(json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in schema["enum"])), "unknown"))
        if "const" in schema:
            own.append((_text(value) != F.lit(json.dumps(schema["const"], separators=(",", ":"), sort_keys=True, ensure_ascii=False)), "not the constant"))
        text, size = _get(value, "string"), _get(value, "double")
        is_text, is_number, is_list = kind == "STRING", kind.rlike(_TYPES["number"]), kind.startswith("ARRAY")
        for word, bad in (("pattern", lambda x: ~text.rlike(x)), ("minLength", lambda x: F.char_length(text) < x), ("maxLength", lambda x: F.char_length(text) > x)):
            if word in schema:
                own.append((is_text & bad(schema[word]), word))
        for word, bad in (("minimum", lambda x: size < x), ("maximum", lambda x: size > x), ("exclusiveMinimum", lambda x: size <= x), ("exclusiveMaximum", lambda x: size >= x)):
            if word in schema:
                own.append((is_number & bad(float(schema[word])), word))
        items = F.coalesce(_get(value, "array<variant>"), F.array().cast("array<variant>"))
        for word, bad in (("minItems", lambda x: F.size(items) < x), ("maxItems", lambda x: F.size(items) > x)):
            if word in schema:
                own.append((is_list & bad(schema[word]), word))
        if schema.get("uniqueItems"):
            texts = F.transform(items, _text)
            own.append((is_list & (F.size(texts) != F.size(F.array_distinct(texts))), "repeated"))
        if "anyOf" in schema:
            fits = [F.size(self.rules(s, value, path, seen)) == 0 for s in schema["anyOf"]]
            own.append((~_any(fits), "none of the choices"))
        if title:  # one name for whatever of these is broken
            if own:
                breach(_any([F.coalesce(bad, F.lit(True)) for bad, _ in own]), title)
        else:
            for bad, what in own:
                breach(F.coalesce(bad, F.lit(True)), what)
        self._object(schema, value, path, kind, seen, out)
        if "items" in schema and schema["items"] is not True:
            each = F.transform(items, lambda x, i: self.rules(schema["items"], x, F.concat(path, F.lit("."), i.cast("string")), seen))
            out.append(F.when(is_list, F.flatten(each)).otherwise(F.array().cast(_NONE)))
        return F.flatten(F.array(*out)) if out else F.array().cast(_NONE)

    def _object(self, schema: Mapping[str, Any], value: Column, path: Column, kind: Column, seen: tuple[str, ...], out: list[Column]) -> None:
        is_object = kind.startswith("OBJECT")
        keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast(_NONE))
        properties, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if more not in (True, False, {}):
            raise ValueError("cannot check additionalProperties that are a schema")
        said = lambda what, some: F.when(is_object, F.transform(F.array_sort(some), lambda k: F.concat(path, F.lit(f": {what} "), k))).otherwise(F.array().cast(_NONE))
        if schema.get("required"):
            out.append(said("no", F.array_except(F.array(*map(F.lit, schema["required"])), keys)))
        if more is False:
            out.append(said("unknown", F.array_except(keys, F.array(*map(F.lit, properties)).cast(_NONE))))
        # A value is taken out of what holds it once, and its keys are read once, not by each rule that looks at them.
        def field(name: str, has: Column) -> Column:
            here = F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
            found = let(_field(value, name), lambda inner: self.rules(properties[name], inner, here, seen))
            return F.when(is_object & F.array_contains(has, name), found).otherwise(F.array().cast(_NONE))

        if properties:
            out.append(let(keys, lambda has: F.flatten(F.array(*(field(name, has) for name in sorted(properties))))))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def compiled(schema: Mapping[str, Any], *, root: str = "$", not_json: str = "no JSON") -> Callable[[Column], Column]:
    """From a string column of JSON to array<string>: every breach as ``path: what``, in the order of paths; the root's path is written ``root``."""
    compiler = _Compiler(schema)

    def problems(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        once = F.transform(F.array(parsed), lambda v: compiler.rules(schema, v, F.lit("")))[0]
        named = F.transform(once, lambda p: F.when(p.startswith(":"), F.concat(F.lit(root), p)).otherwise(p))
        return F.when(parsed.isNull(), F.array(F.lit(f"{root}: {not_json}"))).otherwise(named)

    return problems


def load(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as file:
        return json.load(file)

