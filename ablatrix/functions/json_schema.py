"""A JSON Schema as expressions over a Variant: what is wrong with a value, and where."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ablatrix.errors import InvalidConfiguration
from ablatrix.functions.scoring import canonical, elements, is_kind, members, whole_json

#: The beginnings of a Variant's schema, by the names that JSON Schema has for kinds.
KINDS = {
    "object": ("OBJECT<",), "array": ("ARRAY<",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "integer": ("BIGINT", "DECIMAL", "DOUBLE"),
}
KNOWN = {
    "type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum",
    "exclusiveMinimum", "exclusiveMaximum", "allOf", "$schema", "title", "description",
}
PROBLEM = "array<struct<path:string,rule:string>>"

Check = Callable[[Column, Column], Column]


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _is(v: Column, name: str) -> Column:
    if name not in KINDS:
        raise InvalidConfiguration("schema_type_unknown", name)
    hit = is_kind(v, KINDS[name][0])
    for kind in KINDS[name][1:]:
        hit = hit | is_kind(v, kind)
    return hit & F.coalesce(_number(v) % 1.0 == 0, F.lit(False)) if name == "integer" else hit


def _literal(value: object) -> Column:
    return canonical(F.parse_json(F.lit(json.dumps(value))), trimmed=_holds_truth(value))


def _holds_truth(value: object) -> bool:
    """Does the value hold true or false?  Texts with outer white space are told apart only in values without."""
    parts = value.values() if isinstance(value, Mapping) else value if isinstance(value, list) else ()
    return isinstance(value, bool) or any(map(_holds_truth, parts))


def _equal(v: Column, value: object) -> Column:
    kind = _is(v, "boolean")
    return (kind if isinstance(value, bool) else ~kind) & (canonical(v, trimmed=_holds_truth(value)) == _literal(value))


def _one(bad: Column, path: Column, rule: str) -> Column:
    return F.when(bad, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array().cast(PROBLEM))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(PROBLEM)


def compiled(schema: Mapping | bool) -> Check:
    """check(value, path): an array of (path, rule), empty for a Variant that fits the schema.

    Keywords: type, enum, const, properties, required, additionalProperties, items, minItems, maxItems, uniqueItems, minLength,
    maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, allOf; any other is refused, lest it be passed
    over.  A keyword looks at values of its own kind only.  A missing value (null, not JSON's null) breaks "present".
    """
    if isinstance(schema, bool):
        return lambda v, path: F.array().cast(PROBLEM) if schema else _one(F.lit(True), path, "false")
    if unknown := set(schema) - KNOWN:
        raise InvalidConfiguration("schema_keyword_unknown", ", ".join(sorted(unknown)))

    def check(v: Column, path: Column) -> Column:
        found = _joined([c for rule in (_of_kind, _of_values, _of_numbers, _of_texts, _of_objects, _of_lists) for c in rule(schema, v, path)] + [compiled(s)(v, path) for s in schema.get("allOf", ())])
        return F.when(v.isNull(), F.array(F.struct(path.alias("path"), F.lit("present").alias("rule")))).otherwise(found)

    return check


def _of_kind(schema: Mapping, v: Column, path: Column) -> list[Column]:
    if "type" not in schema:
        return []
    names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    hit = F.lit(False)
    for name in names:
        hit = hit | _is(v, name)
    return [_one(~hit, path, "type")]


def _of_values(schema: Mapping, v: Column, path: Column) -> list[Column]:
    out = []
    if "enum" in schema:
        hit = F.lit(False)
        for value in schema["enum"]:
            hit = hit | _equal(v, value)
        out.append(_one(~hit, path, "enum"))
    if "const" in schema:
        out.append(_one(~_equal(v, schema["const"]), path, "const"))
    return out


def _of_numbers(schema: Mapping, v: Column, path: Column) -> list[Column]:
    bad = {"minimum": lambda x, y: x < y, "maximum": lambda x, y: x > y, "exclusiveMinimum": lambda x, y: x <= y, "exclusiveMaximum": lambda x, y: x >= y}
    return [_one(_is(v, "number") & test(_number(v), F.lit(float(schema[rule]))), path, rule) for rule, test in bad.items() if rule in schema]


def _of_texts(schema: Mapping, v: Column, path: Column) -> list[Column]:
    text = F.when(_is(v, "string"), F.try_variant_get(v, "$", "string"))
    bad = {"minLength": lambda n: F.length(text) < n, "maxLength": lambda n: F.length(text) > n, "pattern": lambda p: ~text.rlike(p)}
    return [_one(F.coalesce(test(schema[rule]), F.lit(False)), path, rule) for rule, test in bad.items() if rule in schema]


def _of_objects(schema: Mapping, v: Column, path: Column) -> list[Column]:
    own, fields = members(v), schema.get("properties", {})
    has = lambda name: F.coalesce(F.map_contains_key(own, F.lit(name)), F.lit(False))
    below = lambda name: F.concat(path, F.lit(f".{name}"))
    out = [_one(own.isNotNull() & ~has(name), below(name), "required") for name in schema.get("required", ())]
    for name, inner in fields.items():
        out.append(F.when(has(name), compiled(inner)(F.try_element_at(own, F.lit(name)), below(name))).otherwise(F.array().cast(PROBLEM)))
    if (more := schema.get("additionalProperties", True)) is not True:
        others = F.filter(F.map_entries(own), lambda e: ~e["key"].isin(*fields)) if fields else F.map_entries(own)
        each = (lambda e: F.array(F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), F.lit("additionalProperties").alias("rule")))) if more is False else (lambda e: compiled(more)(e["value"], F.concat(path, F.lit("."), e["key"])))
        out.append(F.coalesce(F.flatten(F.transform(others, each)), F.array().cast(PROBLEM)))
    return out


def _of_lists(schema: Mapping, v: Column, path: Column) -> list[Column]:
    own, out = elements(v), []
    if "items" in schema:
        each = lambda x, i: compiled(schema["items"])(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        out.append(F.coalesce(F.flatten(F.transform(own, each)), F.array().cast(PROBLEM)))
    for rule, bad in (("minItems", lambda n: F.size(own) < n), ("maxItems", lambda n: F.size(own) > n)):
        if rule in schema:
            out.append(_one(F.coalesce(own.isNotNull() & bad(schema[rule]), F.lit(False)), path, rule))
    if schema.get("uniqueItems"):
        forms = F.transform(own, lambda x: F.concat(_is(x, "boolean").cast("string"), canonical(x, trimmed=False)))
        out.append(_one(F.coalesce(F.size(F.array_distinct(forms)) < F.size(own), F.lit(False)), path, "uniqueItems"))
    return out


def problems(text: Column, schema: Mapping) -> Column:
    """What is wrong with a JSON text: an array of (path, rule); text that isn't JSON from end to end breaks "json" at $.

    The parsed value is worked out once, however many keywords look at it.
    """
    check = compiled(schema)
    said = F.transform(F.array(F.struct(whole_json(text).alias("v"))), lambda x: F.when(x["v"].isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))).otherwise(check(x["v"], F.lit("$"))))
    return said[0]
