"""The schema compiler: each keyword by cases, and records of the library's own shape."""

import json

import pytest
from pyspark.sql import functions as F

from ablatrix.errors import InvalidConfiguration
from ablatrix.functions.json_schema import problems

RECORD = {
    "type": "object", "required": ["id", "input", "expected"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 1}, "partition": {"enum": ["discovery", "validation"]}, "expected": {"type": ["string", "array"], "items": {"type": "string"}, "minItems": 1},
        "input": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "pattern": "\\S"}}, "additionalProperties": {"type": "integer", "minimum": 0}},
    },
}


def found(spark, schema, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r.i: sorted((p.path, p.rule) for p in r.p) for r in rows.select("i", problems(F.col("t"), schema).alias("p")).collect()}
    return [out[i] for i in range(len(texts))]


CASES = [
    ({"type": "integer"}, ["1", "-2", "3.0", "1e2"], ["1.5", '"1"', "true", "null", "[]", "{}"]),
    ({"type": "number"}, ["1", "1.5", "1e400" if False else "1e300"], ['"1"', "false", "null"]),
    ({"type": "string"}, ['""', '"x"'], ["1", "null", "[]"]),
    ({"type": "boolean"}, ["true", "false"], ["1", "0", '"true"']),
    ({"type": ["null", "array"]}, ["null", "[]", "[1]"], ["{}", "0"]),
    ({"type": "object"}, ["{}", '{"a": 1}'], ["[]", '"{}"']),
    ({"enum": ["a", 1, None, [2], {"b": 1}]}, ['"a"', "1", "1.0", "null", "[2]", '{"b": 1.0}'], ['" a"', "true", "[true]", "2", '{"b": 2}', "[]"]),
    ({"enum": [True]}, ["true"], ["1", "false", '"true"']),
    ({"const": [1, "x "]}, ['[1, "x "]'], ['[1, "x"]', "[1]"]),
    ({"minLength": 2, "maxLength": 3}, ['"ab"', '"äöü"', "1", "[]"], ['"a"', '"abcd"', '""']),
    ({"pattern": "^a+$"}, ['"aa"', "5"], ['"ab"', '""']),
    ({"minimum": 0, "maximum": 10}, ["0", "10", "5.5", '"-1"'], ["-0.1", "11"]),
    ({"exclusiveMinimum": 0, "exclusiveMaximum": 1}, ["0.5"], ["0", "1", "1.0"]),
    ({"required": ["a"]}, ['{"a": null}', '{"a": 1, "b": 2}', "[]"], ["{}", '{"b": 1}']),
    ({"properties": {"a": {"type": "string"}}}, ['{"a": "x"}', "{}", '{"b": 1}', "3"], ['{"a": 1}', '{"a": null}']),
    ({"additionalProperties": False}, ["{}", "[1]"], ['{"a": 1}']),
    ({"properties": {"a": True}, "additionalProperties": {"type": "integer"}}, ['{"a": "x", "b": 1}'], ['{"b": "x"}']),
    ({"properties": {"a": False}}, ['{"b": 1}'], ['{"a": 1}']),
    ({"items": {"type": "integer", "minimum": 1}}, ["[]", "[1, 2]", '"x"'], ["[0]", '[1, "x"]']),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, ["[1]", "[1, 2]", "[1, true]", '["a", "a "]'], ["[]", "[1,2,3]", "[1, 1.0]", '[{"a": 1}, {"a": 1}]']),
    ({"allOf": [{"type": "integer"}, {"minimum": 3}]}, ["3"], ["2", '"x"']),
    ({}, ["1", "{}"], ["", "{", "[1] 2", '{"a": 1, "a": 2}']),
]


@pytest.mark.parametrize("schema,good,bad", CASES, ids=[json.dumps(c[0])[:40] for c in CASES])
def test_keywords(spark, schema, good, bad):
    out = found(spark, schema, *good, *bad)
    assert not any(out[: len(good)]) and all(out[len(good) :]), list(zip([*good, *bad], out))


def test_records_say_what_is_wrong_and_where(spark):
    good = {"id": "1", "partition": "discovery", "input": {"text": "t", "n": 3}, "expected": ["a", "b"]}
    assert found(spark, RECORD, json.dumps(good)) == [[]]
    bad = {"id": "", "partition": "other", "input": {"text": " ", "n": -1, "m": "x"}, "expected": [], "extra": 1}
    assert found(spark, RECORD, json.dumps(bad), '{"id": 5, "input": {}, "expected": [1, "a", null]}', "nonsense", None) == [
        [("$.expected", "minItems"), ("$.extra", "additionalProperties"), ("$.id", "minLength"), ("$.input.m", "type"), ("$.input.n", "minimum"), ("$.input.text", "pattern"), ("$.partition", "enum")],
        [("$.expected[0]", "type"), ("$.expected[2]", "type"), ("$.id", "type"), ("$.input.text", "required")],
        [("$", "json")], [("$", "json")],
    ]


def test_unknown_keywords_are_refused():
    for schema, reason in (({"oneOf": []}, "schema_keyword_unknown"), ({"items": {"format": "date"}}, "schema_keyword_unknown"), ({"type": "text"}, "schema_type_unknown")):
        with pytest.raises(InvalidConfiguration, match=reason):
            problems(F.lit("1"), schema)


def test_no_python_worker(spark):
    plan = spark.range(1).select(problems(F.lit("{}"), RECORD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
