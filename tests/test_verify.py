import pytest

from ablatrix.errors import InvalidEvidence
from ablatrix.operators import sets, trace, verify

MANIFEST = "path string, bytes long, sha256 string"
A, B = "a" * 64, "b" * 64


@pytest.mark.parametrize("listed,rule", [
    ([("x", 1, A), ("y", 2, B)], None), ([("x", 1, A)], "artifact_unbound"), ([("x", 1, A), ("y", 2, B), ("z", 3, A)], "artifact_missing"), ([("x", 1, A), ("y", 3, B)], "artifact_size"),
    ([("x", 1, A), ("y", 2, A)], "artifact_digest"), ([("x", 1, A), ("y", 2, "B" * 64)], "digest_malformed"), ([("x", 1, A), ("y", 2, B), ("y", 2, B)], "artifact_listed_twice"),
])
def test_each_forgery_breaks_its_rule(spark, listed, rule):
    files = spark.createDataFrame([("x", 1, A), ("y", 2, B)], MANIFEST)
    found = verify.manifest_difference(spark.createDataFrame(listed, MANIFEST), files)
    assert [r.rule for r in found.collect()] == ([rule] if rule else [])
    if rule:
        with pytest.raises(InvalidEvidence, match=rule):
            verify.enforce(found)
    else:
        verify.enforce(found)


def test_paths_stay_inside(spark):
    rows = spark.createDataFrame([("a/b", 1, A), ("../b", 1, A), ("/b", 1, A), ("a/../../b", 1, A), ("a..b", 1, A)], MANIFEST)
    assert {r.key for r in verify.unsafe_paths(rows).collect()} == {"../b", "/b", "a/../../b"}


def test_tables_differ_by_key_value_and_null(spark):
    kind = "k long, v double, s string"
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], kind)
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, 2.1, None), (4, 3.0, "z")], kind)
    assert {r.key for r in verify.table_difference("t", a, b, ["k"], ["v", "s"]).collect()} == {"2.v", "3.v", "3.s", "4.v", "4.s"}


def test_multisets(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "k string") for t in ("aab", "abb"))
    assert {(r.k, r.side, r["rows"]) for r in sets.difference(a, b).collect()} == {("a", "missing", 1), ("b", "unexpected", 1)}
    assert verify.coverage("r", a, a).count() == 0 and verify.coverage("r", a, b).count() == 2


def test_plan_coverage_and_order(spark):
    plan = spark.createDataFrame([("a",), ("b",)], "cond string")
    seen = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "cond string, repetition long")
    assert {(r.cond, r.repetition, r.side) for r in verify.plan_coverage(plan, 2, seen, ["cond"]).collect()} == {("b", 1, "missing"), ("b", 2, "unexpected")}
    one, two = (spark.createDataFrame(x, "id string, n long") for x in ([("a", 0), ("b", 1)], [("a", 1), ("b", 1)]))
    assert verify.order_difference(one, two, "id", "n").count() == 1


def test_disjoint(spark):
    rows = spark.createDataFrame([("x", "d"), ("x", "v"), ("y", "d")], "id string, split string")
    assert [r.key for r in verify.disjoint("shared", rows, "id", "split").collect()] == ["x"]


NODES = "g string, id string, up string"


def test_roots_cycles_and_lost_parents(spark):
    chain = [("t", "n0", None), *(("t", f"n{i}", f"n{i - 1}") for i in range(1, 40))]
    rows = spark.createDataFrame([*chain, ("t", "c1", "c2"), ("t", "c2", "c1"), ("t", "below", "c1"), ("t", "lost", "nowhere")], NODES)
    found = {r.id: (r.root, r.depth) for r in trace.reach_roots(rows, "id", "up").collect()}
    assert all(found[f"n{i}"] == ("n0", i) for i in range(40))
    assert all(found[n] == (None, None) for n in ("c1", "c2", "below", "lost"))
    assert {(r.node, r.reason) for r in trace.graph_violations(rows, "g", "id", "up").collect()} == {("lost", "parent_missing")}


def test_counters(spark):
    events = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    points = spark.createDataFrame([("a", 1), ("a", 1), ("c", 2)], "k string, value long")
    assert {r.k for r in trace.counter_equality(events, points, ["k"]).collect()} == {"b", "c"}
    owed = spark.createDataFrame([("c", 2)], "k string, value long")
    assert {r.k for r in trace.counter_equality(events, points, ["k"], owed).collect()} == {"b"}
    bounds = spark.createDataFrame([("a", 2, None), ("b", None, 2), ("c", None, None)], "name string, exact long, minimum long")
    assert [r.name for r in trace.count_bounds(spark.createDataFrame([("a", 2), ("b", 1)], "name string, n long"), bounds).collect()] == ["b"]


def test_hooks_and_completeness(spark):
    rows = spark.createDataFrame([("s", "active", 2), ("s", "removed", 1), ("s", "failed", 1), ("u", "active", 1), ("v", "cleanup_failed", 1)], "segment string, kind string, value long")
    assert {r.segment for r in trace.hook_balance(rows, "segment").collect()} == {"u", "v"}
    traces = spark.createDataFrame([("a", True, 0), ("b", True, 1), ("c", None, None)], "trace_id string, complete boolean, dropped_spans long")
    assert [r.trace_id for r in trace.completeness(traces).collect()] == ["b", "c"] and [r.trace_id for r in trace.completeness(traces, "1").collect()] == ["b"]
