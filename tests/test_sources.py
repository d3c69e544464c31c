import json

import pytest
from pyspark.sql import functions as F

from ablatrix import schemas
from ablatrix.errors import InvalidConfiguration, InvalidEvidence
from ablatrix.operators import aggregate, trace, verify
from ablatrix.plans import campaign, protocol, run
from ablatrix.sources import evidence, sinks
from ablatrix.streaming import resume


def observation(cond="a", value=1.0, **more):
    score = {"value": value, "numerator": value, "denominator": 1}
    return {"condition": cond, "component_id": "baseline", "partition": "discovery", "example_id": "1", "group_id": "g", "repetition": 0, "status": "complete", "expected_metric_ids": ["m"], "scores": {"m": score}} | more


def test_json_lines_to_aggregate(spark, tmp_path):
    path = tmp_path / "observations.jsonl"
    path.write_text("\n".join(json.dumps(observation(value=v, example_id=str(v))) for v in (0.0, 1.0)) + "\n")
    rows = evidence.observations(spark, str(path)).withColumnsRenamed({"condition": "cond", "partition": "split"})
    assert aggregate.incomplete_scores(rows).count() == 0
    assert aggregate.condition_aggregate(rows, aggregate.explode_scores(rows)).first().value == 0.5
    path.write_text('{"condition": 3\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        evidence.observations(spark, str(path)).collect()


def test_lines_that_are_refused(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 1, "a": 2}\n[NaN]\n')
    assert sorted(r.reason for r in evidence.refused_lines(spark, str(path)).collect()) == ["json_duplicate_key", "json_number_not_finite"]
    whole = tmp_path / "d.json"
    whole.write_text("[1] 2")
    assert [r.reason for r in evidence.refused_documents(spark, str(whole)).collect()] == ["json_malformed"]
    assert [r.reason for r in evidence.refused_documents(spark, str(whole), size=2).collect()] == ["artifact_too_large"]


def test_bundle_round_trip_and_forgery(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    manifest = sinks.publish_bundle(spark, {"t": df}, str(tmp_path / "bundle"))
    files = lambda: evidence.inventory(spark, str(tmp_path / "bundle")).filter("NOT path LIKE '%.crc' AND NOT path LIKE '%\\_SUCCESS'")
    assert verify.manifest_difference(manifest, files()).count() == 0 and evidence.bundle_violations(files()).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, str(tmp_path / "bundle/t"))
    part = next((tmp_path / "bundle/t").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own check
    data = bytearray(part.read_bytes())
    data[-1] ^= 1
    part.write_bytes(data)
    assert [r.rule for r in verify.manifest_difference(manifest, files()).collect()] == ["artifact_digest"]


def test_sensitive_columns_are_never_published(spark, tmp_path):
    df = spark.createDataFrame([("p", [("o",)])], "prompt string, x array<struct<raw_output:string>>")
    assert sinks.sensitive_columns(df.schema) == ["prompt", "x.raw_output"]
    with pytest.raises(InvalidEvidence):
        sinks.publish(df, str(tmp_path / "no"))
    kept = sinks.retained(spark.createDataFrame([("p", "o")], "prompt string, raw_output string"))
    assert kept.columns == ["output_sha256", "prompt_sha256"]


def test_create_once_freeze_and_canonical(tmp_path):
    assert sinks.canonical_bytes({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    with pytest.raises(ValueError):
        sinks.canonical_bytes(float("nan"))
    path = str(tmp_path / "f")
    sinks.create_once(path, b"1")
    sinks.create_once(path, b"1")
    with pytest.raises(InvalidEvidence):
        sinks.create_once(path, b"2")
    order = str(tmp_path / "order")
    assert sinks.freeze_sequence(order, ["b", "a"]) == ["b", "a"] and sinks.freeze_sequence(order, ["a", "b"]) == ["b", "a"]
    with pytest.raises(InvalidEvidence):
        sinks.freeze_sequence(order, ["a"])


def test_lines_csv_and_dataset(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n long")
    sinks.publish_lines(df, str(tmp_path / "l"), ["id"])
    assert [r.id for r in spark.read.schema("id string, n long").json(str(tmp_path / "l")).orderBy("id").collect()] == ["a", "b"]
    sinks.publish(df, str(tmp_path / "c"), "csv")
    assert evidence.csv_table(spark, str(tmp_path / "c"), "id string, n long").agg(F.sum("n")).first()[0] == 3
    record = {"id": "1", "partition": "d", "input": {"text": "t"}, "expected": "t", "metadata": {}}
    (tmp_path / "m.json").write_text(json.dumps({"license": "x", "revision": "1", "partitions": {"d": [record, record | {"id": "2"}], "v": [record | {"id": "3"}]}}))
    assert {(r.split, r.id) for r in evidence.dataset_records(spark, str(tmp_path / "m.json")).collect()} == {("d", "1"), ("d", "2"), ("v", "3")}


def test_commit_journal_and_resume(spark, tmp_path):
    plan = spark.createDataFrame([("t1",), ("t2",)], "id string")
    sinks.commit_task(spark.createDataFrame([(1,)], "x long"), str(tmp_path / "run"), "t1", "c", "v")
    markers = spark.read.parquet(str(tmp_path / "run/markers"))
    assert [r.id for r in resume.pending_tasks(plan, markers, "c", "v").collect()] == ["t2"]
    assert resume.pending_tasks(plan, markers, "other", "v").count() == 2
    assert resume.changed_payloads(markers, markers).count() == 0
    for attempt in (1, 2):
        sinks.journal(spark.createDataFrame([("t2", attempt, f"e{attempt}")], "task string, attempt long, reason string"), str(tmp_path / "j"))
    assert [r.reason for r in sinks.latest_failures(spark, str(tmp_path / "j")).collect()] == ["e2"]
    assert [(r.attempts, r.retries) for r in resume.retries(spark.read.parquet(str(tmp_path / "j"))).collect()] == [(2, 1)]


def test_payload_digest_is_of_the_rows_as_a_multiset(spark):
    digest = lambda ids, parts=1: sinks.payload_digest(spark.createDataFrame([(i,) for i in ids], "x long").repartition(parts), 8).first()[0]
    rows = list(range(50))
    assert digest(rows) == digest(rows[::-1], 5) and len({digest(rows), digest(rows[1:]), digest([*rows, 7]), digest([])}) == 4


def test_headlines_and_bands(spark):
    recorded = spark.createDataFrame([("a", 1.0, 0.1), ("b", 2.0, 0.1), ("c", 3.0, 0.1), ("d", None, 0.1)], "headline string, value double, tolerance double")
    found = spark.createDataFrame([("a", 1.05), ("b", 2.2), ("d", 1.0), ("e", 1.0)], "headline string, value double")
    assert sorted((r.rule, r.key) for r in verify.headlines(recorded, found).collect()) == [
        ("headline_differs", "b"), ("headline_differs", "d"), ("headline_missing", "c"), ("headline_unrecorded", "e"),
    ]
    stored = spark.createDataFrame([("x", 1.0, 0.5, 2.0, 0.0, 2.0), ("y", 1.0, 0.5, 2.0, 0.1, 2.0), ("z", 1.0, 0.5, 2.0, None, 2.1)], "cell string, point double, se double, critical double, low double, high double")
    assert sorted((r.rule, r.key) for r in verify.band_violations(stored, ["cell"]).collect()) == [("band_high", "z"), ("band_low", "y"), ("band_low", "z")]


def test_topology(spark):
    rows = [("m", 0, None, 0), ("m", 1, 0, 1), ("m", 2, 9, 2), ("m", 3, 2, -1), ("n", 0, 1, 0), ("n", 1, 0, 1), ("n", 2, None, 0), ("n", 2, None, 0)]
    out = trace.topology_violations(spark.createDataFrame(rows, "model string, id long, parent long, place int"), "model", "id", "parent", "place").collect()
    assert sorted((r.model, r.component, r.reason) for r in out) == [
        ("m", 2, "no_root_above"), ("m", 2, "parent_missing"), ("m", 3, "no_root_above"), ("m", 3, "order_negative"),
        ("n", 0, "no_root_above"), ("n", 1, "no_root_above"), ("n", 2, "component_duplicated"),
    ]


def test_incremental_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text(json.dumps({"id": "a", "n": 1}) + "\n")
    args = (spark, str(tmp_path / "in"), schemas.struct(id=schemas.TEXT, n=schemas.LONG), str(tmp_path / "out"), str(tmp_path / "cp"))
    for n in (1, 2):
        resume.land(*args).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in/2.jsonl").write_text(json.dumps({"id": "b", "n": 2}) + "\n")


def test_campaign_plan(spark):
    ids = [f"block.{i}" for i in range(4)]
    tasks = [r.id for r in campaign.campaign_plan(spark, ids, 7, matched=2, middle=0.5).orderBy("ordinal").collect()]
    assert tasks[:2] == ["baseline.beginning", "control.no-op"] and tasks[-1] == "baseline.end"
    assert tasks.index("baseline.middle") == tasks.index("scan.block.2") - 1
    assert [t for t in tasks if t.startswith("control.random")] == [f"control.random.{c}" for c in campaign.matched_random(ids, 2, 7)]
    assert sorted(campaign.shuffled(ids, 1)) == ids and campaign.shuffled(ids, 1) == campaign.shuffled(ids, 1)
    with pytest.raises(InvalidEvidence):
        campaign.campaign_tasks(["a", "a"], 1, matched=0)
    with pytest.raises(InvalidConfiguration):
        campaign.campaign_tasks(["a"], 1, matched=2)


def test_synthetic_run_end_to_end(spark):
    """A neutral component keeps every answer, the damaging one loses them all."""

    class Echo:
        def run(self, text, component):
            if text == "boom":
                raise RuntimeError("no")
            return run.DAMAGED if component == "component.damage" else text

    records = spark.createDataFrame([("1", "x", "x"), ("2", "y", "y"), ("3", "boom", "boom")], "id string, text string, expected string")
    plan = campaign.generic_plan(spark, ["component.damage", "component.neutral"])
    grid = campaign.observation_grid(plan, records, 2)
    assert grid.count() == 18
    out = run.evaluate(run.measure(grid, Echo, warmups=1), run.ExactMatch())
    rows = {r.cond: (r.v, r.errors) for r in out.groupBy("cond").agg(F.avg("scores.exact_match.value").alias("v"), F.count_if(F.col("status") == "error").alias("errors")).collect()}
    assert rows == {"baseline": (1.0, 2), "scan.component-damage": (0.0, 2), "scan.component-neutral": (1.0, 2)}
    assert out.filter("status = 'error' AND (scores IS NOT NULL OR error_type <> 'RuntimeError')").count() == 0


def test_registry():
    r = run.Registry()
    r.register("suite", "exact", run.ExactMatch(), needs=("score",))
    assert r.resolve("suite", "exact").name == "exact_match"
    for bad in (lambda: r.register("suite", "exact", 1), lambda: r.register("thing", "x", 1), lambda: r.register("model", "m", object(), needs=("run",)), lambda: r.resolve("model", "none")):
        with pytest.raises(InvalidConfiguration):
            bad()


def test_configuration():
    metric = {"id": "m", "role": "target", "direction": "higher_is_better"}
    good = {"revision": "a" * 40, "discovery": "d", "validation": "v", "metrics": [metric]}
    assert protocol.Experiment.from_mapping(good).metrics[0].id == "m"
    for bad in ({"revision": "main"}, {"revision": "refs/heads/x"}, {"validation": "d"}, {"metrics": []}, {"metrics": [metric, metric]}, {"metrics": [metric | {"role": "x"}]}, {"seed": -1}, {"extra": 1}):
        with pytest.raises(InvalidConfiguration):
            protocol.Experiment.from_mapping(good | bad)
    full = {"records_sha256": "a" * 64, "dataset_sha256": "b" * 64, "seed": 1, "metrics": {"m": metric}, "decision_rule": dict.fromkeys(("target_absolute_damage_max", "collateral_absolute_damage_max", "perplexity_relative_damage_max", "minimum_drift_margin"), 0.1)}
    protocol.validate_protocol(full)
    for bad in ({"seed": True}, {"records_sha256": "x"}, {"metrics": {}}, {"decision_rule": {}}, {"required_artifacts": ["a", "a"]}, {"metrics": {"m": metric | {"damage_formula": "other"}}}):
        with pytest.raises(InvalidConfiguration):
            protocol.validate_protocol(full | bad)


def test_authored_input(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"a": 1}')
    assert evidence.authored(str(path)) == {"a": 1}
    for text in ('{"a": 1, "a": 2}', "[1]"):
        path.write_text(text)
        with pytest.raises(InvalidConfiguration):
            evidence.authored(str(path))


def test_traces(spark, tmp_path):
    doc = {"trace_id": "t", "complete": True, "dropped_spans": 0, "spans": [{"name": "run", "trace_id": "t", "span_id": "s", "start_ns": 1, "end_ns": 9, "status": "ok", "attributes": {}, "events": [{"name": "decided", "timestamp": 3, "attributes": {"reason": "r"}}]}], "metrics": [{"name": "decisions", "points": [{"attributes": {"reason": "r"}, "value": 1}]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    traces = evidence.documents(spark, str(tmp_path / "t.json"), schemas.TRACE)
    assert trace.spans(traces).first().end_ns == 9
    key = F.col("attributes.reason").alias("reason")
    assert trace.counter_equality(trace.span_events(traces).select(key), trace.counter_points(traces).select(key, "value"), ["reason"]).count() == 0
