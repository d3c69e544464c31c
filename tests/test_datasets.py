"""Providers, and each thing that can be wrong with records and their plan."""

import json

import pytest
from pyspark.sql import functions as F

from ablatrix.errors import InvalidConfiguration, InvalidEvidence
from ablatrix.sources import bundle, datasets
from ablatrix.sources.sinks import payload_digest

SCHEMA = "id string, group_id string, kind string, split string, ordinal long"


def planned(spark):
    rows = [(f"{s[0]}{k[0]}{i}", f"g{s[0]}{i}", k, s, i) for s in datasets.ROLES for k in ("simple", "format") for i in (1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


def rules(df):
    return sorted((r.rule, r.key) for r in df.collect())


@pytest.mark.parametrize("change,wanted", [
    (lambda d: d, []),
    (lambda d: d.filter("id <> 'ds1'"), [("record_missing", "ds1/gd1/simple/discovery")]),
    (lambda d: d.unionByName(d.filter("id = 'vf2'")), [("record_id_repeated", "vf2"), ("record_repeated", "vf2/gv2/format/validation")]),
    (lambda d: d.withColumn("kind", F.when(F.col("id") == "ds1", "format").otherwise(F.col("kind"))), [("record_missing", "ds1/gd1/simple/discovery"), ("record_unplanned", "ds1/gd1/format/discovery")]),
    (lambda d: d.withColumn("group_id", F.when(F.col("id") == "ds1", "gv1").otherwise(F.col("group_id"))), [("group_crosses_splits", "gv1"), ("record_missing", "ds1/gd1/simple/discovery"), ("record_unplanned", "ds1/gv1/simple/discovery")]),
    (lambda d: d.withColumn("split", F.when(F.col("id") == "ds1", "holdout").otherwise(F.col("split"))), [("group_crosses_splits", "gd1"), ("record_missing", "ds1/gd1/simple/discovery"), ("record_unplanned", "ds1/gd1/simple/holdout"), ("split_unknown", "ds1")]),
    (lambda d: d.withColumn("split", F.when(F.col("id") != "ds1", F.col("split"))), [("record_missing", "ds1/gd1/simple/discovery"), ("record_unplanned", "ds1/gd1/simple/"), ("split_unknown", "ds1")]),
])
def test_membership(spark, change, wanted):
    plan = planned(spark)
    assert rules(datasets.membership(change(plan).drop("ordinal"), plan)) == wanted


def test_plan_identity(spark):
    plan = planned(spark)
    digest = payload_digest(plan).first().payload_sha256
    assert rules(datasets.plan_identity(plan, digest)) == [] and rules(datasets.plan_identity(plan, "0" * 64)) == [("plan_digest", "plan")]
    assert rules(datasets.plan_identity(plan.filter("id <> 'ds2'"))) == [("plan_ordinals", "discovery/simple")]
    assert rules(datasets.plan_identity(plan.withColumn("id", F.when(F.col("id") == "ds2", "ds1").otherwise(F.col("id"))))) == [("plan_id_repeated", "ds1")]
    assert rules(datasets.plan_identity(plan.withColumn("group_id", F.lit("g")))) == [("plan_group_crosses_splits", "g")]


def test_frozen_dataset(spark):
    plan = planned(spark)
    frozen = datasets.FrozenDataset(plan.drop("ordinal"), plan).checked()
    assert frozen.records("discovery").count() == 6 and frozen.metadata()["splits"] == list(datasets.ROLES)
    with pytest.raises(InvalidConfiguration, match="dataset_split_unavailable"):
        frozen.records("holdout")
    with pytest.raises(InvalidEvidence, match="record_missing"):
        datasets.FrozenDataset(plan.drop("ordinal").filter("id <> 'ds3'"), plan).checked()


def test_manifest_and_evidence_datasets(spark, tmp_path):
    record = {"id": "1", "partition": "discovery", "input": {"text": "t"}, "expected": "t", "metadata": {}}
    manifest = {"license": "x", "revision": "1", "partitions": {"discovery": [record, record | {"id": "2"}], "validation": [record | {"id": "3", "partition": "validation"}]}}
    path = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    listed = datasets.ManifestDataset(spark, path).checked()
    assert [r.id for r in listed.records("validation").collect()] == ["3"]
    schema = {"type": "object", "required": ["id", "input"], "properties": {"id": {"type": "string"}, "input": {"properties": {"text": {"minLength": 2}}}}}
    assert sorted((r.rule, r.key, r.actual) for r in listed.validate_for(schema).collect()) == [("schema_minLength", i, "$.input.text") for i in "123"]
    manifest["partitions"]["validation"] = [record, record | {"id": "3"}]
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert rules(datasets.ManifestDataset(spark, path).violations()) == [("partition_differs", "1"), ("partition_differs", "3"), ("record_id_repeated", "1")]
    bundle.publish_evidence(planned(spark), str(tmp_path / "b"))
    held = datasets.EvidenceDataset(spark, str(tmp_path / "b")).checked()
    assert held.records("validation").count() == 6 and held.metadata()["sha256"] == datasets.FrozenDataset(planned(spark), planned(spark)).metadata()["sha256"]
