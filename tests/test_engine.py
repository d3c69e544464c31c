import pytest
from pyspark.sql import functions as F

from ablatrix import engine
from ablatrix.errors import InvalidEvidence
from ablatrix.plans.campaign import PUBLISHED_COUNTS
from ablatrix.plans.run import DAMAGED


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    class Echo:
        def run(self, text, component):
            return DAMAGED if component == "component.damage" else text

    rows = [(f"{s}-{i}", f"g{i}", s, f"text {i}", f"text {i}") for s in ("discovery", "validation") for i in range(3)]
    records = spark.createDataFrame(rows, "id string, group_id string, split string, text string, expected string")
    metrics = spark.createDataFrame([("exact_match", "target", "higher_is_better")], "metric string, role string, direction string")
    path = str(tmp_path_factory.mktemp("run") / "bundle")
    engine.run(spark, path, records, metrics, ["component.damage", "component.neutral"], Echo, matched=2)
    return path


def test_run_and_report(spark, bundle):
    assert engine.verify_bundle(spark, bundle).count() == 0
    text = engine.report(spark, bundle)
    assert "| component.damage | target_sensitive | no | exact_match:target_sensitive |" in text
    assert "| component.neutral | low_observed_sensitivity | yes |  |" in text
    assert text.splitlines()[:2] == ["| Component | Classification | Eligible | Reasons |", "| --- | --- | --- | --- |"] and len(text.splitlines()) == 4
    assert [(r.component_id, r.outcome) for r in spark.read.parquet(f"{bundle}/outcome").collect()] == [("component.neutral", "pass")]
    assert [r.rule for r in engine.verify_bundle(spark, bundle, {"other": 1}).collect()] == ["rule"]


def test_report_text_is_escaped(spark):
    ranking = spark.createDataFrame([('a|b"c\n', "x", True, ["r|1", "r2"]), ("b", "y", False, [])], "component_id string, classification string, eligible boolean, reasons array<string>")
    lines = [r.text for r in engine.report_lines(ranking).orderBy("line").collect()]
    assert lines[2:] == ['| a\\|b\\"c\\n | x | yes | r\\|1, r2 |', "| b | y | no |  |"]


@pytest.mark.parametrize("table,change,rule", [
    ("aggregates", lambda d: d.withColumn("value", F.col("value") + 1e-6), "aggregates"),
    ("damage", lambda d: d.withColumn("absolute_damage", F.col("absolute_damage") + 1e-6), "damage"),
    ("ranking", lambda d: d.withColumn("eligible", F.lit(True)), "ranking"),
    ("plan", lambda d: d.withColumn("ordinal", 9 - F.col("ordinal")), "plan"),
    ("plan", lambda d: d.filter("id <> 'control.no-op'"), "plan"),
    ("configuration", lambda d: d.withColumn("value", F.when(F.col("name") == "seed", "5").otherwise(F.col("value"))), "marker"),
    ("measurements", lambda d: d.withColumn("mean", F.col("mean") + 1e-6), "measurements"),
    ("outcome", lambda d: d.withColumn("outcome", F.lit("fail")), "outcome"),
    ("report", lambda d: d.withColumn("text", F.replace("text", F.lit("yes"), F.lit("no"))), "report"),
    ("markers", lambda d: d.withColumn("payload_sha256", F.reverse("payload_sha256")), "marker"),
    ("metrics", lambda d: d.withColumn("role", F.lit("collateral")), "marker"),
    ("observations", lambda d: d.filter("NOT (cond = 'baseline.end' AND repetition = 1)"), "repetitions"),
    ("observations", lambda d: d.filter("cond <> 'scan.component.damage'"), "plan_coverage"),
    ("observations", lambda d: d.unionByName(d.limit(1)), "observation_identity"),
])
def test_a_changed_table_breaks_its_rule_and_the_manifest(spark, bundle, tmp_path, table, change, rule):
    import shutil

    copy = str(tmp_path / "bundle")
    shutil.copytree(bundle, copy)
    shutil.copytree(f"{bundle}.manifest", f"{copy}.manifest")
    shutil.rmtree(f"{copy}/{table}")
    change(spark.read.parquet(f"{bundle}/{table}")).write.parquet(f"{copy}/{table}")
    rules = {r.rule for r in engine.verify_bundle(spark, copy).select("rule").distinct().collect()}
    assert rule in rules and {"artifact_missing", "artifact_unbound"} <= rules
    with pytest.raises(InvalidEvidence):
        engine.report(spark, copy)


def test_freeze_records(spark):
    rows = [(f"{k}{i:03}", f"g{i}", k, s) for k, n in PUBLISHED_COUNTS.items() for i in range(n + 2) for s in ("discovery", "validation")]
    records = spark.createDataFrame(rows, "source_id string, group_key string, kind string, split string")
    assert engine.freeze_records(records).count() == 2 * sum(PUBLISHED_COUNTS.values())
    with pytest.raises(InvalidEvidence, match="records_missing"):
        engine.freeze_records(records.filter("source_id < 'simple005'"))


def test_doctor(spark):
    found = engine.doctor(spark)
    assert found["ansi"] and found["utc"] and found["pyarrow"]
