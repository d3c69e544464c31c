"""Entry points: run a campaign into a bundle, verify a bundle, report on it, look at the installation."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix import schemas
from ablatrix.checkpoints import checkpointed
from ablatrix.operators import aggregate, compare, decide, rank, sets, verify
from ablatrix.operators.decide import RULE
from ablatrix.plans import campaign
from ablatrix.plans.run import ExactMatch, Model, Suite, evaluate, measure
from ablatrix.sources import evidence, sinks

KEYS = ["split", "cond"]
TABLES = ("observations", "plan", "metrics", "configuration", "aggregates", "reference", "damage", "ranking", "measurements", "outcome", "report")
MARKERS = "markers"
_AGGREGATE = ["value", "numerator", "denominator", "complete_count", "error_count", "minimum", "maximum", "repetitions", "unique_record_count", "unique_group_count"]
_DAMAGE = ["baseline", "condition", "absolute_damage", "relative_damage"]


def derive(observations: DataFrame, metrics: DataFrame, rule: dict[str, float] = RULE, split: str = "discovery", validation: str = "validation", semantics: str = "2") -> dict[str, DataFrame]:
    """Everything that follows from observations: aggregates, reference, damage, ranking, measurements, validation outcome, report.

    The aggregates have a row a condition and metric and feed all else, so they are checkpointed.
    """
    scores = aggregate.explode_scores(observations)
    found = checkpointed(aggregate.condition_aggregate(observations, scores, semantics, KEYS).select(*KEYS, "metric", *_AGGREGATE))
    def reference_of(part: str) -> tuple[DataFrame, DataFrame]:
        here = found.filter(F.col("split") == part).drop("split")
        reference = compare.baseline_reference(here).join(compare.united_records(scores.filter(F.col("split") == part)), "metric")
        return here, checkpointed(reference.drop("positions"))

    def matrix(of: tuple[DataFrame, DataFrame], prefix: str) -> DataFrame:
        here, reference = of
        rows = here.filter(F.col("cond").startswith(prefix)).withColumn("component_id", F.substring("cond", len(prefix) + 1, 1000))
        return compare.damage_matrix(reference, rows.drop("cond", "unique_record_count", "unique_group_count"), metrics)

    discovered, validated = reference_of(split), reference_of(validation)
    scans = matrix(discovered, "scan.")
    matched = compare.matched_controls(scans, matrix(discovered, "control.random."), metrics, rule["minimum_drift_margin"])
    ranking = checkpointed(decide.candidate_ranking(scans, metrics, matched, rule, semantics))
    outcome = decide.validation_outcome(ranking.filter("eligible"), matrix(validated, "scan."), metrics, rule, semantics)
    return {
        "aggregates": found, "reference": discovered[1], "damage": scans.select("component_id", "metric", *_DAMAGE), "ranking": ranking,
        "measurements": aggregate.measurement_summary(observations, KEYS, ["elapsed_seconds"]), "outcome": outcome, "report": report_lines(ranking),
    }


def report_lines(ranking: DataFrame) -> DataFrame:
    """(line, text) of the report: a Markdown table with a line a component, in the order of their ids."""
    show = lambda c: F.replace(F.regexp_replace(F.to_json(F.struct(c.alias("t"))), r'^\{"t":"|"\}$', ""), F.lit("|"), F.lit("\\|"))
    cells = (show(F.col("component_id")), F.col("classification"), F.when(F.col("eligible"), "yes").otherwise("no"), show(F.array_join("reasons", ", ")))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = rank.numbered(ranking.select("component_id", text.alias("text")), [], ["component_id"], "line")
    head = ranking.sparkSession.createDataFrame([(1, "| Component | Classification | Eligible | Reasons |"), (2, "| --- | --- | --- | --- |")], "line long, text string")
    return head.unionByName(rows.select((F.col("line") + 2).alias("line"), "text"))


def markers_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, payload_sha256): what each table holds, whatever its files."""
    rows = [sinks.payload_digest(df).select(F.lit(name).alias("table"), "payload_sha256") for name, df in tables.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _configuration(spark: SparkSession, components: Sequence[str], seed: int, matched: int, repetitions: int, rule: dict[str, float]) -> DataFrame:
    said = {"components": list(components), "seed": seed, "matched": matched, "repetitions": repetitions, "rule": rule}
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in said.items()], "name string, value string")


def run(
    spark: SparkSession, path: str, records: DataFrame, metrics: DataFrame, components: Sequence[str], load: Callable[[], Model], *, suite: Suite | None = None, seed: int = 0, matched: int = 1,
    repetitions: int = 2, rule: dict[str, float] = RULE,
) -> DataFrame:
    """Measure every task over every record, derive, publish; gives the manifest, which is written last.

    records: id, group_id, split, text, expected.  The observations are written before anything is derived from them, so
    that what is published is what was measured, once.
    """
    plan = campaign.campaign_plan(spark, components, seed, matched=matched)
    measured = evaluate(measure(campaign.observation_grid(plan, records, repetitions), load), suite or ExactMatch())
    observations = measured.select(
        "cond", F.coalesce("component_id", F.lit("baseline")).alias("component_id"), "split", F.col("id").alias("example_id"), "group_id", "repetition", "status", "error_type", "scores",
        "expected_metric_ids", "elapsed_seconds", F.sha2("raw_output", 256).alias("output_sha256"),
    )
    observations = checkpointed(observations)
    verify.enforce(refusals(observations))
    configuration = _configuration(spark, components, seed, matched, repetitions, rule)
    tables = {"observations": observations, "plan": plan, "metrics": metrics, "configuration": configuration} | derive(observations, metrics, rule)
    return sinks.publish_bundle(spark, tables | {MARKERS: markers_of(tables)}, path)


def refusals(observations: DataFrame) -> DataFrame:
    """Observations that can't be aggregated: repeated identities, incomplete scores, scores that don't reduce."""
    twice = aggregate.duplicate_identities(observations)
    key = F.concat_ws("/", "cond", "split", "example_id", "repetition")
    bad = aggregate.score_violations(aggregate.explode_scores(observations), ["cond", "metric"])
    return verify.union_violations(
        verify.violation(twice, "observation_identity", key, F.lit("1"), F.col("n")),
        verify.violation(aggregate.incomplete_scores(aggregate.complete(observations)), "observation_scores", key, F.lit("expected metrics"), F.lit("others")),
        bad.select(F.col("reason").alias("rule"), F.concat_ws("/", "cond", "metric").alias("key"), F.lit("").alias("expected"), F.lit("").alias("actual")),
    )


def verify_bundle(spark: SparkSession, path: str, rule: dict[str, float] | None = None) -> DataFrame:
    """All violations of a bundle: its files against its manifest, its tables against their markers, the plan against the
    configuration, coverage of the plan, and everything that was derived.  A rule that is given must be the recorded one.
    """
    manifest = spark.read.parquet(f"{path}.manifest")
    files = evidence.inventory(spark, path).filter("NOT path LIKE '%.crc' AND NOT path LIKE '%\\_SUCCESS'")
    found = [verify.manifest_difference(manifest, files), verify.unsafe_paths(manifest), evidence.bundle_violations(files)]
    table = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    observations = table["observations"]
    said = {r.name: json.loads(r.value) for r in table["configuration"].collect()}
    found.append(verify.table_difference("marker", spark.read.parquet(f"{path}/{MARKERS}"), markers_of(table), ["table"], ["payload_sha256"]))
    if rule is not None and rule != said["rule"]:
        found.append(spark.createDataFrame([("rule", "configuration", json.dumps(rule, sort_keys=True), json.dumps(said["rule"], sort_keys=True))], "rule string, key string, expected string, actual string"))
    found.append(refusals(observations))
    plan = campaign.campaign_plan(spark, said["components"], said["seed"], matched=said["matched"])
    found.append(verify.table_difference("plan", table["plan"], plan, ["id"], [c for c in plan.columns if c != "id"]))
    planned = sets.difference(plan.select(F.col("id").alias("cond")), observations.select("cond").distinct())
    found.append(verify.violation(planned, "plan_coverage", F.col("cond"), F.lit("planned"), F.col("side")))
    short = observations.groupBy("cond", "split", "example_id").agg(F.countDistinct("repetition").alias("n")).filter(F.col("n") != said["repetitions"])
    found.append(verify.violation(short, "repetitions", F.concat_ws("/", "cond", "split", "example_id"), F.lit(said["repetitions"]), F.col("n")))
    derived = derive(observations, table["metrics"], said["rule"])
    flat = lambda df: df.withColumn("reasons", F.array_join("reasons", ","))
    for name, keys, values, form in (
        ("aggregates", [*KEYS, "metric"], _AGGREGATE, None), ("reference", ["metric"], ["value", "drift", "complete_count"], None), ("damage", ["component_id", "metric"], _DAMAGE, None),
        ("ranking", ["component_id"], ["classification", "eligible", "reasons"], flat), ("measurements", [*KEYS, "field"], ["count", "mean", "minimum", "maximum"], None),
        ("outcome", ["component_id"], ["outcome", "reasons"], flat), ("report", ["line"], ["text"], None),
    ):
        recorded, computed = (t if form is None else form(t) for t in (table[name], derived[name]))
        found.append(verify.table_difference(name, recorded, computed, keys, values))
    return verify.union_violations(*found)


def report(spark: SparkSession, path: str) -> str:
    """The report of a verified bundle."""
    verify.enforce(verify_bundle(spark, path))
    return "\n".join(r.text for r in spark.read.parquet(f"{path}/report").orderBy("line").collect())


def freeze_records(records: DataFrame, counts: dict[str, int] = campaign.PUBLISHED_COUNTS, order: Sequence[str] = ("source_id",)) -> DataFrame:
    """The record plan: refused if a split and kind has too few records."""
    verify.enforce(verify.violation(campaign.record_shortfalls(records, counts), "records_missing", F.concat_ws("/", "split", "kind"), F.lit("more"), F.col("n")))
    return campaign.record_plan(records, counts, order).select(*schemas.RECORD_PLAN.names)


def doctor(spark: SparkSession) -> dict[str, object]:
    """What the library finds here."""
    return {
        "spark": spark.version,
        "ansi": spark.conf.get("spark.sql.ansi.enabled") == "true",
        "utc": spark.conf.get("spark.sql.session.timeZone") == "UTC",
        "checkpoints": spark.conf.get("spark.checkpoint.dir", None),
        **{name: importlib.util.find_spec(name) is not None for name in ("pyarrow", "pandas", "numpy", "yaml")},
    }
