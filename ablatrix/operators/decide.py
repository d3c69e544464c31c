"""Classification of components and validation of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ablatrix.errors import BudgetExceeded, InvalidEvidence
from ablatrix.functions.expressions import exceeds, threshold_for

#: The rule that the published protocol uses.
RULE = {
    "target_absolute_damage_max": 0.05,
    "collateral_absolute_damage_max": 0.10,
    "perplexity_relative_damage_max": 0.10,
    "minimum_drift_margin": 0.025,
}
INCOMPLETE = "(incomplete|baseline_competence_absent|insufficient_distinct_records_or_groups)$"


def require_semantics(version: str) -> str:
    if version not in ("1", "2"):
        raise InvalidEvidence("semantics_version_unsupported", str(version))
    return version


def _say(condition: Column, reason: str) -> Column:
    return F.when(condition, F.concat("metric", F.lit(f":{reason}")))


def _guards() -> list[Column]:
    """What version 2 asks of a baseline; a null number of groups counts as none."""
    no_competence = (F.col("direction") == "higher_is_better") & (F.col("baseline") <= 0)
    few = (F.coalesce("unique_record_count", F.lit(0)) < 2) | (F.coalesce("unique_group_count", F.lit(0)) < 2)
    return [_say(no_competence, "baseline_competence_absent"), _say(few, "insufficient_distinct_records_or_groups")]


def candidate_ranking(matrix: DataFrame, metrics: DataFrame, matched: DataFrame, rule: dict[str, float] = RULE, semantics: str = "2") -> DataFrame:
    """component_id, classification, eligible, reasons (sorted, distinct).

    matrix is damage_matrix() of the scans with drift and the baseline's distinct records and groups; matched is
    matched_controls().  A matched control that is missing or not reproduced taints every component alike: its reasons
    are gathered once and join each component's own.
    """
    require_semantics(semantics)
    margin = rule["minimum_drift_margin"]
    wanted = matrix.select("component_id").distinct().crossJoin(F.broadcast(metrics))  # one row a metric of the protocol
    rows = wanted.join(matrix.drop("role", "direction"), ["component_id", "metric"], "left")
    damage, drift = F.col("absolute_damage"), F.coalesce("drift", F.lit(float("inf")))
    incomplete = damage.isNull() | (F.coalesce("error_count", F.lit(0)) > 0) | (F.coalesce("complete_count", F.lit(0)) < 1)
    over = ~incomplete & exceeds(damage, threshold_for(F.col("direction"), F.col("role"), rule))
    unstable = (F.col("complete_count") < 2) | (F.coalesce(F.col("maximum") - F.col("minimum"), F.lit(float("inf"))) > margin)
    complete = [
        *(_guards() if semantics == "2" else []),
        _say(over & (F.col("role") == "target"), "target_sensitive"),
        _say(over & (F.col("role") == "collateral"), "collateral_sensitive"),
        _say(drift > margin, "control_drift"),
        _say(unstable, "unstable_or_single_observation"),
    ]
    own = F.when(incomplete, F.array(F.concat("metric", F.lit(":incomplete")))).otherwise(F.array_compact(F.array(*complete)))
    by_component = rows.groupBy("component_id").agg(
        F.flatten(F.collect_list(own)).alias("own"),
        F.max(over & (F.col("role") == "target")).alias("target"),
        F.max(over & (F.col("role") == "collateral")).alias("collateral"),
    )
    gate = matched.agg(
        F.when(F.count("*") == 0, F.array(F.lit("matched_random_control:missing"))).otherwise(F.collect_set("reason")).alias("gate")
    )
    judged = by_component.crossJoin(F.broadcast(gate))  # one row
    reasons = F.array_sort(F.array_distinct(F.concat("own", "gate")))
    label = (
        F.when(F.col("target") & F.col("collateral"), "broadly_sensitive")
        .when(F.col("target"), "target_sensitive")
        .when(F.col("collateral"), "collateral_sensitive")
        .when(F.size(reasons) > 0, "inconclusive")
        .otherwise("low_observed_sensitivity")
    )
    return judged.select("component_id", label.alias("classification"), (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def validation_outcome(candidates: DataFrame, matrix: DataFrame, metrics: DataFrame, rule: dict[str, float] = RULE, semantics: str = "2") -> DataFrame:
    """component_id, outcome, reasons of each candidate, from the damage matrix over the validation partition.

    metrics may have a column ordinal: reasons stand in its order, else by metric, and within a metric in the order of
    the rule; they may repeat.
    """
    require_semantics(semantics)
    ordered = metrics if "ordinal" in metrics.columns else metrics.withColumn("ordinal", F.col("metric"))
    wanted = candidates.select("component_id").distinct().crossJoin(F.broadcast(ordered))  # one row a metric of the protocol
    seen = matrix.select("component_id").distinct().withColumn("seen", F.lit(True))
    rows = wanted.join(seen, "component_id", "left").join(matrix.drop("role", "direction"), ["component_id", "metric"], "left")
    damage = F.col("absolute_damage")
    incomplete = damage.isNull() | (F.coalesce("error_count", F.lit(0)) > 0)
    over = exceeds(damage, threshold_for(F.col("direction"), F.col("role"), rule), semantics)
    complete = [*(_guards() if semantics == "2" else []), _say(over, "threshold_exceeded")]
    own = F.when(incomplete, F.array(F.concat("metric", F.lit(":incomplete")))).otherwise(F.array_compact(F.array(*complete)))
    grouped = rows.groupBy("component_id").agg(
        F.max("seen").alias("seen"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", own.alias("r")))), lambda x: x["r"])).alias("found")
    )
    reasons = F.when(F.col("seen").isNull(), F.array(F.lit("validation_missing"))).otherwise(F.col("found"))
    outcome = (
        F.when(F.col("seen").isNull(), "inconclusive").when(F.size("found") == 0, "pass")
        .when(F.exists("found", lambda r: r.rlike(INCOMPLETE)), "inconclusive").otherwise("fail")
    )
    return grouped.select("component_id", outcome.alias("outcome"), reasons.alias("reasons"))


def enforce_budgets(spent: dict[str, float], limits: dict[str, float]) -> None:
    """Raise the first limit, in the limits' order, that is passed."""
    for name, most in limits.items():
        if spent.get(name, 0) > most:
            raise BudgetExceeded(f"{name}_budget_exceeded", f"{spent[name]} > {most}")


def enforce_stop_rules(state: dict[str, bool], known: set[str]) -> None:
    """Refuse unknown rules; raise the first triggered one in order."""
    if unknown := sorted(set(state) - known):
        raise InvalidEvidence("stop_rule_unknown", unknown[0])
    for name in sorted(n for n, on in state.items() if on):
        raise BudgetExceeded("stop_rule_triggered", name)
