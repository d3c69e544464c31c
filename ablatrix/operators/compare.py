"""Baselines, drift and damage, from condition aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINES = ("baseline.beginning", "baseline.middle", "baseline.end")
NO_OP = "control.no-op"


def baseline_reference(aggregates: DataFrame) -> DataFrame:
    """By metric: the mean of the three baseline positions, their sums and deviation, and the control drift.

    Drift is the largest distance from that mean, of a position or of the no-op control.  Fractions are summed only
    where all positions have them.  The positions' distinct records and groups are united beforehand: see
    united_records().
    """
    is_base = F.col("cond").isin(*BASELINES)
    base = aggregates.filter(is_base | (F.col("cond") == NO_OP)).groupBy("metric").agg(
        F.avg(F.when(is_base, F.col("value"))).alias("value"),
        F.when(F.count(F.when(is_base, F.col("numerator"))) == 3, F.sum(F.when(is_base, F.col("numerator")))).alias("numerator"),
        F.when(F.count(F.when(is_base, F.col("denominator"))) == 3, F.sum(F.when(is_base, F.col("denominator")))).alias("denominator"),
        F.sum(F.when(is_base, F.col("complete_count"))).alias("complete_count"),
        F.sum(F.when(is_base, F.col("error_count"))).alias("error_count"),
        F.min(F.when(is_base, F.col("value"))).alias("minimum"),
        F.max(F.when(is_base, F.col("value"))).alias("maximum"),
        F.stddev_samp(F.when(is_base, F.col("value"))).alias("position_standard_deviation"),
        F.count(F.when(is_base, F.lit(1))).alias("positions"),
        F.max(F.when(~is_base, F.col("value"))).alias("no_op"),
        F.min(F.when(~is_base, F.col("value"))).alias("no_op_low"),
    )
    mean = F.col("value")
    drift = F.greatest(F.col("maximum") - mean, mean - F.col("minimum"), F.abs(F.col("no_op") - mean), F.abs(F.col("no_op_low") - mean))
    return base.withColumn("drift", drift).drop("no_op_low")


def united_records(scores: DataFrame) -> DataFrame:
    """Distinct records and groups over all baseline positions, by metric; groups null where a row has none."""
    rows = scores.filter(F.col("cond").isin(*BASELINES) & (F.col("status") == "complete"))
    return rows.groupBy("metric").agg(
        F.countDistinct("example_id").alias("unique_record_count"), F.when(F.count("group_id") == F.count("*"), F.countDistinct("group_id")).alias("unique_group_count")
    )


def reference_violations(aggregates: DataFrame) -> DataFrame:
    """Metrics without all three positions and the no-op, or with null values there."""
    rows = aggregates.filter(F.col("cond").isin(*BASELINES, NO_OP)).groupBy("metric").agg(F.countDistinct(F.when(F.col("value").isNotNull(), F.col("cond"))).alias("n"))
    return rows.filter("n < 4").select("metric", F.lit("baseline_controls_incomplete").alias("reason"))


def damage(base: Column, condition: Column, direction: Column) -> Column:
    """Loss against the baseline; of a metric that should be low, the relative gain."""
    return F.when(direction == "lower_is_better", F.try_divide(condition - base, base)).otherwise(base - condition)


def relative_damage(base: Column, condition: Column, direction: Column) -> Column:
    """Null where the baseline is zero."""
    return F.when(direction == "lower_is_better", F.try_divide(condition - base, base)).otherwise(F.try_divide(base - condition, F.abs(base)))


def damage_matrix(reference: DataFrame, conditions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every component against the reference in every metric of the protocol.

    conditions: component_id, metric, value, complete_count, error_count, minimum, maximum; reference: metric, value and
    what else decisions need; metrics: metric, role, direction.  Reference and metrics are one row a metric and joined
    by it; whether any pair is missing is for damage_violations().
    """
    base = reference.select("metric", F.col("value").alias("baseline"), *(F.col(c) for c in ("drift", "unique_record_count", "unique_group_count") if c in reference.columns))
    rows = conditions.join(metrics, "metric").join(base, "metric")
    b, c, d = F.col("baseline"), F.col("value"), F.col("direction")
    return rows.withColumn("absolute_damage", damage(b, c, d)).withColumn("relative_damage", relative_damage(b, c, d)).withColumnRenamed("value", "condition")


def damage_violations(reference: DataFrame, conditions: DataFrame, metrics: DataFrame) -> DataFrame:
    """component_id, metric, reason: a protocol metric absent on either side, or a low-is-good baseline that isn't positive."""
    wanted = conditions.select("component_id").distinct().crossJoin(F.broadcast(metrics))  # metrics: one row a metric of the protocol
    base = reference.select("metric", F.col("value").alias("baseline"))
    found = wanted.join(conditions.select("component_id", "metric", "value"), ["component_id", "metric"], "left").join(base, "metric", "left")
    reason = F.when(F.col("value").isNull() | F.col("baseline").isNull(), "damage_metric_missing").when(
        (F.col("direction") == "lower_is_better") & (F.col("baseline") <= 0), "lower_is_better_baseline_not_positive"
    )
    return found.select("component_id", "metric", reason.alias("reason")).filter("reason IS NOT NULL")


def matched_controls(scan: DataFrame, random: DataFrame, metrics: DataFrame, margin: float) -> DataFrame:
    """Each randomly repeated component against its scan, by metric: damages, and a reason where they don't agree."""
    components = random.select("component_id").distinct()
    known = scan.select("component_id").distinct().withColumn("known", F.lit(True))
    wanted = components.join(known, "component_id", "left").crossJoin(F.broadcast(metrics.select("metric")))  # one row a metric
    a = scan.select("component_id", "metric", F.col("absolute_damage").alias("scan_damage"))
    b = random.select("component_id", "metric", F.col("absolute_damage").alias("random_damage"))
    both = wanted.join(a, ["component_id", "metric"], "left").join(b, ["component_id", "metric"], "left")
    reason = (
        F.when(F.col("known").isNull(), "matched_random_control:component_missing")
        .when(F.col("scan_damage").isNull() | F.col("random_damage").isNull(), F.concat("metric", F.lit(":matched_control_missing")))
        .when(F.abs(F.col("scan_damage") - F.col("random_damage")) > margin, F.concat("metric", F.lit(":matched_control_not_reproduced")))
    )
    return both.select("component_id", "metric", "scan_damage", "random_damage", reason.alias("reason"))


def drift_stops(reference: DataFrame, margin: float) -> DataFrame:
    """Metrics whose drift forbids a ranking."""
    return reference.filter(F.col("drift") > margin).select("metric", "drift")


def paired_items(rows: DataFrame, baseline: Column, intervention: Column, item: str, keys: list[str], base_keys: list[str], value: str) -> DataFrame:
    """Item by item, the baseline's mean less the intervention's: keys, item, baseline, intervention, paired_damage."""
    base = rows.filter(baseline).groupBy(*base_keys, item).agg(F.avg(value).alias("baseline_score"))
    other = rows.filter(intervention).groupBy(*keys, item).agg(F.avg(value).alias("intervention_score"))
    return other.join(base, [*base_keys, item]).select(*keys, item, "baseline_score", "intervention_score", (F.col("baseline_score") - F.col("intervention_score")).alias("paired_damage"))


def unpaired_items(rows: DataFrame, baseline: Column, intervention: Column, item: str, keys: list[str]) -> DataFrame:
    """Items under one of the two conditions alone."""
    a, b = rows.filter(baseline).select(*keys, item).distinct(), rows.filter(intervention).select(*keys, item).distinct()
    only = lambda x, y, side: x.join(y, [*keys, item], "left_anti").withColumn("only", F.lit(side))
    return only(a, b, "baseline").unionByName(only(b, a, "intervention"))
