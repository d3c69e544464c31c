"""Aggregation of observations.

Tables: obs (one row an observation) and scores (one row an observation and metric), both with the columns cond, split,
example_id, group_id, repetition and status; scores adds metric, value, numerator, denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ablatrix.functions.expressions import close, finite

IDENTITY = ("cond", "component_id", "split", "example_id", "repetition")
MEASURES = ("elapsed_seconds", "memory_observation_bytes", "input_tokens", "output_tokens")


def explode_scores(observations: DataFrame) -> DataFrame:
    """One row for each observation and metric, from the map of scores."""
    rest = [c for c in observations.columns if c not in ("scores", "expected_metric_ids")]
    return observations.select(*rest, F.explode("scores").alias("metric", "score")).select(*rest, "metric", "score.*")


def complete(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == "complete")


def _is_fraction() -> Column:
    return F.count("denominator") == F.count("*")


def _reduced() -> Column:
    return F.when(_is_fraction(), F.sum("numerator") / F.sum("denominator")).otherwise(F.sum("value") / F.count("*"))


def reduce_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratio of sums where every score is a fraction, else the mean of values.  See score_violations() for refusals."""
    return scores.groupBy(*keys).agg(
        _reduced().alias("value"),
        F.when(_is_fraction(), F.sum("numerator")).otherwise(F.sum("value")).alias("numerator"),
        F.when(_is_fraction(), F.sum("denominator")).otherwise(F.count("*")).cast("double").alias("denominator"),
        F.count("*").alias("observations"),
        F.when(_is_fraction(), "ratio_of_sums").otherwise("mean_value").alias("reducer"),
    )


def score_violations(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that reduce_scores() must not reduce: keys and reason."""
    broken = (
        F.when(~finite(F.col("value")), "score_not_finite")
        .when(F.col("numerator").isNull() != F.col("denominator").isNull(), "score_fraction_incomplete")
        .when(F.col("denominator") <= 0, "score_denominator_invalid")
        .when(F.col("numerator").isNotNull() & ~close(F.col("value"), F.try_divide("numerator", "denominator"), 1e-9, 1e-12), "score_fraction_inconsistent")
    )
    mixed = scores.groupBy(*keys).agg(F.count("denominator").alias("fractions"), F.count("*").alias("n"))
    mixed = mixed.filter("fractions > 0 AND fractions < n").select(*keys, F.lit("score_fraction_mixed").alias("reason"))
    return scores.select(*keys, broken.alias("reason")).filter("reason IS NOT NULL").unionByName(mixed).distinct()


def condition_aggregate(obs: DataFrame, scores: DataFrame, semantics: str = "2", keys: Sequence[str] = ("split", "cond")) -> DataFrame:
    """Per condition and metric: the reduced value, counts, and its spread over repetitions.

    Errors are counted over the condition's observations and so are the same for each of its metrics.  Two levels of
    aggregation: by repetition, then over repetitions.  Version 2 adds distinct records and groups (null unless every
    contributing row has a group) and the standard deviation over repetitions; version 1 a normal interval over them.
    """
    keys = list(keys)
    good = complete(scores)
    by_repetition = good.groupBy(*keys, "metric", "repetition").agg(_reduced().alias("v"))
    spread = by_repetition.groupBy(*keys, "metric").agg(
        F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.count("*").alias("repetitions"), F.stddev_samp("v").alias("sd"), F.avg("v").alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct("repetition", "v"))), lambda x: x["v"]).alias("repetition_values"),
    )
    whole = good.groupBy(*keys, "metric").agg(
        _reduced().alias("value"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count("*").alias("complete_count"),
        F.countDistinct("example_id").alias("unique_record_count"),
        F.when((F.count("group_id") == F.count("*")) & (F.count("*") > 0), F.countDistinct("group_id")).alias("unique_group_count"),
    )
    errors = obs.groupBy(*keys).agg(F.count_if(F.col("status") != "complete").alias("error_count"))
    out = whole.join(spread, [*keys, "metric"]).join(errors, keys)
    common = [*keys, "metric", "value", "numerator", "denominator", "complete_count", "error_count", "repetition_values", "minimum", "maximum", "repetitions"]
    if semantics == "1":
        half = F.lit(1.96) * F.sqrt(F.col("sd") * F.col("sd") / F.col("repetitions"))
        return out.select(*common, F.when(F.col("repetitions") > 1, F.col("m") - half).alias("low_95"), F.when(F.col("repetitions") > 1, F.col("m") + half).alias("high_95"))
    return out.select(
        *common, "unique_record_count", "unique_group_count", F.when(F.col("repetitions") > 1, F.col("sd")).alias("repetition_standard_deviation"),
        F.lit(None).cast("double").alias("sample_uncertainty_95"), F.lit("not_estimated_records_not_assumed_independent").alias("sample_uncertainty_status"),
    )


def measurement_summary(obs: DataFrame, keys: Sequence[str] = ("cond",), fields: Sequence[str] = MEASURES) -> DataFrame:
    """Count, mean, least and largest of each measurement over complete rows, nulls left out."""
    wide = complete(obs).select(*keys, *(F.col(f).cast("double").alias(f) for f in fields))
    long = wide.unpivot(list(keys), list(fields), "field", "v")
    return long.groupBy(*keys, "field").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


def suite_aggregate(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A suite's own report by metric: value, sample count (the denominators, or the scores themselves), errors apart."""
    return complete(scores).groupBy(*keys, "metric").agg(
        _reduced().alias("value"), F.when(_is_fraction(), F.sum("denominator")).otherwise(F.count("*")).cast("long").alias("sample_count")
    )


def exact_match_aggregate(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of numerators over sum of denominators; no row where that sum is zero."""
    out = scores.groupBy(*keys).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return out.filter("denominator > 0").withColumn("value", F.col("numerator") / F.col("denominator"))


def counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_per_partition(obs: DataFrame) -> DataFrame:
    return obs.groupBy("split").agg(F.countDistinct("example_id").alias("examples"))


def duplicate_identities(rows: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Keys that several rows share, or of which a part is null."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing)


def incomplete_scores(observations: DataFrame) -> DataFrame:
    """Observations whose scores are not just the expected metrics, whose expectations are empty, or repeat."""
    expected, found = F.array_sort("expected_metric_ids"), F.array_sort(F.map_keys("scores"))
    wrong = F.coalesce((F.size("expected_metric_ids") < 1) | (F.size(F.array_distinct("expected_metric_ids")) != F.size("expected_metric_ids")) | (expected != found), F.lit(True))
    return observations.filter(wrong)


def repeat_consistency(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of the pairs (keys) that repeat: how many, and in how many each of values differs between repeats."""
    by_pair = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.countDistinct(v).alias(v) for v in values))
    return by_pair.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("repeated_pairs"), *(F.count_if(F.col(v) > 1).alias(f"differing_{v}") for v in values)
    )


def unequal_pairs(scores: DataFrame, first: str, second: str, keys: Sequence[str]) -> DataFrame:
    """How many observations score the two metrics differently; a missing score differs from any."""
    wide = scores.filter(F.col("metric").isin(first, second)).groupBy(*keys).agg(
        F.max(F.when(F.col("metric") == first, F.col("value"))).alias("a"), F.max(F.when(F.col("metric") == second, F.col("value"))).alias("b")
    )
    return wide.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("unequal"), F.count("*").alias("pairs"))


def weighted_mean(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean over the records of sampled clusters, each record weighing as often as its cluster was drawn."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"))


def peak_memory(rows: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.greatest(*fields) if len(fields) > 1 else F.col(fields[0])).alias("peak"))


def baseline_gap(scores: DataFrame, first: str = "discovery", second: str = "validation") -> DataFrame:
    """Absolute and relative gap between the two partitions' means, by metric."""
    means = scores.groupBy("metric").agg(F.avg(F.when(F.col("split") == first, F.col("value"))).alias(first), F.avg(F.when(F.col("split") == second, F.col("value"))).alias(second))
    gap = F.abs(F.col(first) - F.col(second))
    return means.select("metric", first, second, gap.alias("absolute_gap"), F.try_divide(gap, F.col(first)).alias("relative_gap"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Decisions by component, operation, outcome and the last part of the reason."""
    reason = F.element_at(F.split("reason", ":"), -1)
    return decisions.groupBy("component_id", "operation", "outcome", reason.alias("reason")).agg(F.count("*").alias("n"))


def first_repetition(rows: DataFrame) -> DataFrame:
    """Each item once: the rows of repetition 0, by which items are grouped."""
    return rows.filter(F.col("repetition") == 0)
