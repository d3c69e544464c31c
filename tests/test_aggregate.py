import pytest
from pyspark.sql import functions as F

from ablatrix.errors import InvalidEvidence
from ablatrix.operators import aggregate, compare, decide

OBS = "cond string, component_id string, split string, example_id string, group_id string, repetition int, status string"
SCORE = OBS + ", metric string, value double, numerator double, denominator long"


def scored(spark, rows):
    """(cond, example, repetition, status, value) as fractions of one; value None: not scored."""
    full = [(c, "x", "d", e, f"g{e}", r, s, "m", v, v, 1 if v is not None else None) for c, e, r, s, v in rows]
    return spark.createDataFrame([x[:7] for x in full], OBS), spark.createDataFrame([x for x in full if x[8] is not None], SCORE)


def test_errors_count_apart_and_ratio_of_sums(spark):
    rows = [("a", "1", 0, "complete", 1.0), ("a", "2", 0, "complete", 0.5), ("a", "3", 0, "error", None)]
    for version in ("1", "2"):
        r = aggregate.condition_aggregate(*scored(spark, rows), version).first()
        assert (r.value, r.numerator, r.denominator, r.complete_count, r.error_count, r.repetition_values) == (0.75, 1.5, 2, 2, 1, [0.75])
    assert r.repetition_standard_deviation is None and r.sample_uncertainty_95 is None


def test_repetitions_are_not_records(spark):
    rows = [("a", e, r, "complete", 1.0) for e in "12" for r in range(20)]
    r = aggregate.condition_aggregate(*scored(spark, rows)).first()
    assert (r.complete_count, r.unique_record_count, r.unique_group_count, r.repetition_standard_deviation, r.repetitions) == (40, 2, 2, 0.0, 20)


def test_version_one_interval(spark):
    rows = [("a", "1", 0, "complete", 0.0), ("a", "1", 1, "complete", 1.0)]
    r = aggregate.condition_aggregate(*scored(spark, rows), "1").first()
    assert r.low_95 == pytest.approx(0.5 - 1.96 * 0.5) and r.high_95 == pytest.approx(0.5 + 1.96 * 0.5)


def test_missing_group_leaves_groups_unknown(spark):
    obs, scores = scored(spark, [("a", "1", 0, "complete", 1.0), ("a", "2", 0, "complete", 1.0)])
    scores = scores.withColumn("group_id", F.when(F.col("example_id") == "1", F.col("group_id")))
    assert aggregate.condition_aggregate(obs, scores).first().unique_group_count is None


def test_mean_where_there_are_no_fractions(spark):
    scores = scored(spark, [("a", "1", 0, "complete", 2.0), ("a", "2", 0, "complete", 4.0)])[1].withColumns({"numerator": F.lit(None).cast("double"), "denominator": F.lit(None).cast("long")})
    r = aggregate.reduce_scores(scores, ["metric"]).first()
    assert (r.value, r.numerator, r.denominator, r.reducer) == (3.0, 6.0, 2.0, "mean_value")


@pytest.mark.parametrize("value,numerator,denominator,reason", [
    (float("nan"), 1.0, 1, "score_not_finite"), (1.0, 1.0, None, "score_fraction_incomplete"), (1.0, 1.0, 0, "score_denominator_invalid"), (0.4, 1.0, 2, "score_fraction_inconsistent"),
])
def test_scores_that_are_refused(spark, value, numerator, denominator, reason):
    rows = spark.createDataFrame([("m", value, numerator, denominator)], "metric string, value double, numerator double, denominator long")
    assert [r.reason for r in aggregate.score_violations(rows, ["metric"]).collect()] == [reason]


def test_mixed_fractions_are_refused(spark):
    rows = spark.createDataFrame([("m", 1.0, 1.0, 1), ("m", 1.0, None, None)], "metric string, value double, numerator double, denominator long")
    assert [r.reason for r in aggregate.score_violations(rows, ["metric"]).collect()] == ["score_fraction_mixed"]


def test_duplicates_and_incomplete_scores(spark):
    obs = scored(spark, [("a", "1", 0, "complete", 1.0)] * 2 + [("b", "1", 0, "complete", 1.0)])[0]
    assert [r.n for r in aggregate.duplicate_identities(obs).collect()] == [2]
    rows = spark.createDataFrame([(["a"], {"a": 1.0}), (["a", "b"], {"a": 1.0}), ([], {}), (["a", "a"], {"a": 1.0})], "expected_metric_ids array<string>, scores map<string,double>")
    assert aggregate.incomplete_scores(rows).count() == 3


def reference(spark, values, no_op):
    rows = [(c, "m", v, v * 10, 10, 10, 0) for c, v in zip((*compare.BASELINES, compare.NO_OP), (*values, no_op))]
    return spark.createDataFrame(rows, "cond string, metric string, value double, numerator double, denominator long, complete_count long, error_count long")


def test_reference_is_the_mean_and_drift_includes_the_no_op(spark):
    r = compare.baseline_reference(reference(spark, (0.90, 0.88, 0.86), 0.91)).first()
    assert r.value == pytest.approx(0.88) and r.drift == pytest.approx(0.03) and r.position_standard_deviation == pytest.approx(0.02) and r.complete_count == 30


def test_reference_needs_every_position(spark):
    assert compare.reference_violations(reference(spark, (0.9, 0.9, 0.9), 0.9)).count() == 0
    assert compare.reference_violations(reference(spark, (0.9, 0.9, 0.9), 0.9).filter("cond <> 'baseline.middle'")).count() == 1


METRICS = "metric string, role string, direction string"


def judged(spark, values, *, base=0.9, matched=(), drift=0.0, spread=0.0, groups=2, errors=0, semantics="2", direction="higher_is_better", role="target", validate=False):
    metrics = spark.createDataFrame([("m", role, direction)], METRICS)
    ref = spark.createDataFrame([("m", base, drift, 2, groups)], "metric string, value double, drift double, unique_record_count long, unique_group_count long")
    conditions = spark.createDataFrame([(c, "m", v, 4, errors, v, v + spread) for c, v in values.items()], "component_id string, metric string, value double, complete_count long, error_count long, minimum double, maximum double")
    matrix = compare.damage_matrix(ref, conditions, metrics)
    if validate:
        return {r.component_id: r for r in decide.validation_outcome(conditions.select("component_id"), matrix, metrics, semantics=semantics).collect()}
    gate = spark.createDataFrame([(c, "m", s, r, None) for c, s, r in matched], "component_id string, metric string, scan_damage double, random_damage double, reason string")
    random = gate.select("component_id", "metric", F.col("random_damage").alias("absolute_damage"))
    found = compare.matched_controls(matrix, random, metrics, 0.025)
    return {r.component_id: r for r in decide.candidate_ranking(matrix, metrics, found, semantics=semantics).collect()}


def test_good_and_bad_components(spark):
    out = judged(spark, {"good": 0.9, "bad": 0.5}, matched=[("good", 0.0, 0.0)])
    assert out["good"].eligible and out["good"].classification == "low_observed_sensitivity" and out["good"].reasons == []
    assert not out["bad"].eligible and out["bad"].classification == "target_sensitive" and out["bad"].reasons == ["m:target_sensitive"]


def test_missing_controls_leave_everything_inconclusive(spark):
    r = judged(spark, {"good": 0.9})["good"]
    assert (r.classification, r.eligible, r.reasons) == ("inconclusive", False, ["matched_random_control:missing"])


def test_one_bad_control_taints_all(spark):
    out = judged(spark, {"a": 0.9, "b": 0.9}, matched=[("a", 0.0, 0.0), ("b", 0.0, 0.2)])
    assert [out[c].reasons for c in "ab"] == [["m:matched_control_not_reproduced"]] * 2
    assert judged(spark, {"a": 0.9}, matched=[("z", 0.0, 0.0)])["a"].reasons == ["matched_random_control:component_missing"]


@pytest.mark.parametrize("base,value,passes", [(0.05, 0.0, True), (1.0, 0.95, True), (0.05 + 2e-9, 0.0, False)])
def test_threshold_forgives_rounding(spark, base, value, passes):
    assert judged(spark, {"c": value}, base=base, matched=[("c", 0.0, base - value)])["c"].eligible == passes
    assert judged(spark, {"c": value}, base=base, validate=True)["c"].outcome == ("pass" if passes else "fail")


def test_version_one_validation_is_strict(spark):
    assert judged(spark, {"c": 0.95}, base=1.0, validate=True, semantics="1")["c"].outcome == "fail"


@pytest.mark.parametrize("options,reason", [
    ({"drift": 0.03}, "m:control_drift"), ({"spread": 0.03}, "m:unstable_or_single_observation"), ({"groups": 1}, "m:insufficient_distinct_records_or_groups"),
    ({"groups": None}, "m:insufficient_distinct_records_or_groups"), ({"errors": 1}, "m:incomplete"),
])
def test_reasons(spark, options, reason):
    r = judged(spark, {"c": 0.9}, matched=[("c", 0.0, 0.0)], **options)["c"]
    assert r.reasons == [reason] and r.classification == "inconclusive"


def test_no_competence(spark):
    assert "m:baseline_competence_absent" in judged(spark, {"c": 0.0}, base=0.0, matched=[("c", 0.0, 0.0)])["c"].reasons
    assert judged(spark, {"c": 0.0}, base=0.0, validate=True)["c"].outcome == "inconclusive"


def test_lower_is_better_is_relative(spark):
    out = judged(spark, {"c": 11.5}, base=10.0, direction="lower_is_better", role="collateral", matched=[("c", 0.15, 0.15)])
    assert out["c"].classification == "collateral_sensitive"


def test_damage_violations(spark):
    metrics = spark.createDataFrame([("m", "target", "higher_is_better"), ("p", "collateral", "lower_is_better")], METRICS)
    ref = spark.createDataFrame([("p", 0.0)], "metric string, value double")
    conditions = spark.createDataFrame([("c", "p", 1.0)], "component_id string, metric string, value double")
    found = {(r.metric, r.reason) for r in compare.damage_violations(ref, conditions, metrics).collect()}
    assert found == {("m", "damage_metric_missing"), ("p", "lower_is_better_baseline_not_positive")}


def test_unknown_semantics_are_refused():
    with pytest.raises(InvalidEvidence):
        decide.require_semantics("3")


def test_budgets_and_stop_rules():
    from ablatrix.errors import BudgetExceeded

    decide.enforce_budgets({"wall": 1}, {"wall": 2})
    with pytest.raises(BudgetExceeded, match="disk"):
        decide.enforce_budgets({"wall": 3, "disk": 3}, {"disk": 2, "wall": 2})
    with pytest.raises(BudgetExceeded, match="a"):
        decide.enforce_stop_rules({"b": True, "a": True}, {"a", "b"})
    with pytest.raises(InvalidEvidence):
        decide.enforce_stop_rules({"z": False}, {"a"})
