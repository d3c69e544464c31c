"""The library's operators bound to general tables: each query takes (spark, sf_dir) and returns a DataFrame.

Numbers are rounded to six decimals for comparison across engines, after every decision has been taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.checkpoints import checkpointed
from ablatrix.functions.expressions import material
from ablatrix.functions import scoring
from ablatrix.functions.scoring import exact_prefix, json_keys_in_order, tagged_calls, text_match
from ablatrix.operators import aggregate, compare, decide, estimate, rank, resample, sets, trace, verify
from ablatrix.operators.decide import RULE
from ablatrix.plans import campaign
from ablatrix.plans.run import synthetic_scan as run_synthetic_scan
from ablatrix.sources import datasets, views
from ablatrix.sources.views import cells, metric_dim, obs, obs_scores, table
from ablatrix.streaming.resume import pending_tasks, retries

DRAWS, ITEMS, DOCS = 200, 20, 5
#: Draws of the reference's own bootstrap, which no SQL can repeat.
PUBLISHED_DRAWS = 10_000
GRID = ["model", "target", "layer"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _scores(spark: SparkSession, sf: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    rows = obs(spark, sf)
    rows = rows if split is None else rows.filter(F.col("split") == split)
    return rows, obs_scores(rows)


def _aggregates(spark: SparkSession, sf: str, split: str, semantics: str = "2") -> DataFrame:
    return aggregate.condition_aggregate(*_scores(spark, sf, split), semantics, ["cond"])


def _campaign(spark: SparkSession, sf: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Aggregates by condition and the baseline reference: a row a metric, read often from here on, so checkpointed."""
    found = checkpointed(_aggregates(spark, sf, split))
    return found, checkpointed(compare.baseline_reference(found).join(compare.united_records(_scores(spark, sf, split)[1]), "metric"))


def _matrix(spark: SparkSession, campaign: tuple[DataFrame, DataFrame], prefix: str = "scan.") -> DataFrame:
    found, reference = campaign
    conditions = found.filter(F.col("cond").startswith(prefix)).drop("unique_record_count", "unique_group_count")
    conditions = conditions.withColumn("component_id", F.substring("cond", len(prefix) + 1, 100)).drop("cond")
    return compare.damage_matrix(reference, conditions, metric_dim(spark))


# aggregation and comparison


def score_reduction(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate.reduce_scores(aggregate.complete(_scores(spark, sf)[1]), ["cond", "metric"])
    return rounded(out, "value", "numerator", "denominator")


def condition_aggregate_v2(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate.condition_aggregate(*_scores(spark, sf))
    return rounded(out, "value", "numerator", "minimum", "maximum", "repetition_standard_deviation").drop("repetition_values", "sample_uncertainty_95", "sample_uncertainty_status")


def condition_aggregate_v1(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate.condition_aggregate(*_scores(spark, sf), "1")
    return rounded(out, "value", "low_95", "high_95").select("split", "cond", "metric", "value", "repetitions", "low_95", "high_95")


def measurement_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregate.measurement_summary(obs(spark, sf)), "mean", "minimum", "maximum")


def suite_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregate.suite_aggregate(_scores(spark, sf)[1]), "value")


def condition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.counts(obs(spark, sf), ["cond", "status"])


def distinct_per_partition(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.distinct_per_partition(obs(spark, sf))


def baseline_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = aggregate.complete(_scores(spark, sf)[1]).filter(F.col("cond") == "baseline.beginning")
    return rounded(aggregate.baseline_gap(rows), "discovery", "validation", "absolute_gap", "relative_gap")


def peak_memory(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.peak_memory(obs(spark, sf), ["memory_observation_bytes", "input_tokens"], ["cond"])


def score_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with planted faults, so that each reason occurs."""
    e = F.col("event_id")
    rows = obs_scores(obs(spark, sf)).withColumns({
        "value": F.when(e % 101 == 0, F.lit(float("nan"))).when(e % 103 == 0, F.col("value") + 1).otherwise(F.col("value")),
        "denominator": F.when(e % 107 == 0, F.lit(0).cast("long")).otherwise(F.col("denominator")),
    })
    return aggregate.score_violations(rows, ["cond", "metric"])


def baseline_reference_drift(spark: SparkSession, sf: str) -> DataFrame:
    out = compare.baseline_reference(_aggregates(spark, sf, "discovery"))
    columns = ("value", "minimum", "maximum", "position_standard_deviation", "no_op", "drift")
    return rounded(out, *columns, "numerator").drop("positions")


def damage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = _matrix(spark, _campaign(spark, sf, "discovery")).select("component_id", "metric", "role", "baseline", "condition", "absolute_damage", "relative_damage")
    return rounded(out, "baseline", "condition", "absolute_damage", "relative_damage")


def _matched(spark: SparkSession, found: tuple[DataFrame, DataFrame]) -> DataFrame:
    return compare.matched_controls(_matrix(spark, found), _matrix(spark, found, "control.random."), metric_dim(spark), RULE["minimum_drift_margin"])


def matched_control_check(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_matched(spark, _campaign(spark, sf, "discovery")), "scan_damage", "random_damage")


def control_drift_stops(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare.drift_stops(compare.baseline_reference(_aggregates(spark, sf, "discovery")), RULE["minimum_drift_margin"]), "drift")


def _ranking(spark: SparkSession, sf: str) -> DataFrame:
    found = _campaign(spark, sf, "discovery")
    return decide.candidate_ranking(_matrix(spark, found), metric_dim(spark), _matched(spark, found))


def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _ranking(spark, sf).withColumn("reasons", F.array_join("reasons", ","))


def validation_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Every scanned component and one that never ran; the partition lacks one of them."""
    matrix = _matrix(spark, _campaign(spark, sf, "validation"))
    candidates = _matrix(spark, _campaign(spark, sf, "discovery")).select("component_id").union(spark.createDataFrame([("block.z",)], "component_id string"))
    out = decide.validation_outcome(candidates, matrix.filter("component_id <> 'block.b'"), metric_dim(spark))
    return out.withColumn("reasons", F.array_join("reasons", ","))


def decision_counters(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranking(spark, sf)
    outcome = F.when(F.col("eligible"), "accepted").otherwise("rejected")
    told = F.when(F.size("reasons") == 0, F.array(F.lit("observed_sensitivity_within_limits"))).otherwise(F.col("reasons"))
    return aggregate.decision_counts(ranked.select("component_id", F.lit("classify_candidate").alias("operation"), outcome.alias("outcome"), F.explode(told).alias("reason")))


# keys, sets and coverage


def duplicate_identity(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.duplicate_identities(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def repeat_consistency(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).withColumn("score", (F.col("value") <= 60).cast("int"))
    return aggregate.repeat_consistency(rows, ["cond", "split", "example_id"], ["score", "value"])


def unequal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.unequal_pairs(_scores(spark, sf)[1], "tool_selection", "full_call", ["event_id"])


def plan_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).filter("split = 'discovery'")
    plan = rows.select("cond", "example_id").distinct()
    return verify.plan_coverage(plan, 2, rows.filter("repetition < 3"), ["cond", "example_id"])


def first_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("kind"), F.when(F.col("doc_id") % 2 == 0, "discovery").otherwise("validation").alias("split"))
    counts = {"en": 20, "de": 10, "fr": 10, "es": 5}
    return campaign.record_plan(rows, counts, ["doc_id"]).select("split", "kind", "doc_id", F.col("ordinal").cast("long").alias("ordinal"))


def record_shortfalls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("lang").alias("kind"), (F.col("doc_id") % 50).alias("split"))
    return campaign.record_shortfalls(rows, {"en": 12, "de": 4, "fr": 4, "es": 3})


def partition_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.sha2("text", 256).alias("record"), (F.col("doc_id") % 2).alias("split"))
    return sets.overlap(rows, "record", "split")


def required_subset(spark: SparkSession, sf: str) -> DataFrame:
    return sets.not_members(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


def union_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).groupBy("split", "cond").agg(F.collect_set("group_id").alias("ids"))
    out = sets.union_of_ids(rows, ["split"], "ids")
    return out.select("split", F.array_join(F.col("ids").cast("array<string>"), ";").alias("ids"))


# the item grid


def _scored_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).unpivot(["model", "layer", "item", "doc", "arm"], list(views.TARGETS), "target", "y")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """model, target, layer, item, baseline_score, intervention_score, paired_damage."""
    rows = _scored_cells(spark, sf)
    return compare.paired_items(rows, F.col("arm") == "N", F.col("arm") == "R", "item", GRID, ["model", "target"], "y")


def _damages(items: DataFrame) -> DataFrame:
    return items.groupBy(*GRID).agg(F.avg("paired_damage").alias("damage"), F.avg("baseline_score").alias("base"), F.max("intervention_score").alias("best"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """model, layer, doc, and mean price under either arm, the baseline's over all layers."""
    rows = cells(spark, sf)
    base = rows.filter("arm = 'N'").groupBy("model", "doc").agg(F.avg("ppl").alias("base_ppl"))
    return rows.filter("arm = 'R'").groupBy("model", "layer", "doc").agg(F.avg("ppl").alias("ppl")).join(base, ["model", "doc"])


def _proxies(by_layer: DataFrame) -> DataFrame:
    """spec and x from a ratio: its logarithm, and its excess over one."""
    specs = F.array(F.struct(F.lit("log").alias("spec"), F.log("ratio").alias("x")), F.struct(F.lit("relative").alias("spec"), (F.col("ratio") - 1).alias("x")))
    return by_layer.withColumn("p", F.explode(specs)).drop("ratio").select("*", "p.*").drop("p")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """model, target, layer, spec, x, y (damage), base, best."""
    return _grid_points(_items(spark, sf), _documents(spark, sf))


FIT = ["model", "target", "spec"]


def paired_item_damage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_items(spark, sf), "baseline_score", "intervention_score", "paired_damage")


def unpaired_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = cells(spark, sf).filter("layer < 40 OR item < 10")
    return compare.unpaired_items(rows, (F.col("arm") == "N") & (F.col("layer") < 45), F.col("arm") == "R", "item", ["model", "layer"])


def average_tie_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(_damages(_items(spark, sf)), "damage").select(*GRID, "damage")
    return rank.average_rank(rows, ["model", "target"], "damage", descending=True)


def tolerance_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(_damages(_items(spark, sf)), "damage").select(*GRID, "damage")
    return rank.average_rank_within(rows, ["model", "target"], "damage", 1e-9)


def topk_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(_damages(_items(spark, sf)), "damage").select(*GRID, "damage")
    return rank.top_k_with_ties(rows, ["model", "target"], "damage", 5)


def top_residuals(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(estimate.ols_points(_points(spark, sf), FIT), "residual").select(*FIT, "layer", "residual")
    return rank.top_k(rows, "residual", [*FIT, "layer"], 5)


def equal_damage_layers(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(_damages(_items(spark, sf)), "damage").select(*GRID, "damage")
    return rank.equal_within(rows, ["model", "target"], "damage", 1e-9)


def damage_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _damages(_items(spark, sf))
    return rows.select(*GRID, (F.col("best") == 0).alias("complete_failure"), (F.col("base") == 1).alias("baseline_at_ceiling"), material(F.col("damage"), 0.02).alias("material"))


def centred_proxy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _points(spark, sf).filter("target = 'y1'").select("model", "spec", "layer", "x")
    return rounded(rank.centred(rows, ["model", "spec"], "x"), "x", "centred")


def ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.ols(_points(spark, sf), FIT), "intercept", "slope", "r2")


def ols_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.ols_points(_points(spark, sf), FIT).select(*FIT, "layer", "fitted", "residual"), "fitted", "residual")


def leverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.ols_points(_points(spark, sf), FIT).select(*FIT, "layer", "leverage"), "leverage")


def loo_residual(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.ols_points(_points(spark, sf), FIT).select(*FIT, "layer", "loo_residual"), "loo_residual")


def fit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimate.fit_summary(_points(spark, sf), FIT, "base"), "max_leverage")


def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = checkpointed(_points(spark, sf).filter("spec = 'log'"))
    return rounded(estimate.isotonic(rows, ["model", "target"]).select(*GRID, "fitted", "isotonic_residual"), "fitted", "isotonic_residual")


def spearman_proxy(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(_points(spark, sf), "x", "y")
    return rounded(estimate.spearman(rows, FIT, "y", "x"), "rho")


def spearman_cross_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(estimate.ols_points(_points(spark, sf), FIT), "residual")
    return rounded(estimate.rank_correlation_across(rows, ["target", "spec"], "layer", "model", "F", "O", "residual"), "rho")


def metric_pair_rank_corr(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(_damages(_items(spark, sf)), "damage").select(*GRID, "damage")
    pairs = [("y1", "y2"), ("y1", "y3"), ("y2", "y3")]
    sides = F.array(*(F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.lit(side).alias("side"), F.lit(t).alias("t")) for a, b in pairs for side, t in (("first", a), ("second", b))))
    wide = rows.withColumn("p", F.explode(sides)).filter("p.t = target").select("model", "p.pair", "p.side", "layer", "damage")
    out = wide.groupBy("model", "pair", "layer").agg(F.max(F.when(F.col("side") == "first", F.col("damage"))).alias("a"), F.max(F.when(F.col("side") == "second", F.col("damage"))).alias("b"))
    return rounded(estimate.spearman(out, ["model", "pair"], "a", "b"), "rho")


def material_sets_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(estimate.ols_points(_points(spark, sf), FIT), "residual")
    return rounded(estimate.material_sets(rows, ["target", "spec"], "layer", "model", "F", "O", F.col("residual") >= 0.02), "jaccard")


# resampling, with draws that SQL can repeat


def _sql_draws(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Draws of items and of documents.  Their numbers cycle, so few draws differ and intervals are too narrow."""
    return resample.congruential(spark, DRAWS, ITEMS, ITEMS), resample.congruential(spark, DRAWS, DOCS, DOCS, shift=7)


def _drawn_damages(items: DataFrame, draws: DataFrame) -> DataFrame:
    return resample.resampled_mean(items, draws, GRID, "item", "paired_damage").withColumnRenamed("paired_damage", "damage")


def _damage_ci(items: DataFrame, draws: DataFrame) -> DataFrame:
    return rounded(resample.interval(_drawn_damages(items, draws), GRID, "damage"), "median", "low", "high")


def _rank_ci(items: DataFrame, draws: DataFrame) -> DataFrame:
    drawn = checkpointed(rounded(_drawn_damages(items, draws), "damage"))
    out = resample.rank_intervals(drawn, ["model", "target"], "layer", "damage")
    return rounded(out, "median", "low", "high", "top_fraction")


def bootstrap_damage_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _damage_ci(_items(spark, sf), _sql_draws(spark)[0])


def bootstrap_rank_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _rank_ci(_items(spark, sf), _sql_draws(spark)[0])


def _grid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items and documents, both reduced to the grid's cells, for queries that resample them and fit them too."""
    return checkpointed(_items(spark, sf)), checkpointed(_documents(spark, sf))


def _grid_points(items: DataFrame, documents: DataFrame) -> DataFrame:
    ratio = documents.groupBy("model", "layer").agg((F.avg("ppl") / F.avg("base_ppl")).alias("ratio"))
    return _damages(items).withColumnRenamed("damage", "y").join(_proxies(ratio), ["model", "layer"])


def _drawn_points(items: DataFrame, documents: DataFrame, draws: tuple[DataFrame, DataFrame]) -> DataFrame:
    drawn, docs = draws
    met = documents.join(docs.withColumnRenamed("item", "doc"), "doc")
    ratio = met.groupBy("draw", "model", "layer").agg((F.sum(F.col("ppl") * F.col("times")) / F.sum(F.col("base_ppl") * F.col("times"))).alias("ratio"))
    return _drawn_damages(items, drawn).withColumnRenamed("damage", "y").join(_proxies(ratio), ["draw", "model", "layer"])


def _band(items: DataFrame, documents: DataFrame, draws: tuple[DataFrame, DataFrame]) -> DataFrame:
    boot = resample.ols_by_draw(_drawn_points(items, documents, draws), FIT, "x", "y")
    return resample.simultaneous_band(boot, estimate.ols_points(_grid_points(items, documents), FIT), [*FIT, "layer"], "residual")


def simultaneous_band(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_band(*_grid(spark, sf), _sql_draws(spark)), "point", "se", "critical", "low", "high")


def split_half_rho(spark: SparkSession, sf: str) -> DataFrame:
    """Groups are items, permuted in each draw by a congruential number."""
    grid = spark.range(DRAWS * ITEMS).select((F.col("id") / ITEMS).cast("long").alias("draw"), (F.col("id") % ITEMS).alias("item"))
    number = (F.lit(1103515245).cast("long") * (F.col("draw") * 31 + F.col("item")) + 12345) % 2147483648
    orders = rank.average_rank(grid.withColumn("number", number), ["draw"], "number", "place").select("draw", "item", (F.col("place") - 1).cast("long").alias("place"))
    halves = resample.split_half(checkpointed(_items(spark, sf)), orders, ["model", "target"], "item", "layer", "paired_damage", F.lit(ITEMS))
    rho = estimate.spearman(rounded(halves, "left", "right"), ["draw", "model", "target"], "left", "right")
    return rounded(resample.interval(rho, ["model", "target"], "rho"), "median", "low", "high")


def _selection(grid: tuple[DataFrame, DataFrame], draws: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Blocks that stay material under both proxies, without themselves, and monotonically, for each of the targets."""
    least = -0.2
    fits = checkpointed(_grid_points(*grid))
    bands = _band(*grid, draws).groupBy(*GRID).agg(F.min("low").alias("low"))
    points = estimate.ols_points(fits, FIT).groupBy(*GRID).agg(F.min("loo_residual").alias("loo"))
    shape = estimate.isotonic(fits.filter("spec = 'log'"), ["model", "target"]).select(*GRID, "isotonic_residual")
    chosen = bands.join(points, GRID).join(shape, GRID).filter((F.col("low") > least) & (F.col("loo") >= least / 4) & (F.col("isotonic_residual") >= least / 4))
    return sets.in_all(chosen, ["model", "layer"], "target", len(views.TARGETS))


def robust_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _selection(_grid(spark, sf), _sql_draws(spark))


# the same with the reference's draws


def published_damage_ci(spark: SparkSession, sf: str, draws: int = PUBLISHED_DRAWS) -> DataFrame:
    return _damage_ci(_items(spark, sf), resample.published_bootstrap(spark, draws)[0])


def published_rank_ci(spark: SparkSession, sf: str, draws: int = PUBLISHED_DRAWS) -> DataFrame:
    return _rank_ci(_items(spark, sf), resample.published_bootstrap(spark, draws)[0])


def published_band(spark: SparkSession, sf: str, draws: int = PUBLISHED_DRAWS) -> DataFrame:
    return rounded(_band(*_grid(spark, sf), resample.published_bootstrap(spark, draws)), "point", "se", "critical", "low", "high")


def published_selection(spark: SparkSession, sf: str, draws: int = PUBLISHED_DRAWS) -> DataFrame:
    return _selection(_grid(spark, sf), resample.published_bootstrap(spark, draws))


def published_split_half(spark: SparkSession, sf: str, draws: int = 1000) -> DataFrame:
    """Layers resampled by clusters of records, with the reference's own stream: damage, intervals, rank, share among the largest five."""
    return rounded(_clusters(spark, sf, draws)[0], "damage", "low", "high", "rank_low", "rank_high", "top_fraction")


def published_split_half_rho(spark: SparkSession, sf: str, draws: int = 1000) -> DataFrame:
    return rounded(_clusters(spark, sf, draws)[1], "median", "low", "high")


def _clusters(spark: SparkSession, sf: str, draws: int) -> tuple[DataFrame, DataFrame]:
    """Items are records, of seven groups by their number; every target has the stream from its start, as groups are the same."""
    records = _items(spark, sf).select("model", "target", "layer", (F.col("item") % 7).alias("cluster"), F.col("baseline_score").alias("base"), F.col("intervention_score").alias("value"))
    return resample.split_half_statistics(records, *resample.published_clusters(spark, draws, range(7)), ["model", "target"], "layer", "cluster")


def cluster_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    draws = resample.congruential(spark, 20, 50, 50).withColumnRenamed("item", "group_id")
    rows = aggregate.complete(_scores(spark, sf, "discovery")[1]).filter("cond = 'baseline.beginning'").join(draws, "group_id")
    return rounded(aggregate.weighted_mean(rows, ["draw", "metric"], "value", "times"), "value")


# content, scoring and runs


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("sha256"))


def content_digest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf)


def digest_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest with planted faults against the files as they are."""
    files, n = _manifest(spark, sf), F.substring("path", 5, 20).cast("long")
    listed = files.filter(n % 11 != 3).withColumn("bytes", F.when(n % 13 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    listed = listed.withColumn("sha256", F.when(n % 17 == 0, F.reverse("sha256")).when(n % 19 == 0, "none").otherwise(F.col("sha256")))
    lost = F.substring("path", 5, 20).cast("long") % 23 != 5
    return verify.manifest_difference(listed, files.filter(lost)).select("rule", "key")


def table_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    other = rows.filter(k % 29 != 0).withColumn("c_acctbal", F.col("c_acctbal") * F.when(k % 7 == 0, 1 + 1e-6).otherwise(1 + 1e-12))
    other = other.withColumn("c_mktsegment", F.when(k % 31 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")))
    return verify.merkle_difference("customer", rows, other, ["c_custkey"], ["c_acctbal", "c_mktsegment"]).select("rule", "key")


def tool_call_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    wrapped = F.concat(F.lit("x<tool_call>\n"), "role", F.lit(" </tool_call><tool_call>"), F.col("turn").cast("string"), F.lit("</tool_call>"))
    return rows.select("conv_id", "turn", F.array_join(tagged_calls(F.when(F.col("turn") % 2 == 0, wrapped).otherwise(F.col("role"))), "|").alias("calls"))


def format_prefix_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", exact_prefix(F.coalesce("text", F.lit("")), F.lit("The")).alias("score"))


def json_key_order(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    props = F.when(e % 3 == 0, F.regexp_replace("props", "\\}", ', "j": 1}')).when(e % 5 == 0, F.lit("[1]")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", json_keys_in_order(props, F.array(F.lit("k"))).alias("score"))


def typed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as texts, some with white space around them or a sign before, against two texts or, at times, two numbers."""
    e = F.col("event_id")
    number = (e % 50).cast("string")
    output = F.when(e % 5 == 0, F.concat(F.lit(" \t"), number, F.lit("\n"))).when(e % 5 == 1, F.concat(F.lit("-"), number)).otherwise(number)
    options = F.array((e * 7 % 50).cast("string"), F.lit("7"))
    expected = F.when(e % 11 == 0, F.to_json(options.cast("array<int>"))).otherwise(F.to_json(options))
    return table(spark, sf, "events").select("event_id", scoring.typed_match(output, expected).alias("score"))


def tool_argument_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One call by event, tagged or in a list, with an optional argument, at times one too many, and at times no call at all."""
    e = F.col("event_id")
    unit = F.when(e % 3 != 0, F.when(e % 2 == 0, "C").otherwise("F"))
    arguments = F.struct((e % 5).alias("x"), unit.alias("unit"), F.when(e % 13 == 0, 1).alias("z"))
    call = F.to_json(F.struct(F.when(e % 4 == 3, "g").otherwise("f").alias("name"), arguments.alias("arguments")))
    output = F.when(e % 17 == 0, "no call").when(e % 7 == 0, F.concat(F.lit("<tool_call> "), call, F.lit("</tool_call>"))).otherwise(F.concat(F.lit("["), call, F.lit("]")))
    expected, rules = F.lit('[{"f": {"x": [1, 2.0], "unit": ["C", ""]}}]'), F.lit('{"argument_names": ["x", "unit"], "required": ["x"]}')
    return table(spark, sf, "events").select("event_id", scoring.tool_scores(output, expected, rules).alias("s")).select("event_id", "s.*")


def matched_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of up to two calls against one call or none: each metric over its own population, null outside it."""
    e = F.col("event_id")
    f = F.concat(F.lit('{"name": "f", "arguments": {"x": '), (e % 3).cast("string"), F.lit("}}"))
    g = F.lit('{"name": "g", "arguments": {}}')
    output = F.when(e % 19 == 0, "nonsense").when(e % 4 == 0, "[]").when(e % 4 == 1, F.concat(F.lit("["), f, F.lit("]"))).when(e % 4 == 2, F.concat(F.lit("["), g, F.lit(","), f, F.lit("]"))).otherwise(F.concat(F.lit("["), g, F.lit("]")))
    expected = F.when(e % 5 == 0, "[]").otherwise('[{"name": "f", "arguments": {"x": 1}}]')
    found = table(spark, sf, "events").select("event_id", scoring.matched_call_scores(output, expected).alias("s"))
    return found.select("event_id", "s.status", *(F.try_element_at("s.scores", F.lit(m))["value"].alias(m) for m in ("tool_selection", "full_call", "argument_binding", "abstention")))


def abstention_decisions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id") % 8
    output = (
        F.when(e == 1, "  \n").when(e == 2, " No applicable TOOL. ").when(e == 3, " [] ").when(e == 4, '[{"name": "f", "arguments": {}}]').when(e == 5, "No applicable tool. But f.")
        .when(e == 6, F.col("props")).when(e == 7, F.concat(F.lit('<tool_call>{"name": "f", "arguments": '), "props", F.lit("}</tool_call>")))
    )
    return table(spark, sf, "events").select("event_id", scoring.abstention(output).alias("s")).select("event_id", "s.value", "s.reason")


def format_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The four format contracts, each met by some outputs and missed by others."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("json_keys", "ordered_list", "exact_prefix", "case_transform"))), (e % 4 + 1).cast("int"))
    output = (
        F.when(e % 4 == 0, F.when(e % 3 == 0, '{"b": 1, "a": 2}').otherwise('{"a": 1, "b": 2}'))
        .when(e % 4 == 1, F.concat(F.lit("1. a\n2. "), F.when(e % 3 == 0, "b").when(e % 3 == 1, "b\n").otherwise("a")))
        .otherwise(F.concat(F.upper("event_type"), F.when(e % 3 == 0, "\n").otherwise("")))
    )
    value = F.when(e % 4 == 2, F.upper(F.substring("event_type", 1, 2))).otherwise(F.upper("event_type"))
    return table(spark, sf, "events").select("event_id", kind.alias("kind"), scoring.format_score(output, kind, value, F.array(F.lit("a"), F.lit("b"))).alias("score"))


def exact_match_score(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items against documents dealt to them by number."""
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("item_id"), F.col("lang"), F.coalesce("text", F.lit("")).alias("output"))
    rows = docs.join(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("expected")), "item_id")
    value = text_match(F.when(F.length("output") % 5 == 0, F.concat(F.lit(" \n"), "expected", F.lit("\t"))).otherwise(F.col("output")), F.col("expected"))
    return rounded(aggregate.exact_match_aggregate(rows.select("lang", value.alias("numerator"), F.lit(1).cast("long").alias("denominator")), ["lang"]), "value")


def synthetic_scan(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "documents").select("doc_id", "lang", F.trim(F.coalesce("text", F.lit(""))).alias("text")).withColumn("expected", F.col("text"))
    tasks = spark.createDataFrame([("baseline", None), ("scan.component.damage", "component.damage"), ("scan.component.neutral", "component.neutral")], "id string, component_id string")
    found = run_synthetic_scan(records, tasks, ["lang"])
    return rounded(found.groupBy("cond", "lang").agg(F.avg("value").alias("value"), F.count("*").alias("records")), "value")


PROPS = {
    "type": "object", "required": ["k"], "additionalProperties": {"type": "integer"},
    "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 90}, "t": {"type": "string", "maxLength": 5, "pattern": "^[a-z]+$"}, "l": {"type": "array", "items": {"enum": [1, "a"]}, "minItems": 1}},
}


def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties against a schema; some have trailing text, other members, none of their own, or a list added."""
    e, more = F.col("event_id"), lambda text: F.concat(F.expr("left(props, length(props) - 1)"), text, F.lit("}"))
    kind = F.concat(F.lit(', "t": "'), "event_type", F.lit('"'))
    items = F.concat(F.lit(', "l": ['), F.when(e % 2 == 0, F.concat((e % 3).cast("string"), F.lit(', "a"'))).otherwise(""), F.lit("]"))
    text = F.when(e % 7 == 0, F.concat("props", F.lit(" x"))).when(e % 7 == 1, more(F.lit(', "j": 1.5'))).when(e % 7 == 2, F.regexp_replace("props", '"k"', '"m"')).when(e % 7 == 3, more(kind)).when(e % 7 == 4, more(items)).otherwise(F.col("props"))
    return datasets.schema_violations(table(spark, sf, "events"), e, text, PROPS).select("rule", "key", F.col("actual").alias("path"))


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records, of fifty groups, each in one split."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.cast("string").alias("id"), F.concat(F.lit("g"), d % 50).alias("group_id"), F.coalesce("lang", F.lit("none")).alias("kind"), F.when(d % 50 < 25, "discovery").otherwise("validation").alias("split"), "doc_id"
    )


def frozen_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Records against their plan, some lost, some of another kind, some twice, some in another split or in one that is no role."""
    plan, d = _roles(spark, sf), F.col("doc_id")
    records = plan.filter(d % 23 != 5).withColumn("kind", F.when(d % 29 == 3, "other").otherwise(F.col("kind")))
    records = records.withColumn("split", F.when(d % 43 == 1, "holdout").when(d % 41 == 0, "validation").otherwise(F.col("split")))
    records = records.unionByName(records.filter(d % 31 == 7))
    return datasets.membership(records.drop("doc_id"), plan).select("rule", "key")


def plan_identity(spark: SparkSession, sf: str) -> DataFrame:
    """A numbered plan of which some rows were lost, so that places have gaps, and some came in twice."""
    d = F.col("doc_id")
    plan = rank.numbered(_roles(spark, sf).withColumn("split", F.when(d % 41 == 0, "validation").otherwise(F.col("split"))), ["split", "kind"], ["doc_id"])
    plan = plan.filter("NOT (kind = 'en' AND doc_id % 37 = 2)")
    return datasets.plan_identity(plan.unionByName(plan.filter("kind = 'de' AND doc_id % 31 = 7"))).select("rule", "key")


def observation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).withColumn("score", (F.col("value") <= 60).cast("int"))
    return verify.observation_gaps(rows, ["cond", "split"], "example_id", ["score"]).select("rule", "key")


def numbered_events(spark: SparkSession, sf: str) -> DataFrame:
    return rank.numbered(table(spark, sf, "events"), ["event_type"], ["value", "event_id"], "place").select("event_type", "event_id", "place")


def cycle_members(spark: SparkSession, sf: str) -> DataFrame:
    """Turns under the turn before; in some conversations the first one is under a later one, so that turns go round."""
    c, t = F.col("conv_id"), F.col("turn")
    above = F.when(t > 0, t - 1).when(c % 11 == 0, F.lit(1)).when(c % 13 == 0, F.lit(3))
    rows = table(spark, sf, "conversations").filter("NOT (conv_id % 7 = 0 AND turn = 1)").select(F.concat_ws("/", c, t).alias("node"), F.when(above.isNotNull(), F.concat_ws("/", c, above)).alias("above"))
    return trace.on_cycles(rows, "node", "above")


def uncommitted_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks, a user and kind of event each, that completed and have no committed span."""
    rows = table(spark, sf, "events").withColumn("task", F.concat_ws("/", "user_id", "event_type"))
    return trace.uncommitted(rows, rows.filter("event_id % 3 = 0"), "task")


def resume_pending_tasks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    plan, done = rows.select("user_id").distinct(), rows.filter("event_type = 'purchase'").select("user_id").distinct()
    return trace.uncommitted(plan, done, "user_id")


def pending_after_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Users as tasks; some of their purchases are commit markers, some of these of an older configuration."""
    rows = table(spark, sf, "events")
    plan = rows.select(F.col("user_id").alias("id")).distinct()
    digest = F.when(F.col("event_id") % 3 == 0, "old").otherwise("now")
    markers = rows.filter("event_type = 'purchase' AND event_id % 5 = 0").select(F.col("user_id").alias("task"), digest.alias("configuration_sha256"), F.lit("v1").alias("compatibility_sha256"))
    return pending_tasks(plan, markers, "now", "v1")


def first_repetitions(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.first_repetition(obs(spark, sf)).select("cond", "split", "example_id", "group_id", "event_id")


def headline_check(spark: SparkSession, sf: str) -> DataFrame:
    """Mean balances by segment, of which one was recorded wrongly, one isn't found any more, and one never was recorded."""
    found = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("headline")).agg(F.avg("c_acctbal").alias("value"))
    recorded = found.withColumn("value", F.col("value") + F.when(F.col("headline") == "BUILDING", 0.001).otherwise(0.0001)).withColumn("tolerance", F.lit(0.0005))
    recorded = recorded.filter("headline <> 'MACHINERY'")
    return verify.headlines(recorded, found.filter("headline <> 'FURNITURE'")).select("rule", "key")


def paper_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """R2, cross-model correlation, split-half median and sets of material layers against recorded ones, some of them wrong.

    A number was recorded to as many digits as its tolerance allows; y2's R2 is off, y3's median was never recorded, and of
    each model's sets layer 7 was lost and layer 99 added.
    """
    name = lambda kind, *parts: F.concat_ws("/", F.lit(kind), *parts)
    r2 = ols_fit(spark, sf).filter("spec = 'log'").select(name("r2", "model", "target").alias("headline"), F.col("r2").alias("value"), F.lit(0.00005).alias("tolerance"), "target")
    rho = spearman_cross_model(spark, sf).filter("spec = 'log'").select(name("rho", "target").alias("headline"), F.col("rho").alias("value"), F.lit(0.0005).alias("tolerance"), "target")
    half = split_half_rho(spark, sf).select(name("half", "model", "target").alias("headline"), F.col("median").alias("value"), F.lit(1e-12).alias("tolerance"), "target")
    found = checkpointed(r2.unionByName(rho).unionByName(half))
    kind = F.substring_index("headline", "/", 1)
    said = F.when(kind == "r2", F.round("value", 4)).when(kind == "rho", F.round("value", 3)).otherwise(F.col("value")) + F.when((kind == "r2") & (F.col("target") == "y2"), 0.001).otherwise(0.0)
    recorded = found.filter(~((kind == "half") & (F.col("target") == "y3"))).withColumn("value", said)
    sets_found = damage_flags(spark, sf).filter("material").select(name("set", "model", "target").alias("headline"), F.col("layer").cast("long").alias("member"))
    sets_recorded = sets_found.filter("member <> 7").unionByName(sets_found.select("headline").distinct().withColumn("member", F.lit(99).cast("long")))
    return verify.union_violations(verify.headlines(recorded, found), verify.headline_sets(sets_recorded, sets_found)).select("rule", "key")


def band_from_draws(spark: SparkSession, sf: str) -> DataFrame:
    """A stored band against its draws: some ends moved, one standard error lost, some draws' deviations altered."""
    items, documents = _grid(spark, sf)
    boot = checkpointed(resample.ols_by_draw(_drawn_points(items, documents, _sql_draws(spark)), FIT, "x", "y"))
    point = checkpointed(estimate.ols_points(_grid_points(items, documents), FIT))
    cells = [*FIT, "layer"]
    band = resample.simultaneous_band(boot, point, cells, "residual").withColumn("low", F.col("low") + F.when(F.col("layer") % 9 == 0, 1e-6).otherwise(0.0))
    band = band.withColumn("high", F.when(F.col("layer") % 10 != 3, F.col("high"))).withColumn("se", F.col("se") * F.when((F.col("layer") == 5) & (F.col("spec") == "log"), 1.001).otherwise(1.0)).drop("point")
    deviations = resample.largest_deviations(boot, point, cells, "residual").withColumn("d", F.col("d") + F.when(F.col("draw") % 50 == 7, 0.01).otherwise(0.0))
    return verify.band_reconstruction(boot, point, band, deviations, cells, "residual", tolerance=1e-9).select("rule", "key")


def band_check(spark: SparkSession, sf: str) -> DataFrame:
    """Users' mean values with stored bands, some of whose ends were changed or lost."""
    u = F.col("user_id")
    cells = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("point"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("se")).withColumn("critical", F.lit(3.0))
    low, high = F.col("point") - F.col("critical") * F.col("se"), F.col("point") + F.col("critical") * F.col("se")
    stored = cells.withColumn("low", low + F.when(u % 7 == 0, 1e-6).otherwise(0.0)).withColumn("high", F.when(u % 11 != 0, high))
    return verify.band_violations(stored, ["user_id"], 1e-9).select("rule", "key")


def topology_check(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation is a model, a turn a component under the one before; some lack a turn, go round, repeat or count below zero."""
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf, "conversations").filter("NOT (conv_id % 7 = 0 AND turn = 1)")
    parent = F.when(t > 0, t - 1).when(c % 11 == 0, F.lit(1))
    rows = rows.select("conv_id", "turn", parent.cast("long").alias("above"), F.when((c % 17 == 0) & (t == 0), -1).otherwise(t).alias("place"))
    rows = rows.unionByName(rows.filter("conv_id % 13 = 0 AND turn = 2"))
    return trace.topology_violations(rows, "conv_id", "turn", "above", "place")


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).filter("status = 'error'").select(F.col("cond").alias("task"), "event_id", "example_id")
    return rank.numbered(rows, ["task"], ["event_id"], "attempt")


def latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return rank.latest(_failures(spark, sf), ["task"], "attempt")


def retry_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return retries(_failures(spark, sf))


# traces: a conversation is a trace, its turns are spans under the turn before


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("span"), F.when(F.col("turn") > 0, F.concat_ws("/", "conv_id", F.col("turn") - 1)).alias("parent"), "conv_id", "turn", "role")
    return c


def trace_parent_graph(spark: SparkSession, sf: str) -> DataFrame:
    return trace.reach_roots(_spans(spark, sf), "span", "parent").withColumn("depth", F.col("depth").cast("long"))


def trace_graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spans(spark, sf).filter("NOT (conv_id % 7 = 0 AND turn = 1)").filter("NOT (conv_id % 11 = 0 AND turn = 0)")
    again = rows.filter("conv_id % 13 = 0 AND turn = 2")
    return trace.graph_violations(rows.unionByName(again), "conv_id", "span", "parent")


def event_counter_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Events by user and type against counters that miss a few."""
    rows = table(spark, sf, "events")
    points = rows.filter("event_id % 41 <> 0").groupBy("user_id", "event_type").agg(F.count("*").alias("value"))
    return trace.counter_equality(rows, points, ["user_id", "event_type"])


def record_span_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "role")
    seen = rows.filter("conv_id % 5 <> 0").unionByName(rows.filter("conv_id % 9 = 0"))
    return trace.record_coverage(seen, rows, ["conv_id", "role"])


def hook_balance(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "removed").when(F.col("event_type") == "signup", "failed").when(F.col("event_type") == "error", "cleanup_failed")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("segment"), kinds.alias("kind"), F.lit(1).cast("long").alias("value")).filter("kind IS NOT NULL")
    return trace.hook_balance(rows, "segment")


QUERIES = {
    f.__name__: f
    for f in (
        damage_matrix, score_reduction, condition_aggregate_v2, condition_aggregate_v1, measurement_summary, suite_report, condition_counts, distinct_per_partition, baseline_gap,
        peak_memory, score_violations, baseline_reference_drift, matched_control_check, control_drift_stops, candidate_ranking, validation_outcome, decision_counters,
        duplicate_identity, repeat_consistency, unequal_pairs, plan_coverage, first_n_per_group, record_shortfalls, partition_disjointness, required_subset, union_of_ids,
        paired_item_damage, unpaired_items, average_tie_rank, tolerance_rank, topk_with_ties, top_residuals, equal_damage_layers, damage_flags, centred_proxy,
        ols_fit, ols_residuals, leverage, loo_residual, fit_summary, isotonic_fit, spearman_proxy, spearman_cross_model, metric_pair_rank_corr, material_sets_jaccard,
        bootstrap_damage_ci, bootstrap_rank_ci, simultaneous_band, split_half_rho, robust_selection, cluster_weighted_mean,
        content_digest_manifest, digest_mismatch, table_difference, tool_call_extract, format_prefix_score, json_key_order, exact_match_score, synthetic_scan,
        typed_answers, tool_argument_scores, matched_calls, abstention_decisions, format_scores, pending_after_commit, first_repetitions, headline_check, paper_headlines, band_check, band_from_draws, topology_check,
        resume_pending_tasks, schema_violations, frozen_roles, plan_identity, observation_gaps, numbered_events, cycle_members, uncommitted_tasks, latest_attempt, retry_accounting, trace_parent_graph, trace_graph_violations, event_counter_equality, record_span_coverage, hook_balance,
    )
}

#: Without SQL: the draws come from NumPy's generator.
PUBLISHED = {f.__name__: f for f in (published_damage_ci, published_rank_ci, published_band, published_selection, published_split_half, published_split_half_rho)}
