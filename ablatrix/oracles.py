"""DuckDB SQL for the rows of each query in queries.py, written against the tables and not against the Spark code."""

OBS = """obs AS (
  SELECT *, row_number() OVER (PARTITION BY cond, split, example_id ORDER BY event_id) - 1 AS repetition FROM (
    SELECT CASE event_type WHEN 'view' THEN 'baseline.' || ['beginning', 'middle', 'end'][event_id % 3 + 1] WHEN 'signup' THEN 'control.no-op' WHEN 'click' THEN 'scan.block.a'
             WHEN 'error' THEN 'scan.block.b' ELSE CASE WHEN event_id % 4 = 0 THEN 'control.random.block.c' ELSE 'scan.block.c' END END AS cond,
           user_id AS example_id, user_id % 50 AS group_id, CASE WHEN user_id % 2 = 0 THEN 'discovery' ELSE 'validation' END AS split, event_id, value,
           CASE WHEN event_id % 97 = 0 THEN 'error' ELSE 'complete' END AS status, value / 100 AS elapsed_seconds, event_id * 1024 AS memory_observation_bytes,
           (event_id * 7) % 100 AS input_tokens, (event_id * 3) % 50 AS output_tokens
    FROM events)
), scores AS (
  SELECT * EXCLUDE (value), 'tool_selection' AS metric, (value <= 60)::INT::DOUBLE AS value, (value <= 60)::INT::DOUBLE AS numerator, 1 AS denominator FROM obs
  UNION ALL SELECT * EXCLUDE (value), 'full_call', (value <= 30)::INT::DOUBLE, (value <= 30)::INT::DOUBLE, 1 FROM obs
  UNION ALL SELECT * EXCLUDE (value), 'perplexity', value + 1, NULL, NULL FROM obs
), metrics(metric, role, direction) AS (
  VALUES ('tool_selection', 'target', 'higher'), ('full_call', 'target', 'higher'), ('perplexity', 'collateral', 'lower')
)"""

ROLES = """roles AS (
  SELECT doc_id, doc_id::VARCHAR AS id, 'g' || doc_id % 50 AS g, coalesce(lang, 'none') AS kind, CASE WHEN doc_id % 50 < 25 THEN 'discovery' ELSE 'validation' END AS split FROM documents
)"""

REDUCED = "CASE WHEN count(denominator) = count(*) THEN sum(numerator) / sum(denominator) ELSE sum(value) / count(*) END"

AGGREGATE = f"""{OBS}, byrep AS (
  SELECT split, cond, metric, repetition, {REDUCED} AS v FROM scores WHERE status = 'complete' GROUP BY ALL
), spread AS (
  SELECT split, cond, metric, min(v) AS minimum, max(v) AS maximum, count(*) AS repetitions, stddev_samp(v) AS sd, avg(v) AS m FROM byrep GROUP BY ALL
), whole AS (
  SELECT split, cond, metric, {REDUCED} AS value, sum(numerator) AS numerator, sum(denominator)::BIGINT AS denominator, count(*) AS complete_count,
         count(DISTINCT example_id) AS unique_record_count, count(DISTINCT group_id) AS unique_group_count FROM scores WHERE status = 'complete' GROUP BY ALL
), errors AS (SELECT split, cond, count(*) FILTER (status <> 'complete') AS error_count FROM obs GROUP BY ALL),
agg AS (SELECT * FROM whole JOIN spread USING (split, cond, metric) JOIN errors USING (split, cond))"""

MATRIX = f"""{AGGREGATE}, united AS (
  SELECT split, metric, count(DISTINCT example_id) AS records, count(DISTINCT group_id) AS groups FROM scores WHERE status = 'complete' AND cond LIKE 'baseline.%' GROUP BY ALL
), ref AS (
  SELECT split, metric, avg(value) FILTER (cond LIKE 'baseline.%') AS baseline, max(value) FILTER (cond = 'control.no-op') AS no_op,
         min(value) FILTER (cond LIKE 'baseline.%') AS lo, max(value) FILTER (cond LIKE 'baseline.%') AS hi FROM agg GROUP BY ALL
), refs AS (SELECT *, greatest(hi - baseline, baseline - lo, abs(no_op - baseline)) AS drift FROM ref JOIN united USING (split, metric)),
matrix AS (
  SELECT a.split, CASE WHEN a.cond LIKE 'scan.%' THEN 'scan' ELSE 'random' END AS kind, regexp_replace(a.cond, '^(scan|control\\.random)\\.', '') AS component_id, a.metric, m.role, m.direction,
         r.baseline, a.value AS condition, a.complete_count, a.error_count, a.minimum, a.maximum, r.drift, r.records, r.groups,
         CASE WHEN m.direction = 'lower' THEN (a.value - r.baseline) / r.baseline ELSE r.baseline - a.value END AS damage,
         CASE WHEN m.direction = 'lower' THEN (a.value - r.baseline) / r.baseline ELSE (r.baseline - a.value) / nullif(abs(r.baseline), 0) END AS relative,
         CASE WHEN m.direction = 'lower' THEN 0.10 WHEN m.role = 'target' THEN 0.05 ELSE 0.10 END AS threshold
  FROM agg a JOIN metrics m USING (metric) JOIN refs r ON r.split = a.split AND r.metric = a.metric WHERE a.cond LIKE 'scan.%' OR a.cond LIKE 'control.random.%'
), matched AS (
  SELECT r.component_id, r.metric, s.damage AS scan_damage, r.damage AS random_damage,
         CASE WHEN abs(s.damage - r.damage) > 0.025 THEN r.metric || ':matched_control_not_reproduced' END AS reason
  FROM matrix r JOIN matrix s ON s.kind = 'scan' AND r.kind = 'random' AND s.component_id = r.component_id AND s.metric = r.metric AND s.split = r.split WHERE r.split = 'discovery'
), own AS (
  SELECT component_id, metric, role, direction, CASE
    WHEN error_count > 0 OR complete_count < 1 THEN [metric || ':incomplete']
    ELSE list_filter([
      CASE WHEN direction = 'higher' AND baseline <= 0 THEN metric || ':baseline_competence_absent' END,
      CASE WHEN records < 2 OR groups < 2 THEN metric || ':insufficient_distinct_records_or_groups' END,
      CASE WHEN damage > threshold + 1e-9 AND role = 'target' THEN metric || ':target_sensitive' END,
      CASE WHEN damage > threshold + 1e-9 AND role = 'collateral' THEN metric || ':collateral_sensitive' END,
      CASE WHEN drift > 0.025 THEN metric || ':control_drift' END,
      CASE WHEN complete_count < 2 OR maximum - minimum > 0.025 THEN metric || ':unstable_or_single_observation' END], lambda x: x IS NOT NULL) END AS reasons,
    error_count = 0 AND damage > threshold + 1e-9 AS over
  FROM matrix WHERE kind = 'scan' AND split = 'discovery'
), gate AS (SELECT list_distinct(list(reason) FILTER (reason IS NOT NULL)) AS g FROM matched), ranked AS (
  SELECT component_id, coalesce(list_sort(list_distinct(list_concat(flatten(list(reasons)), coalesce((SELECT g FROM gate), [])))), []) AS reasons,
         bool_or(over AND role = 'target') AS target, bool_or(over AND role = 'collateral') AS collateral FROM own GROUP BY ALL
)"""

CELLS = """cells AS (
  SELECT l_linestatus AS model, p_size AS layer, l_suppkey % 20 AS item, l_suppkey % 5 AS doc, l_returnflag AS arm, (l_quantity <= 25)::INT::DOUBLE AS y1,
         (l_discount <= 0.05)::INT::DOUBLE AS y2, (l_tax <= 0.04)::INT::DOUBLE AS y3, l_extendedprice AS ppl
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('N', 'R')
), long AS (SELECT model, layer, item, arm, unnest(['y1', 'y2', 'y3']) AS target, unnest([y1, y2, y3]) AS y FROM cells),
itembase AS (SELECT model, target, item, avg(y) AS b FROM long WHERE arm = 'N' GROUP BY ALL),
items AS (
  SELECT l.model, l.target, l.layer, l.item, any_value(b.b) AS baseline_score, avg(l.y) AS intervention_score, any_value(b.b) - avg(l.y) AS paired_damage
  FROM long l JOIN itembase b ON b.model = l.model AND b.target = l.target AND b.item = l.item WHERE l.arm = 'R' GROUP BY l.model, l.target, l.layer, l.item
), damages AS (
  SELECT model, target, layer, avg(paired_damage) AS exact, round(avg(paired_damage), 6) AS damage, avg(baseline_score) AS base, max(intervention_score) AS best FROM items GROUP BY ALL
), docbase AS (SELECT model, doc, avg(ppl) AS base_ppl FROM cells WHERE arm = 'N' GROUP BY ALL),
docs AS (SELECT c.model, c.layer, c.doc, avg(c.ppl) AS ppl, any_value(d.base_ppl) AS base_ppl FROM cells c JOIN docbase d USING (model, doc) WHERE c.arm = 'R' GROUP BY ALL),
ratios AS (SELECT model, layer, avg(ppl) / avg(base_ppl) AS ratio FROM docs GROUP BY ALL),
points AS (
  SELECT d.model, d.target, s.spec, d.layer, CASE s.spec WHEN 'log' THEN ln(r.ratio) ELSE r.ratio - 1 END AS x, d.exact AS y, d.base
  FROM damages d JOIN ratios r USING (model, layer), (VALUES ('log'), ('relative')) AS s(spec)
), fits AS (SELECT model, target, spec, count(*) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM points GROUP BY ALL),
fitted AS (
  SELECT p.*, f.a + f.b * p.x AS fitted, p.y - (f.a + f.b * p.x) AS residual, 1.0 / f.n + (p.x - f.mx) ** 2 / f.sxx AS leverage FROM points p JOIN fits f USING (model, target, spec)
)"""

DRAWS = f"""{CELLS}, draws AS (
  SELECT draw, ((1103515245 * (draw * 31 + slot) + 12345) % 2147483648) % 20 AS item FROM range(200) AS a(draw), range(20) AS b(slot)
), drawn AS (SELECT d.draw, i.model, i.target, i.layer, avg(i.paired_damage) AS damage FROM draws d JOIN items i USING (item) GROUP BY ALL)"""

BAND = f"""{DRAWS}, docdraws AS (
  SELECT draw, ((1103515245 * (draw * 31 + slot + 7) + 12345) % 2147483648) % 5 AS doc FROM range(200) AS a(draw), range(5) AS b(slot)
), drawnratio AS (SELECT w.draw, d.model, d.layer, sum(d.ppl) / sum(d.base_ppl) AS ratio FROM docdraws w JOIN docs d USING (doc) GROUP BY ALL),
drawnpoints AS (
  SELECT d.draw, d.model, d.target, s.spec, d.layer, d.damage AS y, CASE s.spec WHEN 'log' THEN ln(r.ratio) ELSE r.ratio - 1 END AS x
  FROM drawn d JOIN drawnratio r USING (draw, model, layer), (VALUES ('log'), ('relative')) AS s(spec)
), drawnfits AS (SELECT draw, model, target, spec, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM drawnpoints GROUP BY ALL),
boot AS (SELECT p.draw, p.model, p.target, p.spec, p.layer, p.y - f.a - f.b * p.x AS residual FROM drawnpoints p JOIN drawnfits f USING (draw, model, target, spec)),
ses AS (SELECT model, target, spec, layer, stddev_samp(residual) AS se FROM boot GROUP BY ALL),
crit AS (
  SELECT quantile_cont(d, 0.95) AS critical FROM (
    SELECT b.draw, max(abs(b.residual - f.residual) / s.se) AS d FROM boot b JOIN fitted f USING (model, target, spec, layer) JOIN ses s USING (model, target, spec, layer) GROUP BY ALL)
), band AS (
  SELECT model, target, spec, layer, residual AS point, se, critical, residual - critical * se AS low, residual + critical * se AS high FROM fitted JOIN ses USING (model, target, spec, layer), crit
)"""

ISOTONIC = """iso AS (
  SELECT p.model, p.target, p.layer, p.x, p.y, max(m.v) AS fitted FROM (SELECT * FROM points WHERE spec = 'log') p JOIN (
    SELECT a.model, a.target, a.x AS ax, i.x AS ix, min(a.v) AS v FROM (
      SELECT a.model, a.target, a.x, b.x AS bx, avg(c.y) AS v FROM points a JOIN points b ON b.model = a.model AND b.target = a.target AND b.spec = 'log' AND b.x >= a.x
      JOIN points c ON c.model = a.model AND c.target = a.target AND c.spec = 'log' AND c.x BETWEEN a.x AND b.x WHERE a.spec = 'log' GROUP BY ALL) a
    JOIN points i ON i.model = a.model AND i.target = a.target AND i.spec = 'log' AND i.x >= a.x AND a.bx >= i.x GROUP BY ALL) m
  ON m.model = p.model AND m.target = p.target AND m.ix = p.x AND m.ax <= p.x GROUP BY ALL
)"""

MANIFEST = "files AS (SELECT 'doc/' || doc_id AS path, doc_id AS n, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents)"
FAILURES = f"{OBS}, failures AS (SELECT cond AS task, event_id, example_id, row_number() OVER (PARTITION BY cond ORDER BY event_id) AS attempt FROM obs WHERE status = 'error')"
SPANS = "spans AS (SELECT conv_id || '/' || turn AS span, CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent, conv_id, turn, role FROM conversations)"


def _rank(value: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0)"


ORACLES = {
    "damage_matrix": f"""WITH {MATRIX} SELECT component_id, metric, role, round(baseline, 6) AS baseline, round(condition, 6) AS condition, round(damage, 6) AS absolute_damage,
        round(relative, 6) AS relative_damage FROM matrix WHERE kind = 'scan' AND split = 'discovery'""",
    "score_reduction": f"""WITH {OBS} SELECT cond, metric, round({REDUCED}, 6) AS value, round(CASE WHEN count(denominator) = count(*) THEN sum(numerator) ELSE sum(value) END, 6) AS numerator,
        round(CASE WHEN count(denominator) = count(*) THEN sum(denominator) ELSE count(*) END::DOUBLE, 6) AS denominator, count(*) AS observations,
        CASE WHEN count(denominator) = count(*) THEN 'ratio_of_sums' ELSE 'mean_value' END AS reducer FROM scores WHERE status = 'complete' GROUP BY cond, metric""",
    "condition_aggregate_v2": f"""WITH {AGGREGATE} SELECT split, cond, metric, round(value, 6) AS value, round(numerator, 6) AS numerator, denominator, complete_count, error_count,
        round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, repetitions, unique_record_count, unique_group_count, CASE WHEN repetitions > 1 THEN round(sd, 6) END AS repetition_standard_deviation FROM agg""",
    "condition_aggregate_v1": f"""WITH {AGGREGATE} SELECT split, cond, metric, round(value, 6) AS value, repetitions, CASE WHEN repetitions > 1 THEN round(m - 1.96 * sqrt(sd * sd / repetitions), 6) END AS low_95,
        CASE WHEN repetitions > 1 THEN round(m + 1.96 * sqrt(sd * sd / repetitions), 6) END AS high_95 FROM agg""",
    "measurement_summary": f"""WITH {OBS}, long AS (SELECT cond, unnest(['elapsed_seconds', 'memory_observation_bytes', 'input_tokens', 'output_tokens']) AS field,
        unnest([elapsed_seconds, memory_observation_bytes::DOUBLE, input_tokens::DOUBLE, output_tokens::DOUBLE]) AS v FROM obs WHERE status = 'complete')
        SELECT cond, field, count(v) AS count, round(avg(v), 6) AS mean, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM long GROUP BY cond, field""",
    "suite_report": f"""WITH {OBS} SELECT metric, round({REDUCED}, 6) AS value, CASE WHEN count(denominator) = count(*) THEN sum(denominator) ELSE count(*) END::BIGINT AS sample_count
        FROM scores WHERE status = 'complete' GROUP BY metric""",
    "condition_counts": f"WITH {OBS} SELECT cond, status, count(*) AS n FROM obs GROUP BY ALL",
    "distinct_per_partition": f"WITH {OBS} SELECT split, count(DISTINCT example_id) AS examples FROM obs GROUP BY ALL",
    "baseline_gap": f"""WITH {OBS}, m AS (SELECT metric, avg(value) FILTER (split = 'discovery') AS d, avg(value) FILTER (split = 'validation') AS v FROM scores
        WHERE cond = 'baseline.beginning' AND status = 'complete' GROUP BY ALL)
        SELECT metric, round(d, 6) AS discovery, round(v, 6) AS validation, round(abs(d - v), 6) AS absolute_gap, round(abs(d - v) / d, 6) AS relative_gap FROM m""",
    "peak_memory": f"WITH {OBS} SELECT cond, max(greatest(memory_observation_bytes, input_tokens)) AS peak FROM obs GROUP BY ALL",
    "score_violations": f"""WITH {OBS}, bad AS (SELECT cond, metric, event_id, numerator, CASE WHEN event_id % 101 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 103 = 0 THEN value + 1 ELSE value END AS value,
        CASE WHEN event_id % 107 = 0 THEN 0 ELSE denominator END AS denominator FROM scores)
        SELECT DISTINCT cond, metric, reason FROM (SELECT cond, metric, CASE WHEN isnan(value) THEN 'score_not_finite' WHEN (numerator IS NULL) <> (denominator IS NULL) THEN 'score_fraction_incomplete'
          WHEN denominator <= 0 THEN 'score_denominator_invalid' WHEN numerator IS NOT NULL AND abs(value - numerator / denominator) > 1e-9 THEN 'score_fraction_inconsistent' END AS reason FROM bad) WHERE reason IS NOT NULL
        UNION ALL SELECT cond, metric, 'score_fraction_mixed' FROM bad GROUP BY cond, metric HAVING count(denominator) > 0 AND count(denominator) < count(*)""",
    "baseline_reference_drift": f"""WITH {AGGREGATE}, r AS (SELECT metric, avg(value) FILTER (cond LIKE 'baseline.%') AS value, sum(numerator) FILTER (cond LIKE 'baseline.%') AS numerator,
        sum(denominator) FILTER (cond LIKE 'baseline.%')::BIGINT AS denominator, sum(complete_count) FILTER (cond LIKE 'baseline.%')::BIGINT AS complete_count, sum(error_count) FILTER (cond LIKE 'baseline.%')::BIGINT AS error_count,
        min(value) FILTER (cond LIKE 'baseline.%') AS minimum, max(value) FILTER (cond LIKE 'baseline.%') AS maximum, stddev_samp(value) FILTER (cond LIKE 'baseline.%') AS sd,
        max(value) FILTER (cond = 'control.no-op') AS no_op FROM agg WHERE split = 'discovery' GROUP BY metric)
        SELECT metric, round(value, 6) AS value, round(numerator, 6) AS numerator, denominator, complete_count, error_count, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(sd, 6) AS position_standard_deviation,
        round(no_op, 6) AS no_op, round(greatest(maximum - value, value - minimum, abs(no_op - value)), 6) AS drift FROM r""",
    "matched_control_check": f"WITH {MATRIX} SELECT component_id, metric, round(scan_damage, 6) AS scan_damage, round(random_damage, 6) AS random_damage, reason FROM matched",
    "control_drift_stops": f"WITH {MATRIX} SELECT metric, round(drift, 6) AS drift FROM refs WHERE split = 'discovery' AND drift > 0.025",
    "candidate_ranking": f"""WITH {MATRIX} SELECT component_id, CASE WHEN target AND collateral THEN 'broadly_sensitive' WHEN target THEN 'target_sensitive' WHEN collateral THEN 'collateral_sensitive'
        WHEN len(reasons) > 0 THEN 'inconclusive' ELSE 'low_observed_sensitivity' END AS classification, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM ranked""",
    "validation_outcome": f"""WITH {MATRIX}, candidates AS (SELECT DISTINCT component_id FROM matrix WHERE kind = 'scan' AND split = 'discovery' UNION SELECT 'block.z'),
        v AS (SELECT component_id, metric, CASE WHEN error_count > 0 THEN [metric || ':incomplete'] ELSE list_filter([
            CASE WHEN direction = 'higher' AND baseline <= 0 THEN metric || ':baseline_competence_absent' END,
            CASE WHEN records < 2 OR groups < 2 THEN metric || ':insufficient_distinct_records_or_groups' END,
            CASE WHEN damage > threshold + 1e-9 THEN metric || ':threshold_exceeded' END], lambda x: x IS NOT NULL) END AS r
          FROM matrix WHERE kind = 'scan' AND split = 'validation' AND component_id <> 'block.b'),
        g AS (SELECT component_id, flatten(list(r ORDER BY metric)) AS r FROM v GROUP BY ALL)
        SELECT component_id, CASE WHEN r IS NULL THEN 'inconclusive' WHEN len(r) = 0 THEN 'pass' WHEN len(list_filter(r, lambda x: regexp_matches(x, '(incomplete|absent|groups)$'))) > 0 THEN 'inconclusive' ELSE 'fail' END AS outcome,
        CASE WHEN r IS NULL THEN 'validation_missing' ELSE array_to_string(r, ',') END AS reasons FROM candidates LEFT JOIN g USING (component_id)""",
    "decision_counters": f"""WITH {MATRIX}, told AS (SELECT component_id, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END AS outcome,
        unnest(CASE WHEN len(reasons) = 0 THEN ['observed_sensitivity_within_limits'] ELSE reasons END) AS r FROM ranked)
        SELECT component_id, 'classify_candidate' AS operation, outcome, regexp_extract(r, '[^:]*$') AS reason, count(*) AS n FROM told GROUP BY ALL""",
    "duplicate_identity": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL",
    "repeat_consistency": f"""WITH {OBS}, p AS (SELECT count(*) AS n, count(DISTINCT value <= 60) AS s, count(DISTINCT value) AS v FROM obs GROUP BY cond, split, example_id)
        SELECT count(*) AS pairs, count(*) FILTER (n > 1) AS repeated_pairs, count(*) FILTER (s > 1) AS differing_score, count(*) FILTER (v > 1) AS differing_value FROM p""",
    "unequal_pairs": "SELECT count(*) FILTER ((value <= 60) IS DISTINCT FROM (value <= 30)) AS unequal, count(*) AS pairs FROM events",
    "plan_coverage": f"""WITH {OBS}, o AS (SELECT cond, example_id, repetition FROM obs WHERE split = 'discovery' AND repetition < 3),
        e AS (SELECT DISTINCT cond, example_id, r.repetition FROM obs, range(2) AS r(repetition) WHERE split = 'discovery')
        SELECT cond, example_id, repetition::INT AS repetition, side, 1::BIGINT AS rows FROM (
          (SELECT *, 'missing' AS side FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM o)) UNION ALL (SELECT *, 'unexpected' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM e)))""",
    "first_n_per_group": """SELECT split, kind, doc_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY split, kind ORDER BY doc_id) AS ordinal FROM (
        SELECT doc_id, lang AS kind, CASE WHEN doc_id % 2 = 0 THEN 'discovery' ELSE 'validation' END AS split FROM documents))
        WHERE ordinal <= CASE kind WHEN 'en' THEN 20 WHEN 'de' THEN 10 WHEN 'fr' THEN 10 WHEN 'es' THEN 5 ELSE 0 END""",
    "record_shortfalls": """SELECT doc_id % 50 AS split, lang AS kind, count(*) AS n FROM documents GROUP BY ALL
        HAVING count(*) < CASE lang WHEN 'en' THEN 12 WHEN 'de' THEN 4 WHEN 'fr' THEN 4 WHEN 'es' THEN 3 ELSE 0 END""",
    "partition_disjointness": "SELECT sha256(text) AS record, count(DISTINCT doc_id % 2) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 2) > 1",
    "required_subset": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "union_of_ids": f"WITH {OBS} SELECT split, array_to_string(list_sort(list_distinct(list(group_id))), ';') AS ids FROM obs GROUP BY split",
    "paired_item_damage": f"WITH {CELLS} SELECT model, target, layer, item, round(baseline_score, 6) AS baseline_score, round(intervention_score, 6) AS intervention_score, round(paired_damage, 6) AS paired_damage FROM items",
    "unpaired_items": f"""WITH {CELLS}, c AS (SELECT * FROM cells WHERE layer < 40 OR item < 10), a AS (SELECT DISTINCT model, layer, item FROM c WHERE arm = 'N' AND layer < 45), b AS (SELECT DISTINCT model, layer, item FROM c WHERE arm = 'R')
        SELECT *, 'baseline' AS only FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'intervention' FROM (FROM b EXCEPT FROM a)""",
    "average_tie_rank": f"WITH {CELLS} SELECT model, target, layer, damage, {_rank('damage DESC', 'model, target').replace('model, target, damage DESC', 'model, target, damage')} AS rank FROM damages",
    "tolerance_rank": f"WITH {CELLS} SELECT model, target, layer, damage, {_rank('damage', 'model, target')} AS rank FROM damages",
    "topk_with_ties": f"WITH {CELLS} SELECT model, target, layer, damage FROM damages QUALIFY rank() OVER (PARTITION BY model, target ORDER BY damage DESC) <= 5",
    "top_residuals": f"WITH {CELLS} SELECT model, target, spec, layer, round(residual, 6) AS residual FROM fitted ORDER BY round(residual, 6) DESC, model, target, spec, layer LIMIT 5",
    "equal_damage_layers": f"WITH {CELLS} SELECT model, target, layer, damage, count(*) OVER (PARTITION BY model, target, damage) AS equal_rows FROM damages",
    "damage_flags": f"WITH {CELLS} SELECT model, target, layer, best = 0 AS complete_failure, base = 1 AS baseline_at_ceiling, exact >= 0.02 - 1e-12 AS material FROM damages",
    "centred_proxy": f"WITH {CELLS} SELECT model, spec, layer, round(x, 6) AS x, round(x - avg(x) OVER (PARTITION BY model, spec), 6) AS centred FROM points WHERE target = 'y1'",
    "ols_fit": f"WITH {CELLS} SELECT model, target, spec, n, round(a, 6) AS intercept, round(b, 6) AS slope, round(r2, 6) AS r2 FROM fits",
    "ols_residuals": f"WITH {CELLS} SELECT model, target, spec, layer, round(fitted, 6) AS fitted, round(residual, 6) AS residual FROM fitted",
    "leverage": f"WITH {CELLS} SELECT model, target, spec, layer, round(leverage, 6) AS leverage FROM fitted",
    "loo_residual": f"""WITH {CELLS}, refit AS (SELECT p.model, p.target, p.spec, p.layer, regr_intercept(q.y, q.x) AS a, regr_slope(q.y, q.x) AS b
        FROM points p JOIN points q ON q.model = p.model AND q.target = p.target AND q.spec = p.spec AND q.layer <> p.layer GROUP BY ALL)
        SELECT model, target, spec, layer, round(y - a - b * x, 6) AS loo_residual FROM points JOIN refit USING (model, target, spec, layer)""",
    "fit_summary": f"""WITH {CELLS} SELECT model, target, spec, round(max(leverage), 6) AS max_leverage, count(*) FILTER (fitted < base - 1 OR fitted > base) AS predictions_outside_possible_damage_bounds
        FROM fitted GROUP BY ALL""",
    "isotonic_fit": f"WITH {CELLS}, {ISOTONIC} SELECT model, target, layer, round(fitted, 6) AS fitted, round(y - fitted, 6) AS isotonic_residual FROM iso",
    "spearman_proxy": f"""WITH {CELLS}, r AS (SELECT model, target, spec, round(y, 6) AS y, round(x, 6) AS x FROM points), k AS (
        SELECT model, target, spec, {_rank('y', 'model, target, spec')} AS ry, {_rank('x', 'model, target, spec')} AS rx FROM r)
        SELECT model, target, spec, count(*) AS n, round(corr(ry, rx), 6) AS rho FROM k GROUP BY ALL""",
    "spearman_cross_model": f"""WITH {CELLS}, p AS (SELECT a.target, a.spec, round(a.residual, 6) AS u, round(b.residual, 6) AS v FROM fitted a JOIN fitted b ON a.model = 'F' AND b.model = 'O' AND a.target = b.target
        AND a.spec = b.spec AND a.layer = b.layer), k AS (SELECT target, spec, {_rank('u', 'target, spec')} AS ru, {_rank('v', 'target, spec')} AS rv FROM p)
        SELECT target, spec, count(*) AS n, round(corr(ru, rv), 6) AS rho FROM k GROUP BY ALL""",
    "metric_pair_rank_corr": f"""WITH {CELLS}, p AS (SELECT a.model, a.target || ' vs ' || b.target AS pair, a.damage AS u, b.damage AS v FROM damages a JOIN damages b ON a.model = b.model AND a.layer = b.layer AND a.target < b.target),
        k AS (SELECT model, pair, {_rank('u', 'model, pair')} AS ru, {_rank('v', 'model, pair')} AS rv FROM p) SELECT model, pair, count(*) AS n, round(corr(ru, rv), 6) AS rho FROM k GROUP BY ALL""",
    "material_sets_jaccard": f"""WITH {CELLS}, s AS (SELECT target, spec, coalesce(list_sort(list(layer) FILTER (model = 'F' AND round(residual, 6) >= 0.02)), []) AS a,
        coalesce(list_sort(list(layer) FILTER (model = 'O' AND round(residual, 6) >= 0.02)), []) AS b FROM fitted GROUP BY ALL)
        SELECT target, spec, array_to_string(a, ';') AS first_layers, array_to_string(b, ';') AS second_layers, array_to_string(list_sort(list_intersect(a, b)), ';') AS common_layers,
        round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard FROM s""",
    "bootstrap_damage_ci": f"""WITH {DRAWS} SELECT model, target, layer, round(quantile_cont(damage, 0.5), 6) AS median, round(quantile_cont(damage, 0.025), 6) AS low, round(quantile_cont(damage, 0.975), 6) AS high,
        count(*) FILTER (damage IS NULL) AS undefined FROM drawn GROUP BY ALL""",
    "bootstrap_rank_ci": f"""WITH {DRAWS}, d AS (SELECT draw, model, target, layer, round(damage, 6) AS damage FROM drawn), k AS (
        SELECT *, (rank() OVER (PARTITION BY draw, model, target ORDER BY damage DESC) + (count(*) OVER (PARTITION BY draw, model, target, damage) - 1) / 2.0) AS r, rank() OVER (PARTITION BY draw, model, target ORDER BY damage DESC) <= 5 AS top FROM d)
        SELECT model, target, layer, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, round(count(*) FILTER (top) / 200.0, 6) AS top_fraction FROM k GROUP BY ALL""",
    "simultaneous_band": f"WITH {BAND} SELECT model, target, spec, layer, round(point, 6) AS point, round(se, 6) AS se, round(critical, 6) AS critical, round(low, 6) AS low, round(high, 6) AS high FROM band",
    "split_half_rho": f"""WITH {CELLS}, orders AS (SELECT draw, item, row_number() OVER (PARTITION BY draw ORDER BY (1103515245 * (draw * 31 + item) + 12345) % 2147483648) - 1 AS place FROM range(200) AS a(draw), range(20) AS b(item)),
        h AS (SELECT o.draw, i.model, i.target, i.layer, round(avg(paired_damage) FILTER (place < 10), 6) AS u, round(avg(paired_damage) FILTER (place >= 10), 6) AS v FROM orders o JOIN items i USING (item) GROUP BY ALL),
        k AS (SELECT draw, model, target, {_rank('u', 'draw, model, target')} AS ru, {_rank('v', 'draw, model, target')} AS rv FROM h), r AS (SELECT draw, model, target, corr(ru, rv) AS rho FROM k GROUP BY ALL)
        SELECT model, target, round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.025), 6) AS low, round(quantile_cont(rho, 0.975), 6) AS high, count(*) FILTER (rho IS NULL) AS undefined FROM r GROUP BY ALL""",
    "robust_selection": f"""WITH {BAND}, {ISOTONIC}, b AS (SELECT model, target, layer, min(low) AS low FROM band GROUP BY ALL), l AS (SELECT model, target, layer, min(residual / (1 - leverage)) AS loo FROM fitted GROUP BY ALL)
        SELECT model, layer FROM b JOIN l USING (model, target, layer) JOIN iso USING (model, target, layer) WHERE low > -0.2 AND loo >= -0.05 AND y - fitted >= -0.05 GROUP BY ALL HAVING count(DISTINCT target) = 3""",
    "cluster_weighted_mean": f"""WITH {OBS}, draws AS (SELECT draw, ((1103515245 * (draw * 31 + slot) + 12345) % 2147483648) % 50 AS group_id FROM range(20) AS a(draw), range(50) AS b(slot))
        SELECT draw, metric, round(avg(value), 6) AS value FROM scores JOIN draws USING (group_id) WHERE status = 'complete' AND split = 'discovery' AND cond = 'baseline.beginning' GROUP BY ALL""",
    "content_digest_manifest": f"WITH {MANIFEST} SELECT path, bytes, sha256 FROM files",
    "digest_mismatch": f"""WITH {MANIFEST}, listed AS (SELECT path, CASE WHEN n % 13 = 0 THEN bytes + 1 ELSE bytes END AS eb, CASE WHEN n % 17 = 0 THEN reverse(sha256) WHEN n % 19 = 0 THEN 'none' ELSE sha256 END AS es FROM files WHERE n % 11 <> 3),
        here AS (SELECT * FROM files WHERE n % 23 <> 5) SELECT rule, path AS key FROM (SELECT coalesce(listed.path, here.path) AS path, CASE WHEN listed.path IS NULL THEN 'artifact_unbound' WHEN here.path IS NULL THEN 'artifact_missing'
          WHEN NOT regexp_full_match(es, '[0-9a-f]{{64}}') THEN 'digest_malformed' WHEN eb <> bytes THEN 'artifact_size' WHEN es <> sha256 THEN 'artifact_digest' END AS rule
          FROM listed FULL JOIN here ON listed.path = here.path) WHERE rule IS NOT NULL""",
    "table_difference": """WITH o AS (SELECT c_custkey, c_acctbal * CASE WHEN c_custkey % 7 = 0 THEN 1 + 1e-6 ELSE 1 + 1e-12 END AS b, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 29 <> 0),
        j AS (SELECT c.c_custkey AS k, o.c_custkey IS NULL AS lost, abs(c.c_acctbal - o.b) <= greatest(1e-10 * greatest(abs(c.c_acctbal), abs(o.b)), 1e-10) AS same, c.c_mktsegment IS NOT DISTINCT FROM o.m AS segment
          FROM customer c LEFT JOIN o ON o.c_custkey = c.c_custkey)
        SELECT 'customer' AS rule, k || '.c_acctbal' AS key FROM j WHERE lost OR NOT same UNION ALL SELECT 'customer', k || '.c_mktsegment' FROM j WHERE lost OR NOT segment""",
    "tool_call_extract": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN array_to_string(regexp_extract_all('x<tool_call>' || chr(10) || role || ' </tool_call><tool_call>' || turn || '</tool_call>', '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), '|')
        ELSE '' END AS calls FROM conversations""",
    "format_prefix_score": "SELECT conv_id, turn, (starts_with(coalesce(text, ''), 'The') AND NOT contains(coalesce(text, ''), chr(10)))::INT::DOUBLE AS score FROM conversations",
    "json_key_order": """WITH p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN replace(props, '}', ', "j": 1}') WHEN event_id % 5 = 0 THEN '[1]' ELSE props END AS props FROM events)
        SELECT event_id, (json_type(props) = 'OBJECT' AND json_keys(props) = ['k'])::INT::DOUBLE AS score FROM p""",
    "typed_answers": """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN chr(9) || event_id % 50 || chr(10) WHEN 1 THEN '-' || event_id % 50 ELSE (event_id % 50)::VARCHAR END AS o FROM events)
        SELECT event_id, (event_id % 11 <> 0 AND regexp_replace(o, '^\\s+|\\s+$', '', 'g') IN ((event_id * 7 % 50)::VARCHAR, '7'))::INT::DOUBLE AS score FROM r""",
    "tool_argument_scores": """WITH r AS (SELECT event_id AS e, event_id, event_id % 17 <> 0 AS called FROM events), s AS (
        SELECT event_id, called AND e % 4 <> 3 AS named, called AND e % 13 <> 0 AND e % 5 IN (1, 2) AND (e % 3 = 0 OR e % 2 = 0) AS bound FROM r)
        SELECT event_id, named::INT::DOUBLE AS tool_selection, bound::INT::DOUBLE AS argument_binding, (named AND bound)::INT::DOUBLE AS full_call FROM s""",
    "matched_calls": """WITH r AS (SELECT event_id, event_id % 19 = 0 AS bad, event_id % 5 = 0 AS nothing, event_id % 4 AS k, event_id % 3 = 1 AS same FROM events)
        SELECT event_id, CASE WHEN bad THEN 'error' ELSE 'complete' END AS status,
          CASE WHEN NOT bad AND NOT nothing THEN (k = 1)::INT::DOUBLE END AS tool_selection, CASE WHEN NOT bad AND NOT nothing THEN (k = 1 AND same)::INT::DOUBLE END AS full_call,
          CASE WHEN NOT bad AND NOT nothing AND k IN (1, 2) THEN same::INT::DOUBLE END AS argument_binding, CASE WHEN NOT bad AND nothing THEN (k = 0)::INT::DOUBLE END AS abstention FROM r""",
    "abstention_decisions": """SELECT event_id, CASE WHEN event_id % 8 IN (2, 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS value, 'abstention_' || CASE event_id % 8 WHEN 0 THEN 'empty_or_invalid_type'
        WHEN 1 THEN 'empty_or_invalid_type' WHEN 2 THEN 'explicit_form' WHEN 3 THEN 'empty_call_list' WHEN 4 THEN 'tool_invocation' WHEN 5 THEN 'unrecognized_or_malformed'
        WHEN 6 THEN 'unrecognized_or_malformed' ELSE CASE WHEN json_type(props) = 'OBJECT' THEN 'tool_invocation' ELSE 'unrecognized_or_malformed' END END AS reason FROM events""",
    "format_scores": """SELECT event_id, ['json_keys', 'ordered_list', 'exact_prefix', 'case_transform'][event_id % 4 + 1] AS kind,
        (CASE event_id % 4 WHEN 1 THEN event_id % 3 <> 2 ELSE event_id % 3 <> 0 END)::INT::DOUBLE AS score FROM events""",
    "pending_after_commit": """SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (
        SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 5 = 0 AND event_id % 3 <> 0)""",
    "first_repetitions": f"WITH {OBS} SELECT cond, split, example_id, group_id, event_id FROM obs WHERE repetition = 0",
    "headline_check": """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'headline_differs' WHEN 'MACHINERY' THEN 'headline_unrecorded' ELSE 'headline_missing' END AS rule, c_mktsegment AS key
        FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY ALL""",
    "band_check": """SELECT 'band_low' AS rule, user_id::VARCHAR AS key FROM events WHERE user_id % 7 = 0 GROUP BY ALL
        UNION ALL SELECT 'band_high', user_id::VARCHAR FROM events WHERE user_id % 11 = 0 GROUP BY ALL""",
    "topology_check": """WITH RECURSIVE one AS (
        SELECT conv_id AS model, turn AS component, CASE WHEN turn > 0 THEN turn - 1 WHEN conv_id % 11 = 0 THEN 1 END AS above, conv_id % 17 = 0 AND turn = 0 AS below
        FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1)
      ), r AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE model % 13 = 0 AND component = 2), reached AS (
        SELECT model, component FROM one WHERE above IS NULL UNION SELECT o.model, o.component FROM one o JOIN reached p ON p.model = o.model AND p.component = o.above
      )
      SELECT model, component, 'component_duplicated' AS reason FROM r GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT model, component, 'order_negative' FROM r WHERE below
      UNION ALL SELECT model, component, 'parent_missing' FROM r WHERE above IS NOT NULL AND NOT EXISTS (SELECT 1 FROM one p WHERE p.model = r.model AND p.component = r.above)
      UNION ALL SELECT model, component, 'no_root_above' FROM (SELECT DISTINCT model, component FROM one) o WHERE NOT EXISTS (SELECT 1 FROM reached p WHERE p.model = o.model AND p.component = o.component)""",
    "exact_match_score": """WITH r AS (SELECT lang, CASE WHEN length(d.text) % 5 = 0 THEN 1.0 WHEN regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') = b.text THEN 1.0 ELSE 0.0 END AS v FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)
        SELECT lang, sum(v)::DOUBLE AS numerator, count(*) AS denominator, round(sum(v)::DOUBLE / count(*), 6) AS value FROM r GROUP BY ALL""",
    "synthetic_scan": """SELECT cond, lang, round(avg(CASE WHEN cond = 'scan.component.damage' THEN (text = 'damaged')::INT ELSE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') = text)::INT END), 6) AS value, count(*) AS records
        FROM (SELECT lang, trim(text, ' ') AS text FROM documents), (VALUES ('baseline'), ('scan.component.damage'), ('scan.component.neutral')) AS t(cond) GROUP BY ALL""",
    "schema_violations": """WITH r AS (SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS INT) AS k, event_id % 7 AS m FROM events)
SELECT 'schema_json' AS rule, event_id::VARCHAR AS key, '$' AS path FROM r WHERE m = 0
UNION ALL SELECT 'schema_type', event_id::VARCHAR, '$.j' FROM r WHERE m = 1
UNION ALL SELECT 'schema_required', event_id::VARCHAR, '$.k' FROM r WHERE m = 2
UNION ALL SELECT 'schema_minimum', event_id::VARCHAR, '$.k' FROM r WHERE m NOT IN (0, 2) AND k < 10
UNION ALL SELECT 'schema_exclusiveMaximum', event_id::VARCHAR, '$.k' FROM r WHERE m NOT IN (0, 2) AND k >= 90
UNION ALL SELECT 'schema_maxLength', event_id::VARCHAR, '$.t' FROM r WHERE m = 3 AND length(t) > 5
UNION ALL SELECT 'schema_pattern', event_id::VARCHAR, '$.t' FROM r WHERE m = 3 AND NOT regexp_full_match(t, '[a-z]+')
UNION ALL SELECT 'schema_minItems', event_id::VARCHAR, '$.l' FROM r WHERE m = 4 AND event_id % 2 = 1
UNION ALL SELECT 'schema_enum', event_id::VARCHAR, '$.l[0]' FROM r WHERE m = 4 AND event_id % 2 = 0 AND event_id % 3 <> 1""",
    "frozen_roles": f"""WITH {ROLES}, kept AS (
  SELECT doc_id, id, g, CASE WHEN doc_id % 29 = 3 THEN 'other' ELSE kind END AS kind, CASE WHEN doc_id % 43 = 1 THEN 'holdout' WHEN doc_id % 41 = 0 THEN 'validation' ELSE split END AS split FROM roles WHERE doc_id % 23 <> 5
), found AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE doc_id % 31 = 7),
sides AS (SELECT concat_ws('/', id, g, kind, split) AS key, 1 AS f, 0 AS p FROM found UNION ALL SELECT concat_ws('/', id, g, kind, split), 0, 1 FROM roles),
counts AS (SELECT key, sum(f) AS f, sum(p) AS p FROM sides GROUP BY key)
SELECT CASE WHEN p = 0 THEN 'record_unplanned' WHEN f < p THEN 'record_missing' ELSE 'record_repeated' END AS rule, key FROM counts WHERE f <> p OR p = 0
UNION ALL SELECT 'record_id_repeated', id FROM found GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'group_crosses_splits', g FROM found GROUP BY g HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'split_unknown', id FROM found WHERE split = 'holdout'""",
    "plan_identity": f"""WITH {ROLES}, moved AS (SELECT doc_id, id, g, kind, CASE WHEN doc_id % 41 = 0 THEN 'validation' ELSE split END AS split FROM roles),
placed AS (SELECT *, row_number() OVER (PARTITION BY split, kind ORDER BY doc_id) AS o FROM moved), kept AS (SELECT * FROM placed WHERE NOT (kind = 'en' AND doc_id % 37 = 2)),
plan AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE kind = 'de' AND doc_id % 31 = 7)
SELECT 'plan_id_repeated' AS rule, id AS key FROM plan GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'plan_group_crosses_splits', g FROM plan GROUP BY g HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'plan_ordinals', split || '/' || kind FROM plan GROUP BY split, kind HAVING count(DISTINCT o) <> count(*) OR min(o) <> 1 OR max(o) <> count(*)""",
    "observation_gaps": f"""WITH {OBS}, s AS (SELECT cond || '/' || split AS cell, example_id, status, (value <= 60)::INT AS score FROM obs)
SELECT 'observation_incomplete' AS rule, cell || '/' || example_id AS key FROM s WHERE status <> 'complete'
UNION ALL SELECT 'repeats_differ', cell || '/' || example_id FROM s GROUP BY cell, example_id HAVING min(score) <> max(score)
UNION ALL SELECT 'items_missing', cell FROM s GROUP BY cell HAVING count(DISTINCT example_id) < (SELECT count(DISTINCT example_id) FROM s)""",
    "numbered_events": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS place FROM events",
    "cycle_members": """WITH RECURSIVE n AS (
  SELECT conv_id || '/' || turn AS node, conv_id || '/' || CASE WHEN turn > 0 THEN turn - 1 WHEN conv_id % 11 = 0 THEN 1 WHEN conv_id % 13 = 0 THEN 3 END AS above FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1)
), up AS (SELECT node, above AS reached FROM n WHERE above IS NOT NULL UNION SELECT up.node, n.above FROM up JOIN n ON n.node = up.reached WHERE n.above IS NOT NULL)
SELECT DISTINCT node FROM up WHERE node = reached""",
    "uncommitted_tasks": "SELECT DISTINCT user_id || '/' || event_type AS task FROM events EXCEPT SELECT user_id || '/' || event_type FROM events WHERE event_id % 3 = 0",
    "resume_pending_tasks": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "latest_attempt": f"WITH {FAILURES} SELECT task, arg_max(event_id, attempt) AS event_id, arg_max(example_id, attempt) AS example_id, max(attempt) AS attempt FROM failures GROUP BY ALL",
    "retry_accounting": f"WITH {FAILURES} SELECT task, count(DISTINCT attempt) AS attempts, count(DISTINCT attempt) - 1 AS retries FROM failures GROUP BY ALL",
    "trace_parent_graph": f"""WITH RECURSIVE {SPANS}, up AS (SELECT span, span AS root, 0::BIGINT AS depth FROM spans WHERE parent IS NULL
        UNION ALL SELECT s.span, u.root, u.depth + 1 FROM spans s JOIN up u ON s.parent = u.span) SELECT s.span, u.root, u.depth FROM spans s LEFT JOIN up u USING (span)""",
    "trace_graph_violations": f"""WITH {SPANS}, s AS (SELECT * FROM spans WHERE NOT (conv_id % 7 = 0 AND turn = 1) AND NOT (conv_id % 11 = 0 AND turn = 0)), a AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE conv_id % 13 = 0 AND turn = 2)
        SELECT conv_id, span AS node, 'duplicate_span' AS reason FROM a GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT conv_id, span, 'parent_missing' FROM a WHERE parent IS NOT NULL AND parent NOT IN (SELECT span FROM a)
        UNION ALL SELECT conv_id, NULL, 'not_one_root' FROM a GROUP BY conv_id HAVING count(*) FILTER (parent IS NULL) <> 1""",
    "event_counter_equality": """SELECT user_id, event_type, count(*) AS events, nullif(count(*) FILTER (event_id % 41 <> 0), 0) AS counter FROM events GROUP BY ALL HAVING count(*) <> count(*) FILTER (event_id % 41 <> 0)""",
    "record_span_coverage": """WITH a AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), b AS (SELECT conv_id, role, sum((conv_id % 5 <> 0)::INT + (conv_id % 9 = 0)::INT) AS n FROM conversations GROUP BY ALL)
        SELECT conv_id, role, CASE WHEN a.n > b.n THEN 'missing' ELSE 'unexpected' END AS side, abs(a.n - b.n)::BIGINT AS rows FROM a JOIN b USING (conv_id, role) WHERE a.n <> b.n""",
    "hook_balance": """SELECT user_id AS segment, count(*) FILTER (event_type = 'view') AS active, count(*) FILTER (event_type = 'click') AS removed, count(*) FILTER (event_type = 'signup') AS failed,
        count(*) FILTER (event_type = 'error') AS cleanup_failed FROM events WHERE event_type <> 'purchase' GROUP BY ALL
        HAVING count(*) FILTER (event_type = 'view') <> count(*) FILTER (event_type IN ('click', 'signup')) OR count(*) FILTER (event_type = 'error') > 0""",
}

_HEADLINES = f"""found AS (
  SELECT 'r2/' || model || '/' || target AS headline, 'r2' AS kind, r2 AS value, 0.00005 AS tolerance, target FROM ({ORACLES['ols_fit']}) WHERE spec = 'log'
  UNION ALL SELECT 'rho/' || target, 'rho', rho, 0.0005, target FROM ({ORACLES['spearman_cross_model']}) WHERE spec = 'log'
  UNION ALL SELECT 'half/' || model || '/' || target, 'half', median, 1e-12, target FROM ({ORACLES['split_half_rho']})
), flags AS (SELECT 'set/' || model || '/' || target AS headline, layer FROM ({ORACLES['damage_flags']}) WHERE material)"""

ORACLES["paper_headlines"] = f"""WITH {_HEADLINES}
SELECT CASE WHEN kind = 'half' THEN 'headline_unrecorded' ELSE 'headline_differs' END AS rule, headline AS key FROM found WHERE (kind = 'half' AND target = 'y3') OR (kind = 'r2' AND target = 'y2')
UNION ALL SELECT 'member_unrecorded', headline || '/7' FROM flags WHERE layer = 7
UNION ALL SELECT DISTINCT 'member_missing', headline || '/99' FROM flags"""

ORACLES["band_from_draws"] = f"""WITH b AS ({ORACLES['simultaneous_band']}), k AS (SELECT *, model || '/' || target || '/' || spec || '/' || layer AS key FROM b)
SELECT 'band_low' AS rule, key FROM k WHERE layer % 9 = 0 AND low IS NOT NULL
UNION ALL SELECT 'band_high', key FROM k WHERE layer % 10 = 3 AND high IS NOT NULL
UNION ALL SELECT 'band_se', key FROM k WHERE layer = 5 AND spec = 'log' AND se > 1e-9
UNION ALL SELECT 'band_deviation', draw::VARCHAR FROM range(200) AS d(draw) WHERE draw % 50 = 7"""
