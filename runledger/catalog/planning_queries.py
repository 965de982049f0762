"""Scoring, recommendation, evaluation and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.catalog.registry import query
from runledger.catalog.relational_queries import rounded
from runledger.functions import labels
from runledger.operators import evaluation, scoring, statistics
from runledger.plans import recommend, reports
from runledger.session import new_path, stage
from runledger.sources import sinks

CONFIG_SQL = "cloud, region, machine_type, nodes"


@query("g1_min_max", f"""
    SELECT workload_type, {CONFIG_SQL}, round(CASE WHEN MAX(predicted_cost_usd) OVER w = MIN(predicted_cost_usd) OVER w THEN 0 ELSE (predicted_cost_usd - MIN(predicted_cost_usd) OVER w) / (MAX(predicted_cost_usd) OVER w - MIN(predicted_cost_usd) OVER w) END, 6) AS score,
      CAST(0 AS DOUBLE) AS constant FROM {{scored}} WINDOW w AS (PARTITION BY workload_type)
""")
def _(t):
    w = Window.partitionBy("workload_type")
    return rounded(t("scored").select("workload_type", *fv.CONFIG, scoring.min_max(F.col("predicted_cost_usd"), w).alias("score"), scoring.min_max(F.lit(3.0), w).alias("constant")))


@query("g2_ratio_to_best", f"""
    SELECT workload_type, {CONFIG_SQL}, round((predicted_runtime_minutes - MIN(predicted_runtime_minutes) OVER w) / MIN(predicted_runtime_minutes) OVER w, 6) AS lower_better,
      round((MAX(renewable_percentage_mean) OVER w - renewable_percentage_mean) / MAX(renewable_percentage_mean) OVER w, 6) AS higher_better,
      round(((predicted_cost_usd - 1) - MIN(predicted_cost_usd - 1) OVER w) / (MAX(predicted_cost_usd - 1) OVER w - MIN(predicted_cost_usd - 1) OVER w), 6) AS negative_best FROM {{scored}} WINDOW w AS (PARTITION BY workload_type)
""")
def _(t):
    w = Window.partitionBy("workload_type")
    return rounded(t("scored").select(
        "workload_type", *fv.CONFIG, scoring.ratio_to_best(F.col("predicted_runtime_minutes"), w).alias("lower_better"),
        scoring.ratio_to_best(F.col("renewable_percentage_mean"), w, higher_is_better=True).alias("higher_better"),
        scoring.ratio_to_best(F.col("predicted_cost_usd") - 1, w).alias("negative_best"),
    ))


_RANKED = """(SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 12), k2, k3, k4, k5, k6, cloud, region, machine_type, nodes, electricity_zone) AS rank FROM (
  SELECT *, CASE goal WHEN 'cost' THEN cost WHEN 'runtime' THEN rt WHEN 'carbon' THEN em ELSE em END AS k2, CASE goal WHEN 'cost' THEN rt WHEN 'runtime' THEN cost WHEN 'carbon' THEN ci ELSE cost END AS k3,
    CASE goal WHEN 'cost' THEN ci WHEN 'runtime' THEN ci WHEN 'carbon' THEN -re ELSE rt END AS k4, CASE goal WHEN 'carbon' THEN cost WHEN 'balanced' THEN 0 ELSE -re END AS k5, CASE goal WHEN 'carbon' THEN rt ELSE 0 END AS k6,
    CASE goal WHEN 'cost' THEN CASE WHEN cost1 = cost0 THEN 0 ELSE (cost - cost0) / (cost1 - cost0) END WHEN 'runtime' THEN CASE WHEN rt1 = rt0 THEN 0 ELSE (rt - rt0) / (rt1 - rt0) END WHEN 'carbon' THEN CASE WHEN em1 = em0 THEN 0 ELSE (em - em0) / (em1 - em0) END + 0.25e0 * (1 - CASE WHEN re1 = re0 THEN 0 ELSE (re - re0) / (re1 - re0) END)
      ELSE sqrt(0.35e0 * ((rt - rt0) / rt0)**2 + 0.35e0 * ((cost - cost0) / cost0)**2 + 0.2e0 * ((em - em0) / em0)**2 + 0.1e0 * ((re1 - re) / re1)**2) END AS score
  FROM (SELECT q.*, s.cloud, s.region, s.machine_type, s.nodes, s.electricity_zone, s.rt, s.cost, s.em, s.ci, s.re, no_sla,
      MIN(rt) OVER p AS rt0, MAX(rt) OVER p AS rt1, MIN(cost) OVER p AS cost0, MAX(cost) OVER p AS cost1, MIN(em) OVER p AS em0, MAX(em) OVER p AS em1, MIN(re) OVER p AS re0, MAX(re) OVER p AS re1
    FROM (SELECT q.request_id, s.*, NOT bool_or(q.sla_runtime_minutes IS NULL OR s.rt <= q.sla_runtime_minutes) OVER (PARTITION BY q.request_id) AS no_sla, (q.sla_runtime_minutes IS NULL OR s.rt <= q.sla_runtime_minutes) AS ok
          FROM {asked} q JOIN (SELECT workload_type, cloud, region, machine_type, nodes, electricity_zone, predicted_runtime_minutes AS rt, predicted_cost_usd AS cost, predicted_emissions_gco2eq AS em, carbon_intensity_mean AS ci, renewable_percentage_mean AS re FROM {{scored}}) s ON q.workload_type = s.workload_type) s
    JOIN {asked} q ON q.request_id = s.request_id WHERE ok OR no_sla WINDOW p AS (PARTITION BY q.request_id))))"""
_ALL = _RANKED.replace("{asked}", "{{requests}}").replace("{{", "{").replace("}}", "}")


def _scored(t):
    return t.shared("scored", lambda: recommend.scored_candidates(t("dataset"), t("power"), t("vcpus")))


@query("k6_recommendations", f"SELECT request_id, rank, {CONFIG_SQL}, round(score, 6) AS optimization_score, round(rt, 6) AS predicted_runtime_minutes, round(em, 6) AS predicted_emissions_gco2eq, no_sla AS no_sla_match FROM {_ALL} WHERE rank <= 5")
def _(t):
    best = recommend.recommend(t("requests"), _scored(t), 5)
    return rounded(best.select("request_id", "rank", *fv.CONFIG, "optimization_score", "predicted_runtime_minutes", "predicted_emissions_gco2eq", "no_sla_match"))


_UNPREDICTED = "(workload_type = 'memory-heavy' OR (workload_type = 'cpu-heavy' AND nodes = 4))"


@query("k6_answered_requests", f"""
    WITH o AS (SELECT workload_type, COUNT(*) AS candidates, COUNT(*) FILTER (WHERE {_UNPREDICTED}) AS unpredicted FROM {{scored}} GROUP BY 1),
      s AS (SELECT workload_type, predicted_runtime_minutes AS rt FROM {{scored}} WHERE NOT {_UNPREDICTED}),
      m AS (SELECT q.request_id, COUNT(*) FILTER (WHERE q.sla_runtime_minutes IS NULL OR s.rt <= q.sla_runtime_minutes) AS met FROM {{requests}} q JOIN s ON q.workload_type = s.workload_type GROUP BY 1)
    SELECT workload_type, status, COUNT(*) AS requests, CAST(SUM(ranked) AS BIGINT) AS ranked, MAX(unpredicted) AS unpredicted FROM (
      SELECT q.workload_type, coalesce(o.unpredicted, 0) AS unpredicted,
        CASE WHEN o.candidates IS NULL THEN 'unknown_workload' WHEN o.candidates = o.unpredicted THEN 'no_predicted_configuration' WHEN m.met = 0 THEN 'no_valid_configuration' ELSE 'ok' END AS status,
        CASE WHEN o.candidates IS NULL OR o.candidates = o.unpredicted THEN 0 WHEN m.met = 0 THEN least(5, o.candidates - o.unpredicted) ELSE least(5, m.met) END AS ranked
      FROM {{requests}} q LEFT JOIN o ON q.workload_type = o.workload_type LEFT JOIN m ON q.request_id = m.request_id) GROUP BY 1, 2
""")
def _(t):
    """Every request is answered; one workload has no predicted candidate, another only some."""
    missing = F.expr(_UNPREDICTED)
    scored = _scored(t).withColumn("predicted_cost_usd", F.when(~missing, F.col("predicted_cost_usd")))
    return recommend.answers(t("requests"), scored, 5).groupBy("workload_type", "status").agg(
        F.countDistinct("request_id").alias("requests"), F.count("rank").alias("ranked"), F.max("unpredicted").alias("unpredicted")
    )


@query("g3_goal_scores", f"SELECT goal, COUNT(*) AS candidates, round(AVG(score), 6) AS mean_score, round(MAX(score), 6) AS greatest FROM {_ALL} GROUP BY 1")
def _(t):
    """Requests that admit the same candidates for the same goal share their scores."""
    ranked = recommend.ranked_classes(t("requests"), _scored(t))
    mean = F.sum(F.col("optimization_score") * F.col("requests")) / F.sum("requests")
    return rounded(ranked.groupBy("goal").agg(F.sum("requests").alias("candidates"), mean.alias("mean_score"), F.max("optimization_score").alias("greatest")))


@query("g4_ranks", f"SELECT workload_type, {CONFIG_SQL}, COUNT(*) AS requests, CAST(SUM(rank) AS BIGINT) AS rank_sum FROM {_ALL} GROUP BY 1, 2, 3, 4, 5")
def _(t):
    ranked = recommend.ranked_classes(t("requests"), _scored(t))
    return ranked.groupBy("workload_type", *fv.CONFIG).agg(F.sum("requests").alias("requests"), F.sum(F.col("rank") * F.col("requests")).alias("rank_sum"))


@query("g12_top_three", f"SELECT request_id, rank, machine_type, nodes FROM {_ALL} WHERE rank <= 3")
def _(t):
    return recommend.recommend(t("requests"), _scored(t), 3).select("request_id", "rank", "machine_type", "nodes")


@query("g13_best_candidate", f"SELECT request_id, {CONFIG_SQL} FROM {_ALL} WHERE rank = 1")
def _(t):
    return recommend.best_candidate(t("requests"), _scored(t)).select("request_id", *fv.CONFIG)


@query("c27_report_columns", f"""
    SELECT request_id, rank AS "Rank", cloud AS "Cloud", region AS "Region", machine_type AS "Machine Type", nodes AS "Nodes", round(rt, 4) AS "Predicted Runtime (minutes)", round(cost, 4) AS "Predicted Cost (USD)", round(em, 4) AS "Predicted Emissions (gCO2eq)",
      round(ci, 4) AS "Carbon Intensity", round(re, 4) AS "Renewable Percentage", round(score, 4) AS "Optimization Score",
      concat(CASE WHEN no_sla THEN 'No configuration satisfied the SLA; ' ELSE '' END, CASE goal WHEN 'cost' THEN 'ranked by lowest predicted cost' WHEN 'runtime' THEN 'ranked by fastest predicted runtime'
        WHEN 'carbon' THEN 'ranked by lowest predicted emissions for this job and higher renewable percentage' ELSE 'ranked by best trade-off between runtime, cost, carbon, and renewable energy' END, '.') AS "Recommendation Reason"
    FROM {_ALL} WHERE rank <= 2
""")
def _(t):
    return scoring.report(recommend.recommend(t("requests"), _scored(t), 2))


_GRID = """(SELECT w || '_' || g AS request_id, w AS workload_type, 1024.0 AS dataset_size_mb, 2.5e0 AS sla_runtime_minutes, g AS goal
    FROM (SELECT unnest(['cpu-heavy', 'memory-heavy', 'io-heavy']) AS w), (SELECT unnest(['cost', 'runtime', 'carbon', 'balanced']) AS g))"""
_GRID_RANKED = _RANKED.replace("{asked}", _GRID).replace("{{scored}}", "{scored}")


@query("k14_example_grid", f"SELECT request_id, rank, {CONFIG_SQL}, round(score, 6) AS optimization_score FROM {_GRID_RANKED} WHERE rank <= 5")
def _(t):
    best = recommend.recommend(recommend.example_requests(t.spark, sla=2.5), _scored(t), 5)
    path = new_path(t.spark, "examples")
    sinks.write_records(best.select("request_id", "rank", *fv.CONFIG, "optimization_score"), path, "json", by=["request_id"])
    back = t.spark.read.schema("rank int, cloud string, region string, machine_type string, nodes int, optimization_score double, request_id string").json(path)
    return rounded(back)


@query("e16_request_expansion", "SELECT q.workload_type, COUNT(*) AS rows, COUNT(DISTINCT q.request_id) AS requests FROM {requests} q JOIN {scored} s ON q.workload_type = s.workload_type GROUP BY 1")
def _(t):
    rows = scoring.expand_requests(t("requests"), _scored(t))
    return rows.groupBy("workload_type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("request_id").alias("requests"))


_PRICED = "SELECT DISTINCT p.instance_type, r.nodes, p.hourly_price_usd, p.category FROM (SELECT DISTINCT machine_type, nodes FROM {runs}) r JOIN (SELECT machine_type AS instance_type, CASE machine_type WHEN 'ECONOMY' THEN NULL ELSE min(price_usd_hr) END AS hourly_price_usd, CASE machine_type WHEN 'LARGE' THEN 'compute' WHEN 'SMALL' THEN 'storage' WHEN 'MEDIUM' THEN 'memory' ELSE 'general' END AS category FROM {price_list} GROUP BY 1) p ON r.machine_type = p.instance_type"
_MACHINE_MEANS = "SELECT workload_type, machine_type AS instance_type, nodes, round(AVG(runtime_minutes), 9) AS predicted_runtime_minutes, round(AVG(cost_usd), 9) AS model_predicted_cost_usd FROM {dataset} GROUP BY 1, 2, 3"
_LEGACY_ALLOWED = "((workload_type = 'cpu-heavy' AND category IN ('general', 'compute')) OR (workload_type = 'memory-heavy' AND category IN ('general', 'memory')) OR (workload_type = 'io-heavy' AND category IN ('general', 'storage')))"


_LEGACY_OK = "(coalesce(q.sla_runtime_minutes IS NULL OR o.rt <= q.sla_runtime_minutes, FALSE) AND o.cost IS NOT NULL)"


@query("k7_cheapest_within_sla", f"""
    SELECT request_id, workload_type, sla_runtime_minutes, CASE WHEN any_ok THEN 'ok' WHEN candidates = 0 THEN 'unknown_workload' WHEN cost IS NULL THEN 'no_priced_configuration' ELSE 'no_valid_configuration' END AS status, candidates,
      CASE WHEN cost IS NOT NULL THEN instance_type END AS instance_type, CASE WHEN cost IS NOT NULL THEN nodes END AS nodes, CASE WHEN cost IS NOT NULL THEN category END AS category, CASE WHEN cost IS NOT NULL THEN round(rt, 6) END AS predicted_runtime_minutes, round(cost, 6) AS predicted_cost_usd, CASE WHEN cost IS NOT NULL THEN round(model_predicted_cost_usd, 6) END AS model_predicted_cost_usd
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ok DESC, cost IS NULL, CASE WHEN ok THEN cost ELSE rt END, CASE WHEN ok THEN rt ELSE cost END, nodes, instance_type) AS pos FROM (
      SELECT q.request_id, q.workload_type, q.sla_runtime_minutes, o.* EXCLUDE (workload_type), {_LEGACY_OK} AS ok, bool_or({_LEGACY_OK}) OVER (PARTITION BY q.request_id) AS any_ok, COUNT(o.instance_type) OVER (PARTITION BY q.request_id) AS candidates
      FROM {{requests}} q LEFT JOIN (SELECT m.workload_type, c.instance_type, c.nodes, c.category, m.model_predicted_cost_usd, greatest(m.predicted_runtime_minutes, 0.01) AS rt, round(c.hourly_price_usd * c.nodes * (greatest(m.predicted_runtime_minutes, 0.01) / 60.0), 9) AS cost
        FROM ({_MACHINE_MEANS}) m JOIN ({_PRICED}) c ON m.instance_type = c.instance_type AND m.nodes = c.nodes WHERE {_LEGACY_ALLOWED.replace('workload_type', 'm.workload_type').replace('category', 'c.category')}) o ON q.workload_type = o.workload_type)) WHERE pos = 1
""")
def _(t):
    requests = t("requests").withColumn("sla_runtime_minutes", F.col("sla_runtime_minutes").cast("double"))
    return rounded(recommend.cheapest_within_sla(requests, t.sql(_PRICED), t.sql(_MACHINE_MEANS)), skip=("sla_runtime_minutes",))


@query("d5_allowed_categories", f"SELECT m.workload_type, c.instance_type, c.nodes, c.category FROM ({_MACHINE_MEANS}) m JOIN ({_PRICED}) c ON m.instance_type = c.instance_type AND m.nodes = c.nodes WHERE {_LEGACY_ALLOWED.replace('workload_type', 'm.workload_type').replace('category', 'c.category')}")
def _(t):
    """What a workload is offered: its predicted candidates in the categories that it allows."""
    return recommend.allowed_offers(t.sql(_MACHINE_MEANS), t.sql(_PRICED)).select("workload_type", "instance_type", "nodes", "category")


@query("h4_fastest_candidates", f"SELECT workload_type, {CONFIG_SQL}, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY workload_type ORDER BY predicted_runtime_minutes, {CONFIG_SQL}) AS position FROM {{scored}}) WHERE position <= 10")
def _(t):
    return recommend.fastest_candidates(_scored(t), ["workload_type"], 10).select("workload_type", *fv.CONFIG, "position")


# ---------------------------------------------------------------------------
# Evaluation, leaving one scenario out.
# ---------------------------------------------------------------------------

_S = "workload_type, dataset_size_mb"
_TRUTH = f"""t AS (SELECT {_S}, {CONFIG_SQL}, electricity_zone, COUNT(*) AS runs, round(AVG(runtime_minutes), 9) AS rt, round(AVG(cost_usd), 9) AS cost,
    round(round(AVG(runtime_minutes), 9) / 60.0 * round(AVG(carbon_intensity_mean), 9), 9) AS em FROM {{dataset}} GROUP BY ALL)"""
_SAME = "d.cloud = t.cloud AND d.region = t.region AND d.machine_type = t.machine_type AND d.nodes = t.nodes"
_OTHER = f"""o AS (SELECT s.workload_type, s.dataset_size_mb, round(AVG(d.runtime_minutes), 9) AS o_rt, round(AVG(d.cost_usd), 9) AS o_cost FROM (SELECT DISTINCT {_S} FROM t) s
    JOIN {{dataset}} d ON NOT (d.workload_type = s.workload_type AND d.dataset_size_mb = s.dataset_size_mb) GROUP BY 1, 2)"""
_HIST = f"""{_OTHER}, h AS (SELECT t.{_S.replace(', ', ', t.')}, t.cloud, t.region, t.machine_type, t.nodes, greatest(coalesce(round(AVG(d.runtime_minutes), 9), any_value(o_rt)), 0.01e0) AS h_rt, greatest(coalesce(round(AVG(d.cost_usd), 9), any_value(o_cost)), 0e0) AS h_cost
    FROM t JOIN o ON o.workload_type = t.workload_type AND o.dataset_size_mb = t.dataset_size_mb LEFT JOIN {{dataset}} d ON {_SAME} AND NOT (d.workload_type = t.workload_type AND d.dataset_size_mb = t.dataset_size_mb) GROUP BY ALL)"""
_NEAREST_RUN = "arg_min(struct_pack(rt := d.runtime_minutes, cost := d.cost_usd), (abs(d.dataset_size_mb - t.dataset_size_mb), d.dataset_size_mb, d.runtime_minutes, d.cost_usd))"
_NEAR = f"""near_own AS (SELECT t.{_S.replace(', ', ', t.')}, t.cloud, t.region, t.machine_type, t.nodes, {_NEAREST_RUN} AS near FROM t JOIN {{dataset}} d ON {_SAME} AND d.workload_type = t.workload_type AND d.dataset_size_mb <> t.dataset_size_mb GROUP BY ALL),
  near_any AS (SELECT t.workload_type, t.dataset_size_mb, {_NEAREST_RUN} AS near FROM (SELECT DISTINCT {_S} FROM t) t JOIN {{dataset}} d ON d.workload_type = t.workload_type AND d.dataset_size_mb <> t.dataset_size_mb GROUP BY ALL),
  n AS (SELECT t.{_S.replace(', ', ', t.')}, t.cloud, t.region, t.machine_type, t.nodes, struct_pack(rt := coalesce(near_own.near.rt, near_any.near.rt, o_rt), cost := coalesce(near_own.near.cost, near_any.near.cost, o_cost)) AS near
    FROM t JOIN o USING ({_S}) LEFT JOIN near_own USING ({_S}, {CONFIG_SQL}) LEFT JOIN near_any USING ({_S}))"""
_SLA = f"""thr AS (SELECT {_S}, unnest(['tight', 'medium', 'loose']) AS sla_level, unnest([quantile_cont(rt, 0.25), quantile_cont(rt, 0.5), quantile_cont(rt, 0.75)]) AS sla FROM t GROUP BY 1, 2)"""
_BEST = f"""b AS (SELECT thr.workload_type, thr.dataset_size_mb, sla_level, sla, COUNT(*) AS feasible, MIN(cost) AS b_cost, MIN(rt) AS b_rt, MIN(em) AS b_em, arg_min(struct_pack(cloud := cloud, region := region, m := machine_type, n := nodes), (cost, cloud, region, machine_type, nodes)) AS opt
    FROM t JOIN thr ON t.workload_type = thr.workload_type AND t.dataset_size_mb = thr.dataset_size_mb WHERE rt <= sla GROUP BY 1, 2, 3, 4)"""
_HASH = "CAST(('0x' || substr(md5(concat_ws('|', '42', t.workload_type, CAST(t.dataset_size_mb AS VARCHAR), t.cloud, t.region, t.machine_type, CAST(t.nodes AS VARCHAR))), 1, 8))::UBIGINT AS DOUBLE)"
_METHODS = f"""m AS (SELECT t.*, x.method, CASE x.method WHEN 'nearest_size' THEN greatest(n.near.rt, 0.01e0) ELSE h_rt END AS p_rt,
      CASE x.method WHEN 'nearest_size' THEN n.near.cost WHEN 'largest_cluster' THEN -t.nodes WHEN 'random' THEN {_HASH} ELSE h_cost END AS o1,
      CASE x.method WHEN 'nearest_size' THEN greatest(n.near.rt, 0.01e0) WHEN 'largest_cluster' THEN h_cost WHEN 'random' THEN 0 ELSE h_rt END AS o2
    FROM t JOIN h USING ({_S}, {CONFIG_SQL}) JOIN n USING ({_S}, {CONFIG_SQL}), (SELECT unnest(['historical_mean', 'nearest_size', 'largest_cluster', 'random']) AS method) x)"""
_PICKS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY {_S}, sla_level, method ORDER BY o1, o2, CASE WHEN any_ok THEN 0 ELSE p_rt END, {CONFIG_SQL}) AS pos FROM (
    SELECT m.*, b.* EXCLUDE (workload_type, dataset_size_mb), p_rt <= sla AS ok, bool_or(p_rt <= sla) OVER (PARTITION BY m.workload_type, m.dataset_size_mb, sla_level, method) AS any_ok, COUNT(*) OVER (PARTITION BY m.workload_type, m.dataset_size_mb, sla_level, method) AS candidates
    FROM m JOIN b ON m.workload_type = b.workload_type AND m.dataset_size_mb = b.dataset_size_mb) WHERE ok OR NOT any_ok)"""
_OPT = "(opt.cloud = cloud AND opt.region = region AND opt.m = machine_type AND opt.n = nodes)"
_DETAIL = f"""q AS (SELECT {_S}, sla_level, round(sla, 4) AS sla_minutes, method, any_value(candidates) AS candidates, any_value(feasible) AS feasible_candidates,
    arg_min(cloud, pos) AS chosen_cloud, arg_min(region, pos) AS chosen_region, arg_min(machine_type, pos) AS chosen_machine_type, arg_min(nodes, pos) AS chosen_nodes,
    CAST(bool_or(pos = 1 AND {_OPT}) AS INT) AS top1_correct, CAST(bool_or(pos <= 3 AND {_OPT}) AS INT) AS top3_correct,
    round(any_value(CASE WHEN pos = 1 THEN (cost - b_cost) / b_cost * 100 END), 4) AS cost_regret_pct, round(any_value(CASE WHEN pos = 1 THEN (rt - b_rt) / b_rt * 100 END), 4) AS runtime_regret_pct,
    round(any_value(CASE WHEN pos = 1 THEN (em - b_em) / b_em * 100 END), 4) AS carbon_regret_pct, CAST(bool_or(pos = 1 AND rt > sla AND any_ok) AS INT) AS sla_violation, CAST(NOT bool_or(any_ok) AS INT) AS no_feasible_prediction,
    round(any_value(CASE WHEN pos = 1 THEN rt END), 4) AS measured_runtime_minutes, round(any_value(CASE WHEN pos = 1 THEN cost END), 6) AS measured_cost_usd
  FROM r GROUP BY 1, 2, 3, sla, method)"""
_QUALITY = ", ".join([_TRUTH, _HIST, _NEAR, _SLA, _BEST, _METHODS, _PICKS, _DETAIL])


@query("f9_ground_truth", f"WITH {_TRUTH} SELECT {_S}, {CONFIG_SQL}, electricity_zone, runs, round(rt, 6) AS measured_runtime_minutes, round(cost, 6) AS measured_cost_usd, round(em, 6) AS measured_emissions FROM t")
def _(t):
    return rounded(evaluation.ground_truth(t("dataset")).drop("carbon_intensity_mean", "renewable_percentage_mean"))


@query("e8_historical_mean", f"WITH {_TRUTH}, {_HIST} SELECT {_S}, {CONFIG_SQL}, round(h_rt + 3e-10, 6) AS historical_runtime, round(h_cost + 3e-10, 6) AS historical_cost FROM h")
def _(t):
    return rounded(evaluation.historical_mean(stage(evaluation.cells(t("dataset")))), nudge=3e-10, skip=("dataset_size_mb",))


@query("e9_nearest_size", f"WITH {_TRUTH}, {_OTHER}, {_NEAR} SELECT {_S}, {CONFIG_SQL}, round(near.rt + 3e-10, 6) AS nearest_runtime, round(near.cost + 3e-10, 6) AS nearest_cost FROM n")
def _(t):
    return rounded(evaluation.nearest_size(stage(evaluation.cells(t("dataset")))), nudge=3e-10, skip=("dataset_size_mb",))


@query("e15_left_out_scenarios", f"""
    SELECT s.{_S.replace(', ', ', s.')}, COUNT(*) AS training_rows, round(AVG(d.runtime_minutes) + 3e-10, 6) AS runtime_other, round(AVG(d.cost_usd) + 3e-10, 6) AS cost_other
    FROM (SELECT DISTINCT {_S} FROM {{dataset}}) s JOIN {{dataset}} d ON NOT (s.workload_type = d.workload_type AND s.dataset_size_mb = d.dataset_size_mb) GROUP BY 1, 2
""")
def _(t):
    return rounded(evaluation.scenario_left_out_means(stage(evaluation.cells(t("dataset")))), nudge=3e-10, skip=("dataset_size_mb",))


@query("f20_sla_thresholds", f"WITH {_TRUTH}, {_SLA} SELECT {_S}, sla_level, round(sla, 6) AS sla FROM thr")
def _(t):
    return rounded(evaluation.sla_thresholds(evaluation.cells(t("dataset"))))


@query("g7_best_feasible", f"WITH {_TRUTH}, {_SLA}, {_BEST} SELECT {_S}, sla_level, feasible AS feasible_candidates, round(b_cost, 6) AS best_cost, round(b_rt, 6) AS best_runtime, round(b_em, 6) AS best_emissions, concat(opt.cloud, ' ', opt.region, ' ', opt.m, ' x', opt.n) AS optimal FROM b")
def _(t):
    truth = stage(evaluation.cells(t("dataset")))
    best = evaluation.best_feasible(truth, evaluation.sla_thresholds(truth))
    return rounded(best.withColumn("optimal", labels.config_label(*[F.col(f"optimal.{c}") for c in fv.CONFIG])).drop("sla"))


def _quality(t):
    return t.shared("quality", lambda: evaluation.quality_detail(t("dataset")))


_KEY = f"{_S}, sla_level, method"


@query("j9_quality_detail", f"WITH {_QUALITY} SELECT * FROM q")
def _(t):
    return _quality(t)


@query("g8_regrets", f"WITH {_QUALITY} SELECT {_KEY}, cost_regret_pct, runtime_regret_pct, carbon_regret_pct FROM q")
def _(t):
    return _quality(t).select(*_KEY.split(", "), "cost_regret_pct", "runtime_regret_pct", "carbon_regret_pct")


@query("g9_selected_configs", f"WITH {_QUALITY} SELECT {_KEY}, chosen_cloud, chosen_region, chosen_machine_type, chosen_nodes FROM q")
def _(t):
    return _quality(t).select(*_KEY.split(", "), *[f"chosen_{c}" for c in fv.CONFIG])


@query("g10_hits", f"WITH {_QUALITY} SELECT {_KEY}, top1_correct, top3_correct FROM q")
def _(t):
    return _quality(t).select(*_KEY.split(", "), "top1_correct", "top3_correct")


@query("g11_sla_flags", f"WITH {_QUALITY} SELECT {_KEY}, sla_violation, no_feasible_prediction FROM q")
def _(t):
    return _quality(t).select(*_KEY.split(", "), "sla_violation", "no_feasible_prediction")


@query("e12_measured_choice", f"WITH {_QUALITY} SELECT {_KEY}, measured_runtime_minutes, measured_cost_usd FROM q")
def _(t):
    return _quality(t).select(*_KEY.split(", "), "measured_runtime_minutes", "measured_cost_usd")


_SUMMARY = f"""WITH {_QUALITY} SELECT method, sla_level, COUNT(*) AS scenarios, round(AVG(top1_correct), 4) AS top1_accuracy, round(AVG(top3_correct), 4) AS top3_hit_rate, round(AVG(cost_regret_pct), 4) AS mean_cost_regret_pct,
    round(quantile_cont(cost_regret_pct, 0.5), 4) AS median_cost_regret_pct, round(MAX(cost_regret_pct), 4) AS max_cost_regret_pct, round(AVG(runtime_regret_pct), 4) AS mean_runtime_regret_pct, round(AVG(carbon_regret_pct), 4) AS mean_carbon_regret_pct,
    round(AVG(sla_violation), 4) AS sla_violation_rate, round(AVG(no_feasible_prediction), 4) AS infeasible_rate FROM q GROUP BY 1, 2"""


@query("f21_quality_summary", _SUMMARY)
def _(t):
    return evaluation.quality_summary(_quality(t))


@query("k9_recommendation_quality", _SUMMARY)
def _(t):
    return reports.recommendation_quality(t("dataset"))["summary"]


@query("f22_search_space", f"WITH {_TRUTH} SELECT COUNT(*) AS scenarios, round(AVG(n), 2) AS configurations_per_scenario_mean, MAX(n) AS configurations_per_scenario_max, CAST(SUM(r) AS BIGINT) AS benchmark_runs_in_dataset, 0 AS runs_required_by_recommender_at_inference FROM (SELECT COUNT(*) AS n, SUM(runs) AS r FROM t GROUP BY {_S})")
def _(t):
    return evaluation.search_space(evaluation.ground_truth(t("dataset")))


_FEW = "workload_type <> 'cpu-heavy' OR (machine_type = 'SMALL' AND region = 'ASIA' AND cloud = 'AWS')"


@query("j9_skipped_scenarios", f"SELECT {_S}, concat('only ', COUNT(DISTINCT (cloud, region, machine_type, nodes)), ' configs') AS reason FROM (SELECT * REPLACE (CASE WHEN {_FEW} THEN dataset_size_mb ELSE dataset_size_mb + 100000 END AS dataset_size_mb) FROM {{dataset}}) GROUP BY 1, 2 HAVING COUNT(DISTINCT (cloud, region, machine_type, nodes)) < 5")
def _(t):
    """Most runs of one workload are taken for those of a larger size, which leaves few in its own scenarios."""
    size = F.col("dataset_size_mb")
    moved = t("dataset").withColumn("dataset_size_mb", F.when(F.expr(_FEW), size).otherwise(size + 100000))
    return evaluation.skipped_scenarios(evaluation.cells(moved), min_candidates=5)


# ---------------------------------------------------------------------------
# Repeatability, folds and paired tests.
# ---------------------------------------------------------------------------

# Two-sided tail of Student's t for whole degrees of freedom, as a list expression over the finite series.
_TAIL = """(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (atan(x / sqrt(df)) + CASE WHEN df = 1 THEN 0 ELSE sin(atan(x / sqrt(df))) * list_sum([list_product([CASE WHEN j = 1 THEN cos(atan(x / sqrt(df))) ELSE (j - 1.0) / j * cos(atan(x / sqrt(df)))**2 END FOR j IN range(1, i + 1, 2)]) FOR i IN range(1, df, 2)]) END)
    ELSE sin(atan(x / sqrt(df))) * list_sum([list_product([CASE WHEN j = 0 THEN 1.0 ELSE (j - 1.0) / j * cos(atan(x / sqrt(df)))**2 END FOR j IN range(0, i + 1, 2)]) FOR i IN range(0, df, 2)]) END)"""
_CRITICAL = f"""steps(df, lo, hi, k) AS (SELECT df, 0e0, 100e0, 0 FROM (SELECT DISTINCT df FROM dfs) UNION ALL
    SELECT df, CASE WHEN {_TAIL} > 0.05 THEN x ELSE lo END, CASE WHEN {_TAIL} > 0.05 THEN hi ELSE x END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS x FROM steps WHERE k < 50)),
  crit AS (SELECT df, (lo + hi) / 2 AS c FROM steps WHERE k = 50)"""
_REPEATS = f"g AS (SELECT {_S}, {CONFIG_SQL}, COUNT(*) AS runs, AVG(runtime_minutes) AS m, stddev_samp(runtime_minutes) AS s, MIN(runtime_minutes) AS lo, MAX(runtime_minutes) AS hi FROM {{dataset}} GROUP BY ALL HAVING COUNT(*) >= 2)"


@query("f17_repeatability", f"""WITH RECURSIVE {_REPEATS}, dfs AS (SELECT DISTINCT runs - 1 AS df FROM g), {_CRITICAL}
    SELECT {_S}, {CONFIG_SQL}, runs, round(round(m, 9), 4) AS mean_runtime_minutes, round(s, 4) AS std_runtime_minutes, round(s / m * 100, 2) AS coefficient_of_variation_pct, round(m - c * s / sqrt(runs), 4) AS ci95_lower, round(m + c * s / sqrt(runs), 4) AS ci95_upper,
      round(lo, 4) AS min_runtime_minutes, round(hi, 4) AS max_runtime_minutes FROM g JOIN crit ON crit.df = runs - 1""")
def _(t):
    return statistics.repeatability(t("dataset"))


@query("f17_repeatability_summary", f"WITH {_REPEATS} SELECT COUNT(*) AS configurations_with_repeats, round(MAX(cv), 2) AS max_coefficient_of_variation_pct, round(quantile_cont(cv, 0.5), 2) AS median_coefficient_of_variation_pct FROM (SELECT round(s / m * 100, 2) AS cv FROM g)")
def _(t):
    return statistics.repeatability_summary(statistics.repeatability(t("dataset")))


_FOLD = "CAST(('0x' || substr(md5(concat_ws('|', cloud, region, CAST(dataset_size_mb AS VARCHAR), workload_type, machine_type, CAST(nodes AS VARCHAR))), 1, 8))::UBIGINT % 5 + 1 AS INT)"


@query("f28_fold_count", "SELECT COUNT(*) AS groups, CAST(greatest(2, least(5, COUNT(*))) AS INT) AS folds FROM (SELECT DISTINCT cloud, region, dataset_size_mb, workload_type, machine_type, nodes FROM {dataset})")
def _(t):
    return statistics.fold_count(t("dataset"))


@query("j4_grouped_folds", f"SELECT fold, COUNT(*) AS rows, COUNT(DISTINCT k) AS groups FROM (SELECT {_FOLD} AS fold, concat_ws('|', cloud, region, dataset_size_mb, workload_type, machine_type, nodes) AS k FROM {{dataset}}) GROUP BY 1")
def _(t):
    return statistics.with_folds(t("dataset")).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(*fv.GROUP).alias("groups"))


# Four predictors that plain SQL can state: means over the other folds by ever fewer keys.
MEAN_MODELS = {
    "by_config": ["workload_type", *fv.CONFIG], "by_machine": ["workload_type", "machine_type", "nodes"], "by_workload": ["workload_type"], "overall": [],
}


def _fold_predictions(name, keys):
    on = "".join(f" AND p.{k} = d.{k}" for k in keys)
    group = "".join(f", {k}" for k in keys)
    return f"""SELECT '{name}' AS model, d.fold, x.target, CASE x.target WHEN 'cost_usd' THEN d.cost_usd ELSE d.runtime_minutes END AS actual,
        CASE x.target WHEN 'cost_usd' THEN coalesce(p.c, o.c) ELSE coalesce(p.r, o.r) END AS predicted
      FROM d LEFT JOIN (SELECT f.fold{group}, AVG(runtime_minutes) AS r, AVG(cost_usd) AS c FROM d JOIN f ON d.fold <> f.fold GROUP BY f.fold{group}) p ON p.fold = d.fold{on}
      JOIN (SELECT f.fold, AVG(runtime_minutes) AS r, AVG(cost_usd) AS c FROM d JOIN f ON d.fold <> f.fold GROUP BY f.fold) o ON o.fold = d.fold, x"""


_PER_FOLD = f"""d AS (SELECT *, {_FOLD} AS fold FROM {{dataset}}), f AS (SELECT DISTINCT fold FROM d), x AS (SELECT unnest(['runtime_minutes', 'cost_usd']) AS target),
  p AS ({' UNION ALL '.join(_fold_predictions(n, k) for n, k in MEAN_MODELS.items())}),
  pf AS (SELECT model, fold, target, COUNT(*) AS n_test, AVG(abs(actual - predicted)) AS mae, sqrt(AVG((actual - predicted)**2)) AS rmse, 1 - AVG((actual - predicted)**2) / var_pop(actual) AS r2 FROM p GROUP BY 1, 2, 3)"""


def per_fold(t):
    def build():
        rows = statistics.left_out_fold_predictions(t("dataset"), MEAN_MODELS)
        return statistics.regression_metrics(rows, ["model", "fold", "target"])

    return t.shared("per-fold", build)


@query("f18_fold_metrics", f"WITH {_PER_FOLD} SELECT model, fold, target, n_test, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM pf")
def _(t):
    return rounded(per_fold(t))


@query("f19_fold_summary", f"WITH {_PER_FOLD} SELECT model, target, COUNT(DISTINCT fold) AS folds, round(AVG(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, round(AVG(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std, round(AVG(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std FROM pf GROUP BY 1, 2")
def _(t):
    return statistics.fold_summary(per_fold(t))


@query("f24_fold_table", f"WITH {_PER_FOLD} SELECT target, fold, " + ", ".join(f"round(MAX(CASE WHEN model = '{m}' THEN mae END), 6) AS {m}" for m in MEAN_MODELS) + " FROM pf GROUP BY 1, 2")
def _(t):
    return rounded(statistics.fold_table(per_fold(t), list(MEAN_MODELS)))


_PAIRS = "pr AS (SELECT a.target, a.model AS model_a, b.model AS model_b, a.fold, a.mae AS a, b.mae AS b, a.mae - b.mae AS d FROM pf a JOIN pf b ON a.target = b.target AND a.fold = b.fold AND a.model < b.model)"


@query("e17_model_pairs", f"WITH {_PER_FOLD}, {_PAIRS} SELECT target, model_a, model_b, fold, round(a, 6) AS a, round(b, 6) AS b FROM pr")
def _(t):
    return rounded(statistics.model_pairs(per_fold(t)))


_TESTS = f"""WITH RECURSIVE {_PER_FOLD}, {_PAIRS}, dfs AS (SELECT CAST(4 AS BIGINT) AS df), {_CRITICAL},
  mo AS (SELECT target, model_a, model_b, COUNT(*) AS folds, AVG(a) AS ma, AVG(b) AS mb, AVG(d) AS md, stddev_samp(d) AS sd, COUNT(*) - 1 AS df FROM pr GROUP BY 1, 2, 3),
  rk AS (SELECT target, model_a, model_b, d, rank() OVER (PARTITION BY target, model_a, model_b ORDER BY abs(d)) AS r FROM pr),
  w AS (SELECT target, model_a, model_b, least(SUM(CASE WHEN d > 0 THEN r ELSE 0 END), SUM(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM rk GROUP BY 1, 2, 3),
  signs AS (SELECT list_sum([CASE WHEN (s >> (i - 1)) & 1 = 1 THEN i ELSE 0 END FOR i IN range(1, 6)]) AS total FROM (SELECT unnest(range(0, 32)) AS s)),
  st AS (SELECT mo.*, w.w, c, md / (sd / sqrt(folds)) AS t, abs(md / (sd / sqrt(folds))) AS x, (SELECT least(1.0, 2 * COUNT(*) / 32.0) FROM signs WHERE total <= w.w) AS wp FROM mo JOIN w USING (target, model_a, model_b) JOIN crit USING (df))
  SELECT target, 'mae' AS metric, model_a, model_b, folds, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(md, 6) AS mean_difference, round(md - c * sd / sqrt(folds), 6) AS ci95_lower, round(md + c * sd / sqrt(folds), 6) AS ci95_upper,
    round(t, 4) AS paired_t_statistic, round({_TAIL}, 4) AS paired_t_p_value, CAST(w AS DOUBLE) AS wilcoxon_statistic, round(CAST(wp AS DOUBLE), 4) AS wilcoxon_p_value, round(md / sd, 4) AS cohens_d, {_TAIL} < 0.05 AS significant_at_0_05, (md - c * sd / sqrt(folds) > 0 OR md + c * sd / sqrt(folds) < 0) AS ci_excludes_zero FROM st"""


@query("f25_paired_tests", _TESTS)
def _(t):
    return statistics.paired_tests(per_fold(t))


@query("k10_statistical_report", _TESTS.replace("SELECT target, 'mae' AS metric", "SELECT CAST(count_if(significant_at_0_05) AS BIGINT) AS significant_pairs, COUNT(*) AS total_pairs, MAX(folds) AS folds FROM (SELECT target, 'mae' AS metric") + ")")
def _(t):
    return reports.statistical_report(per_fold(t), t("dataset"))["test_summary"]


@query("f18_average_metrics", f"WITH {_PER_FOLD} SELECT model, fold, round(AVG(r2), 4) AS average_r2, round(AVG(rmse), 4) AS average_rmse FROM pf GROUP BY 1, 2")
def _(t):
    return statistics.average_metrics(per_fold(t), ["model", "fold"])


_LONG = "concat_ws('|', {keys}) AS key, unnest([{names}]) AS measure, unnest([{values}]) AS value"


def _digits(table: str) -> int:
    """Single values are compared almost as they are, aggregates to fewer digits."""
    return 12 if table == "scatter" else 6


def _long_sql(table: str, source: str, keys: list[str], measures: list[str]) -> str:
    text = _LONG.format(keys=", ".join(f"CAST({k} AS VARCHAR)" for k in keys) or "''", names=", ".join("'" + m.strip('"') + "'" for m in measures), values=", ".join(f"round(CAST({m} AS DOUBLE), {_digits(table)})" for m in measures))
    return f"SELECT '{table}' AS table_name, {text} FROM ({source})"


def _long(table: DataFrame, name: str, keys: list[str], measures: list[str]) -> DataFrame:
    """(table_name, key, measure, value) rows, so that tables of any shape can be compared together."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), _digits(name)).alias("value")) for m in measures)))
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys)) if keys else F.lit("")
    return table.select(F.lit(name).alias("table_name"), key.alias("key"), pairs.alias("_p")).select("table_name", "key", "_p.*")


_NUMBERS = ["dataset_size_mb", "nodes", "runtime_minutes", "cost_usd"]
_QUARTER = "quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75"
_TEXT_SQL = "SELECT '{c}' AS \"column\", COUNT({c}) AS count, COUNT(DISTINCT {c}) AS \"unique\", (SELECT {c} FROM {{dataset}} GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS top, (SELECT COUNT(*) FROM {{dataset}} GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS freq FROM {{dataset}}"
_GROUP = ["dataset_size_mb", "workload_type", "machine_type", "nodes"]
_EXPLORED = {
    "summary": (
        "SELECT COUNT(*) AS rows, MIN(runtime_minutes) AS runtime_min, round(AVG(runtime_minutes), 4) AS runtime_mean, MAX(runtime_minutes) AS runtime_max, MIN(cost_usd) AS cost_min, round(AVG(cost_usd), 6) AS cost_mean, MAX(cost_usd) AS cost_max, "
        + ", ".join(f"COUNT(DISTINCT {c}) AS {n}" for c, n in zip(_GROUP, ("sizes", "workloads", "machines", "node_counts"), strict=True)) + " FROM {dataset}",
        [], ["rows", "runtime_min", "runtime_mean", "runtime_max", "cost_min", "cost_mean", "cost_max", "sizes", "workloads", "machines", "node_counts"],
    ),
    "numeric_profile": (
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, AVG({c}) AS mean, stddev_samp({c}) AS std, MIN({c}) AS min, {_QUARTER.format(c=c)}, MAX({c}) AS max FROM {{dataset}}" for c in _NUMBERS),
        ['"column"'], ["count", "mean", "std", "min", "p25", "p50", "p75", "max"],
    ),
    "text_profile": (" UNION ALL ".join(_TEXT_SQL.format(c=c) for c in ("workload_type", "machine_type")), ['"column"', "top"], ["count", '"unique"', "freq"]),
    "grouped_summary": ("SELECT dataset_size_mb, workload_type, machine_type, nodes, AVG(runtime_minutes) AS runtime_mean, AVG(cost_usd) AS cost_mean, COUNT(*) AS runs FROM {dataset} GROUP BY 1, 2, 3, 4", _GROUP, ["runtime_mean", "cost_mean", "runs"]),
    "mean_cost": ("SELECT workload_type, machine_type, AVG(cost_usd) AS cost_usd FROM {dataset} GROUP BY 1, 2", ["workload_type", "machine_type"], ["cost_usd"]),
    "runtime_box": (f"SELECT workload_type, machine_type, MIN(runtime_minutes) AS least, {_QUARTER.format(c='runtime_minutes')}, MAX(runtime_minutes) AS greatest FROM {{dataset}} GROUP BY 1, 2", ["workload_type", "machine_type"], ["least", "p25", "p50", "p75", "greatest"]),
    "runtime_by_size": ("SELECT workload_type, machine_type, nodes, dataset_size_mb, AVG(runtime_minutes) AS runtime_minutes FROM {dataset} GROUP BY 1, 2, 3, 4", ["workload_type", "machine_type", "nodes", "dataset_size_mb"], ["runtime_minutes"]),
    "scatter": ("SELECT runtime_minutes, cost_usd, workload_type, machine_type, dataset_size_mb, nodes FROM {dataset}", ["workload_type", "machine_type", "dataset_size_mb", "nodes"], ["runtime_minutes", "cost_usd"]),
}


@query("k11_exploration", " UNION ALL ".join(_long_sql(n, *x) for n, x in _EXPLORED.items()))
def _(t):
    """All eight tables of the exploration, one under the other."""
    tables = reports.exploration(t("dataset"))
    tables["summary"] = tables["summary"].select(
        "rows", *(F.col(f"{c}.{m}").alias(f"{c.split('_')[0]}_{m}") for c in fv.TARGETS for m in ("min", "mean", "max")),
        *(F.size(c).alias(n) for c, n in (("dataset_sizes_mb", "sizes"), ("workloads", "workloads"), ("machine_types", "machines"), ("node_counts", "node_counts"))),
    )
    bare = lambda names: [n.strip('"') for n in names]
    parts = [_long(tables[n], n, bare(keys), bare(measures)) for n, (_, keys, measures) in _EXPLORED.items()]
    return reduce(DataFrame.unionByName, parts)


_CLEANED = "(SELECT DISTINCT * FROM {raw_runs}) x WHERE lower(trim(workload_type)) <> 'gpu-heavy' AND nodes > 0 AND runtime_minutes > 0 AND runtime_minutes < 1440 AND cost_usd >= 0 AND source <> '' AND machine_type <> 't3.medium'"


@query("k4_cleaning_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT({c}) AS count, round(AVG({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(MIN({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(MAX({c}), 6) AS max FROM {_CLEANED}""" for c in _NUMBERS))
def _(t):
    return rounded(reports.cleaned_dataset(t("raw_runs"))["profile"])


