"""Projections, scalar functions, filters and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.catalog.registry import query
from runledger.functions import labels, measures
from runledger.operators import cleaning, enrich, gaps, pareto, scoring
from runledger.plans import events as event_plans
from runledger.plans import model_dataset
from runledger.session import stage
from runledger.sources import payloads


@query("c1_iterated_scores", """
    SELECT session_id, round(sqrt(response_time_ms * payload_size + 1) + ln(1 + user_id % 1000), 6) AS score_0,
      round(sqrt(response_time_ms * payload_size + 8) + ln(1 + user_id % 1000), 6) AS score_7 FROM {event_log}
""")
def _(t):
    scored = event_plans.scored_events(t("event_log"), 8)
    return scored.select("session_id", F.round("score_0", 6).alias("score_0"), F.round("score_7", 6).alias("score_7"))


@query("c2_event_buckets", "SELECT user_id % 50000 AS join_key, CAST(floor(payload_size / 250.0) AS BIGINT) AS payload_bucket, COUNT(*) AS events FROM {event_log} GROUP BY 1, 2")
def _(t):
    return event_plans.bucketed_events(t("event_log")).groupBy("join_key", "payload_bucket").agg(F.count(F.lit(1)).alias("events"))


@query("c3_event_dates", "SELECT CAST(timestamp AS DATE) AS event_date, COUNT(*) AS events FROM {event_log} GROUP BY 1")
def _(t):
    return t("event_log").groupBy(F.to_date("timestamp").alias("event_date")).agg(F.count(F.lit(1)).alias("events"))


@query("c4_standard_text", "SELECT lower(trim(workload_type)) AS workload_type, lower(trim(machine_type)) AS machine_type, COUNT(*) AS rows FROM {raw_runs} GROUP BY 1, 2")
def _(t):
    return cleaning.standard_text(t("raw_runs")).groupBy("workload_type", "machine_type").agg(F.count(F.lit(1)).alias("rows"))


@query("c5_typed_numbers", """
    SELECT COUNT(dataset_size_mb) AS sizes, COUNT(nodes) AS node_rows, COUNT(runtime_minutes) AS runtimes, round(SUM(cost_usd), 4) AS cost
    FROM (SELECT dataset_size_mb, nodes, CASE WHEN machine_type = 't3.medium' THEN NULL ELSE runtime_minutes END AS runtime_minutes, cost_usd FROM {raw_runs})
""")
def _(t):
    text = t("raw_runs").select(
        F.col("dataset_size_mb").cast("string").alias("dataset_size_mb"), F.col("nodes").cast("double").cast("string").alias("nodes"),
        F.when(F.col("machine_type") == "t3.medium", "n/a").otherwise(F.col("runtime_minutes").cast("string")).alias("runtime_minutes"),
        F.col("cost_usd").cast("string").alias("cost_usd"),
    )
    return cleaning.typed_numbers(text).agg(
        F.count("dataset_size_mb").alias("sizes"), F.count("nodes").alias("node_rows"),
        F.count("runtime_minutes").alias("runtimes"), F.round(F.sum("cost_usd"), 4).alias("cost"),
    )


@query("c6_join_keys", "SELECT lower(trim(cloud)) AS cloud_key, lower(trim(region)) AS region_key, COUNT(*) AS runs FROM {runs} GROUP BY 1, 2")
def _(t):
    return enrich.with_join_keys(t("runs")).groupBy("cloud_key", "region_key").agg(F.count(F.lit(1)).alias("runs"))


@query("c7_zone_keys", """
    SELECT lower(trim(cloud)) AS cloud, replace(lower(trim(region)), ' ', '') AS region, upper(trim(lower(electricity_zone))) AS zone, COUNT(*) AS days
    FROM {readings} GROUP BY 1, 2, 3
""")
def _(t):
    return t("readings").groupBy(
        labels.key("cloud").alias("cloud"), labels.compact_region_key("region").alias("region"), labels.zone_key(F.lower("electricity_zone")).alias("zone")
    ).agg(F.count(F.lit(1)).alias("days"))


@query("c8_workload_labels", """
    SELECT Workload AS raw, CASE WHEN lower(trim(Workload)) IN ('cpu', 'memory', 'io') THEN lower(trim(Workload)) || '-heavy' ELSE lower(trim(Workload)) END AS label, COUNT(*) AS rows
    FROM (SELECT Workload FROM {vm_results} UNION ALL SELECT workload_type FROM {raw_runs}) GROUP BY 1, 2
""")
def _(t):
    both = t("vm_results").select(F.col("Workload").alias("raw")).unionAll(t("raw_runs").select("workload_type"))
    return both.groupBy("raw", labels.workload_label("raw").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


@query("c9_region_names", """
    SELECT region, CASE lower(trim(region)) WHEN 'centralindia' THEN 'Central India' WHEN 'southeastasia' THEN 'Southeast Asia' ELSE region END AS name, COUNT(*) AS rows
    FROM (SELECT upper(Region) AS region FROM {vm_results} UNION ALL SELECT region FROM {runs}) GROUP BY 1, 2
""")
def _(t):
    both = t("vm_results").select(F.upper("Region").alias("region")).unionAll(t("runs").select("region"))
    return both.groupBy("region", labels.region_name(F.col("region")).alias("name")).agg(F.count(F.lit(1)).alias("rows"))


@query("c10_legacy_names", """
    SELECT VM_Size AS machine_type, Dataset_Size_MB AS dataset_size_mb, round(SUM(Runtime_Minutes), 4) AS runtime_minutes, round(SUM(Cost_USD), 4) AS cost_usd FROM {vm_results} GROUP BY 1, 2
""")
def _(t):
    named = model_dataset.renamed(t("vm_results"), model_dataset.VM_NAMES)
    return named.groupBy("machine_type", "dataset_size_mb").agg(
        F.round(F.sum("runtime_minutes"), 4).alias("runtime_minutes"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    )


@query("c11_missing_columns", "SELECT electricity_zone, COUNT(*) AS rows, COUNT(cpu) AS cpu_rows FROM (SELECT 'unknown' AS electricity_zone, CAST(NULL AS DOUBLE) AS cpu FROM {runs}) GROUP BY 1")
def _(t):
    filled = cleaning.with_missing_columns(t("runs"), {"electricity_zone": "string", "cpu_avg_pct": "double"}, {"electricity_zone": "unknown"})
    return filled.groupBy("electricity_zone").agg(F.count(F.lit(1)).alias("rows"), F.count("cpu_avg_pct").alias("cpu_rows"))


@query("c12_utc_dates", "SELECT CASE WHEN l_tax = 0.05 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS run_date, COUNT(*) AS rows FROM lineitem GROUP BY 1")
def _(t):
    text = F.when(F.col("l_tax") == 0.05, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return t("lineitem").groupBy(cleaning.utc_date(text).alias("run_date")).agg(F.count(F.lit(1)).alias("rows"))


@query("c13_run_zones", """
    SELECT region, CASE lower(trim(region)) WHEN 'ap-south-1' THEN 'IN' WHEN 'ap-southeast-1' THEN 'SG' ELSE '' END AS zone, COUNT(*) AS rows
    FROM (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'ap-south-1' WHEN 1 THEN ' AP-Southeast-1' ELSE 'eu-west-1' END AS region FROM lineitem) GROUP BY 1, 2
""")
def _(t):
    region = t.sql("SELECT CASE l_suppkey % 3 WHEN 0 THEN 'ap-south-1' WHEN 1 THEN ' AP-Southeast-1' ELSE 'eu-west-1' END AS region FROM {lineitem}")
    return region.groupBy("region", labels.run_zone("region").alias("zone")).agg(F.count(F.lit(1)).alias("rows"))


@query("c14_run_cost", "SELECT cloud, region, round(SUM(hourly * nodes * (runtime_minutes / 60.0)), 3) AS cost FROM (SELECT *, 0.192 * CAST(nodes AS DOUBLE) AS hourly FROM {runs}) GROUP BY 1, 2")
def _(t):
    hourly = F.lit(0.192) * F.col("nodes")
    return t("runs").groupBy("cloud", "region").agg(F.round(F.sum(measures.run_cost(hourly, F.col("nodes"), F.col("runtime_minutes"), 12)), 3).alias("cost"))


@query("c15_elapsed_minutes", """
    SELECT l_linenumber, l_orderkey, l_partkey, l_suppkey, round(CASE WHEN l_partkey % 3 = 0 THEN greatest(l_orderkey * 1000 - l_suppkey, 0) ELSE l_partkey * 1000 + l_suppkey * 10 END / 60000.0, 6) AS service_minutes,
      round((l_partkey % 7200) / 60.0, 6) AS step_minutes FROM lineitem
""")
def _(t):
    third = F.col("l_partkey") % 3 == 0
    phase = F.when(third, F.lit(None)).otherwise(F.col("l_partkey") * 1000)
    setup = F.when(third, F.lit(0)).otherwise(F.col("l_suppkey") * 10)
    start = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    end = F.timestamp_seconds(F.unix_timestamp(start) + F.col("l_partkey") % 7200)
    return t("lineitem").select(
        "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey",
        measures.service_minutes(phase, setup, F.lit(None).cast("bigint"), F.col("l_suppkey"), F.col("l_orderkey") * 1000).alias("service_minutes"),
        measures.elapsed_minutes(start, end).alias("step_minutes"),
    )


@query("c16_emissions_proxy", "SELECT cloud, workload_type, round(SUM(runtime_minutes / 60.0 * carbon_intensity_mean), 3) AS emissions FROM {dataset} GROUP BY 1, 2")
def _(t):
    proxy = measures.emissions_proxy(F.col("runtime_minutes"), F.col("carbon_intensity_mean"))
    return t("dataset").groupBy("cloud", "workload_type").agg(F.round(F.sum(proxy), 3).alias("emissions"))


_POWERED = """(SELECT d.*, coalesce(w.power_w, v.vcpus * 12.0, 60.0) AS power_w,
    CASE WHEN w.power_w IS NOT NULL THEN w.source ELSE 'ESTIMATED from vCPU count' END AS power_source, w.power_w IS NULL AND v.vcpus IS NULL AS vcpus_unknown
    FROM {dataset} d LEFT JOIN {power} w ON d.machine_type = w.machine_type LEFT JOIN {vcpus} v ON d.machine_type = v.machine_type)"""


@query("c17_full_emissions", f"""
    SELECT cloud, machine_type, round(SUM(power_w * nodes / 1000.0 * (runtime_minutes / 60.0)), 4) AS energy_kwh,
      round(SUM(power_w * nodes / 1000.0 * (runtime_minutes / 60.0) * carbon_intensity_mean * CASE WHEN cloud = 'AWS' THEN CAST(1.15 AS DOUBLE) ELSE CAST(1.18 AS DOUBLE) END), 3) AS emissions
    FROM {_POWERED} GROUP BY 1, 2
""")
def _(t):
    runs = pareto.with_emissions(enrich.attach_power(t("dataset"), t("power"), t("vcpus")))
    return runs.groupBy("cloud", "machine_type").agg(F.round(F.sum("energy_kwh"), 4).alias("energy_kwh"), F.round(F.sum("emissions_gco2eq"), 3).alias("emissions"))


_MACHINES = """
    SELECT CASE p_size % 8 WHEN 0 THEN concat('Standard_D', CAST(p_size AS STRING), 's_v3') WHEN 1 THEN 'm5.large' WHEN 2 THEN 'c5.2xlarge'
      WHEN 3 THEN concat('d', CAST(p_size AS STRING), 'asv4') WHEN 4 THEN 'r5.8XLARGE' WHEN 5 THEN 'm5.metal' WHEN 6 THEN 'xlarge' ELSE lower(p_type) END AS machine_type
    FROM {part}
"""


@query("c18_vcpu_inference", f"""
    SELECT machine_type, CASE WHEN regexp_matches(lower(machine_type), '_?d([0-9]+)[a-z]*_?v[0-9]') THEN CAST(regexp_extract(lower(machine_type), '_?d([0-9]+)[a-z]*_?v[0-9]', 1) AS DOUBLE)
      WHEN lower(machine_type) LIKE '%.8xlarge' THEN 32.0 WHEN lower(machine_type) LIKE '%.4xlarge' THEN 16.0 WHEN lower(machine_type) LIKE '%.2xlarge' THEN 8.0
      WHEN lower(machine_type) LIKE '%.xlarge' THEN 4.0 WHEN lower(machine_type) LIKE '%.large' THEN 2.0 END AS vcpus, COUNT(*) AS parts
    FROM ({_MACHINES}) GROUP BY 1, 2
""")
def _(t):
    return t.sql(_MACHINES).groupBy("machine_type", labels.inferred_vcpus(F.col("machine_type")).alias("vcpus")).agg(F.count(F.lit(1)).alias("parts"))


@query("c19_power_sources", f"SELECT machine_type, power_w, power_source, vcpus_unknown, COUNT(*) AS runs FROM {_POWERED} GROUP BY 1, 2, 3, 4")
def _(t):
    return enrich.attach_power(t("dataset"), t("power"), t("vcpus")).groupBy("machine_type", "power_w", "power_source", "vcpus_unknown").agg(F.count(F.lit(1)).alias("runs"))


@query("c19_power_warnings", f"""
    SELECT machine_type, CASE WHEN power_source LIKE '%PLACEHOLDER%' THEN 'placeholder power' ELSE 'default power' END AS warning, COUNT(*) AS runs
    FROM {_POWERED} WHERE power_source LIKE '%PLACEHOLDER%' OR vcpus_unknown GROUP BY 1, 2
""")
def _(t):
    return enrich.power_warnings(enrich.attach_power(t("dataset"), t("power"), t("vcpus")))


_INSTANCES = """
    SELECT concat(p_type, '.', CAST(p_partkey AS STRING)) AS machine_type, CASE WHEN p_partkey % 2 = 0 THEN 'AWS' ELSE 'Azure' END AS provider,
      p_size AS vcpus, p_brand AS note, p_partkey % 2 AS odd FROM {part}
"""


@query("c20_power_table", f"""
    SELECT machine_type, vcpus, round(w * vcpus, 2) AS power_w, round(w, 4) AS watts_per_vcpu, microarchitecture, CAST(0.35 AS DOUBLE) AS utilisation_assumed,
      concat('Cloud Carbon Footprint coefficients (', provider, ', ', microarchitecture, ') at 35% vCPU utilisation; ', note) AS source
    FROM (SELECT i.*, CASE odd WHEN 0 THEN 'Sky Lake + Cascade Lake' ELSE 'Haswell' END AS microarchitecture,
      CASE odd WHEN 0 THEN ((0.6446044454253452 + CAST(0.35 AS DOUBLE) * (4.193436438541878 - 0.6446044454253452)) + (0.6389493581523519 + CAST(0.35 AS DOUBLE) * (3.9673047343937564 - 0.6389493581523519))) / 2
        ELSE 1.9005681818181814 + CAST(0.35 AS DOUBLE) * (6.012910353535353 - 1.9005681818181814) END AS w FROM ({_INSTANCES}) i)
""")
def _(t):
    architectures = F.when(F.col("odd") == 0, F.array(F.lit("Sky Lake"), F.lit("Cascade Lake"))).otherwise(F.array(F.lit("Haswell")))
    instances = t.sql(_INSTANCES).withColumn("architectures", architectures).drop("odd")
    return enrich.power_table(instances, enrich.watt_coefficients(t.spark), 0.35)


@query("c21_power_template", """
    SELECT m.machine_type, v.vcpus, round(coalesce(v.vcpus * 12.0, 60.0), 1) AS power_w, 'PLACEHOLDER - replace with Boavizta or Cloud Carbon Footprint figure' AS source
    FROM (SELECT DISTINCT machine_type FROM {dataset}) m LEFT JOIN {vcpus} v ON m.machine_type = v.machine_type
""")
def _(t):
    return enrich.power_template(t("dataset"), t("vcpus"))


@query("c22_clamped_predictions", "SELECT COUNT(*) AS rows, round(SUM(greatest(runtime_minutes - 2.5, CAST(0.01 AS DOUBLE))), 4) AS runtime, round(SUM(greatest(cost_usd - 0.05, CAST(0 AS DOUBLE))), 4) AS cost FROM {runs}")
def _(t):
    return t("runs").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(measures.clamped_runtime(F.col("runtime_minutes") - 2.5)), 4).alias("runtime"),
        F.round(F.sum(measures.clamped_cost(F.col("cost_usd") - 0.05)), 4).alias("cost"),
    )


_GOALS = """
    SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN ' Lowest-Cost' WHEN 1 THEN 'fastest runtime' WHEN 2 THEN 'CARBON' WHEN 3 THEN 'balance' WHEN 4 THEN 'lowest carbon ' ELSE 'Fastest' END AS goal FROM {orders}
"""


@query("c23_goal_names", f"""
    SELECT goal AS asked, CASE trim(lower(goal)) WHEN 'lowest-cost' THEN 'cost' WHEN 'fastest runtime' THEN 'runtime' WHEN 'carbon' THEN 'carbon' WHEN 'balance' THEN 'balanced' WHEN 'lowest carbon' THEN 'carbon' ELSE 'runtime' END AS goal, COUNT(*) AS requests
    FROM ({_GOALS}) GROUP BY 1, 2
""")
def _(t):
    return t.sql(_GOALS).select(F.col("goal").alias("asked"), labels.goal("goal").alias("goal")).groupBy("asked", "goal").agg(F.count(F.lit(1)).alias("requests"))


@query("c24_pricing_models", """
    SELECT tier, CASE WHEN lower(tier) IN ('on-demand', 'ondemand', 'consumption') THEN 'on-demand' WHEN lower(tier) IN ('spot', 'low priority', 'low-priority') THEN 'spot' ELSE lower(tier) END AS model,
      lower(tier) LIKE '%spot%' OR lower(tier) LIKE '%low priority%' AS matches_spot, COUNT(*) AS offers FROM {price_list} GROUP BY 1, 2, 3
""")
def _(t):
    return t("price_list").groupBy(
        "tier", labels.pricing_model("tier").alias("model"), labels.is_spot_meter(F.col("tier"), F.lit("Spot")).alias("matches_spot")
    ).agg(F.count(F.lit(1)).alias("offers"))


@query("c25_reasons", """
    SELECT goal, sla_runtime_minutes < 2.5 AS missed, concat(CASE WHEN sla_runtime_minutes < 2.5 THEN 'No configuration satisfied the SLA; ' ELSE '' END,
      CASE goal WHEN 'cost' THEN 'ranked by lowest predicted cost' WHEN 'runtime' THEN 'ranked by fastest predicted runtime'
        WHEN 'carbon' THEN 'ranked by lowest predicted emissions for this job and higher renewable percentage'
        ELSE 'ranked by best trade-off between runtime, cost, carbon, and renewable energy' END, '.') AS reason, COUNT(*) AS requests FROM {requests} GROUP BY 1, 2, 3
""")
def _(t):
    missed = F.col("sla_runtime_minutes") < 2.5
    return t("requests").groupBy("goal", missed.alias("missed"), labels.reason(F.col("goal"), missed).alias("reason")).agg(F.count(F.lit(1)).alias("requests"))


@query("c26_config_labels", "SELECT concat(cloud, ' ', region, ' ', machine_type, ' x', CAST(nodes AS STRING)) AS label, COUNT(*) AS runs FROM {runs} GROUP BY 1")
def _(t):
    label = labels.config_label(*[F.col(c) for c in fv.CONFIG])
    return t("runs").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("runs"))


@query("c28_group_keys", """
    SELECT k AS group_key, COUNT(*) AS runs, CAST(min(('0x' || substr(md5(k), 1, 8))::UBIGINT % 5 + 1) AS INT) AS fold
    FROM (SELECT concat_ws('|', cloud, region, CAST(CAST(dataset_size_mb AS INT) AS STRING), workload_type, machine_type, CAST(nodes AS STRING)) AS k FROM {runs}) GROUP BY 1
""")
def _(t):
    key = labels.group_key(*fv.GROUP)
    return t("runs").groupBy(key.alias("group_key")).agg(F.count(F.lit(1)).alias("runs")).withColumn("fold", labels.fold_of(F.col("group_key"), 5))


@query("c29_plan_labels", """
    SELECT DISTINCT region, dataset_size_mb, workload_type, machine_type, nodes, concat(CAST(dataset_size_mb AS STRING), 'mb') AS size_label, replace(workload_type, '-heavy', '') AS short_workload,
      replace(replace(replace(machine_type, '.', ''), '_', ''), '-', '') AS safe_instance, concat('s3://runs/data/events_', CAST(dataset_size_mb AS STRING), 'mb.csv') AS dataset_uri,
      concat('s3://runs/scripts/', replace(workload_type, '-', '_'), '.py') AS script_uri,
      concat('s3://runs/output/', region, '/', replace(workload_type, '-heavy', ''), '_', CAST(dataset_size_mb AS STRING), 'mb_', replace(replace(replace(machine_type, '.', ''), '_', ''), '-', ''), '_', CAST(nodes AS STRING)) AS output_uri
    FROM (SELECT region, dataset_size_mb, workload_type, concat('m_', machine_type, '.x-l') AS machine_type, nodes FROM {runs})
""")
def _(t):
    plan = t.sql("SELECT DISTINCT region, dataset_size_mb, workload_type, concat('m_', machine_type, '.x-l') AS machine_type, nodes FROM {runs}")
    return labels.plan_labels(plan, "s3://runs")


_SPECS = "VALUES " + ", ".join(f"('{s}', {v}, {r}, '{f}')" for s, v, r, f in fv.VM_SIZES)


@query("c30_vm_specs", f"""
    SELECT region, vm_size, coalesce(s.vcpus, 0) AS vcpus, coalesce(s.ram_gb, 0) AS ram_gb, coalesce(s.family, 'unknown') AS family, lower(replace(vm_size, 'Standard_', '')) AS size_code,
      CASE region WHEN 'centralindia' THEN 'cin' WHEN 'southeastasia' THEN 'sea' ELSE substr(replace(region, '-', ''), 1, 4) END AS region_code
    FROM (SELECT DISTINCT Region AS region, VM_Size AS vm_size FROM {{vm_results}} UNION SELECT DISTINCT 'eu-west-1', p_brand FROM part) c
    LEFT JOIN ({_SPECS}) s(size, vcpus, ram_gb, family) ON c.vm_size = s.size
""")
def _(t):
    sizes = t.sql("SELECT DISTINCT Region AS region, VM_Size AS vm_size FROM {vm_results} UNION SELECT DISTINCT 'eu-west-1', p_brand FROM {part}")
    return gaps.with_vm_specs(sizes, gaps.vm_specs(t.spark))


@query("c31_pareto_labels", "SELECT CASE WHEN runtime_minutes < 2.5 THEN 'Pareto optimal' ELSE 'Dominated' END AS front, COUNT(*) AS runs FROM {runs} GROUP BY 1")
def _(t):
    return t("runs").groupBy(labels.pareto_label(F.col("runtime_minutes") < 2.5).alias("front")).agg(F.count(F.lit(1)).alias("runs"))


@query("c32_failure_reasons", """
    SELECT reason, length(reason) AS characters, COUNT(*) AS documents FROM (SELECT substr(concat_ws(' | ', nullif(source, ''), CASE WHEN lang = 'en' THEN NULL ELSE lang END, nullif(text, '')), 1, 1500) AS reason FROM documents) GROUP BY 1, 2
""")
def _(t):
    reason = labels.joined_reason(F.col("source"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.col("text"))
    return t("documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("documents")).withColumn("characters", F.length("reason"))


@query("c32_job_states", """
    SELECT state, finished, succeeded, reason, COUNT(*) AS runs, round(SUM(minutes), 3) AS minutes FROM (
      SELECT CASE o_orderstatus WHEN 'F' THEN 'TERMINATED/SUCCESS' WHEN 'O' THEN 'TERMINATED/FAILED' ELSE 'RUNNING' END AS state, o_orderstatus <> 'P' AS finished, o_orderstatus = 'F' AS succeeded,
        CASE o_orderstatus WHEN 'F' THEN '{"life_cycle_state":"TERMINATED","result_state":"SUCCESS","state_message":""}' WHEN 'O' THEN o_orderpriority ELSE '{"life_cycle_state":"RUNNING"}' END AS reason,
        round(o_custkey * 100 / 60000.0, 6) AS minutes FROM orders) GROUP BY 1, 2, 3, 4
""")
def _(t):
    status, message = F.col("o_orderstatus"), F.col("o_orderpriority")
    state = (
        F.when(status == "F", F.lit('{"life_cycle_state":"TERMINATED","result_state":"SUCCESS","state_message":""}'))
        .when(status == "O", F.format_string('{"life_cycle_state":"TERMINATED","result_state":"FAILED","state_message":"%s"}', message))
        .otherwise(F.lit('{"life_cycle_state":"RUNNING"}'))
    )
    payload = F.format_string('{"state":%s,"execution_duration":%d,"setup_duration":0}', state, F.col("o_custkey") * 100)
    return payloads.job_runs(t("orders").select(payload.alias("payload"))).groupBy("state", "finished", "succeeded", "reason").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("runtime_minutes"), 3).alias("minutes")
    )


_RAW_COUNTS = ", ".join(f"COUNT(*) - COUNT({c}) AS {c}" for c in ("workload_type", "runtime_minutes", "cost_usd", "source", "cpu_avg_pct"))
_STANDARD = """(SELECT dataset_size_mb, lower(trim(workload_type)) AS workload_type, lower(trim(machine_type)) AS machine_type, nodes, runtime_minutes, cost_usd,
    lower(trim(source)) AS source, region, cloud, electricity_zone, cpu_avg_pct, memory_avg_pct FROM (SELECT DISTINCT * FROM {raw_runs}) WHERE workload_type IS NOT NULL AND runtime_minutes IS NOT NULL)"""
_VALID = """dataset_size_mb > 0 AND nodes > 0 AND runtime_minutes > 0 AND runtime_minutes < 1440 AND cost_usd >= 0 AND source <> ''
    AND workload_type IN ('cpu-heavy', 'memory-heavy', 'io-heavy', 'cpu_heavy', 'memory_heavy', 'io_heavy')
    AND machine_type IN ('c5.xlarge', 'c5a.xlarge', 'c6i.xlarge', 'm5a.xlarge', 'm6i.xlarge', 'r5.xlarge', 'm5.xlarge')"""


@query("d1_valid_runs", f"SELECT * FROM (SELECT dataset_size_mb, lower(trim(workload_type)) AS workload_type, lower(trim(machine_type)) AS machine_type, nodes, runtime_minutes, cost_usd, lower(trim(source)) AS source FROM {{raw_runs}}) WHERE {_VALID}")
def _(t):
    runs = cleaning.standard_text(t("raw_runs"))
    return cleaning.valid_runs(runs).select(*[F.col(c).cast("double") if c in ("cost_usd", "runtime_minutes") else F.col(c) for c in ("dataset_size_mb", "workload_type", "machine_type", "nodes", "runtime_minutes", "cost_usd", "source")])


@query("d1_rejects_by_rule", """
    SELECT r.rule, CAST(CASE r.rule WHEN 'size' THEN 0 WHEN 'nodes' THEN a.n WHEN 'runtime_low' THEN a.rl WHEN 'runtime_high' THEN a.rh WHEN 'cost' THEN a.c WHEN 'workload' THEN a.w WHEN 'machine' THEN a.m ELSE a.s END AS BIGINT) AS rejected
    FROM (SELECT unnest(['size', 'nodes', 'runtime_low', 'runtime_high', 'cost', 'workload', 'machine', 'source']) AS rule) r,
      (SELECT count_if(NOT nodes > 0) AS n, count_if(runtime_minutes IS NULL OR NOT runtime_minutes > 0) AS rl, count_if(runtime_minutes IS NULL OR NOT runtime_minutes < 1440) AS rh,
        count_if(NOT cost_usd >= 0) AS c, count_if(workload_type IS NULL OR lower(trim(workload_type)) = 'gpu-heavy') AS w, count_if(machine_type = 't3.medium') AS m, count_if(source = '') AS s FROM {raw_runs}) a
""")
def _(t):
    return cleaning.rejects_by_rule(cleaning.standard_text(t("raw_runs")))


@query("d2_successful_runs", "SELECT workload_type, COUNT(*) AS runs FROM {runs} WHERE exit_status = 'SUCCESS' GROUP BY 1")
def _(t):
    return cleaning.successful(t("runs")).groupBy("workload_type").agg(F.count(F.lit(1)).alias("runs"))


@query("d3_complete_cases", "SELECT machine_type, COUNT(*) AS rows FROM {raw_runs} WHERE workload_type IS NOT NULL AND runtime_minutes IS NOT NULL GROUP BY 1")
def _(t):
    return cleaning.complete_cases(t("raw_runs"), cleaning.REQUIRED).groupBy("machine_type").agg(F.count(F.lit(1)).alias("rows"))


@query("d4_sla_fallback", """
    SELECT request_id, COUNT(*) AS admitted, CAST(SUM(nodes) AS BIGINT) AS nodes, bool_or(no_sla_match) AS no_sla_match FROM (
      SELECT r.request_id, s.nodes, (r.sla_runtime_minutes IS NULL OR s.predicted_runtime_minutes <= r.sla_runtime_minutes) AS ok,
        NOT bool_or(r.sla_runtime_minutes IS NULL OR s.predicted_runtime_minutes <= r.sla_runtime_minutes) OVER (PARTITION BY r.request_id) AS no_sla_match
      FROM {requests} r JOIN {scored} s ON r.workload_type = s.workload_type) WHERE ok OR no_sla_match GROUP BY 1
""")
def _(t):
    """What an SLA admits is counted once for all requests that admit the same; a null SLA stays null."""
    scored = stage(t("scored"))
    placed = scoring.with_effective_sla(t("requests"), scored, ["workload_type"])
    limit = F.when(F.col("sla_runtime_minutes").isNotNull(), F.coalesce("effective_sla", F.lit(-1.0)))
    placed = stage(placed.select("request_id", "workload_type", limit.alias("sla_runtime_minutes")), "limits")
    admitted = scoring.within_sla(placed.select("workload_type", "sla_runtime_minutes").distinct().join(scored, "workload_type"), ["workload_type", "sla_runtime_minutes"])
    counted = admitted.groupBy(F.col("workload_type").alias("w"), F.col("sla_runtime_minutes").alias("s")).agg(F.count(F.lit(1)).alias("admitted"), F.sum("nodes").alias("nodes"), F.bool_or("no_sla_match").alias("no_sla_match"))
    same = (F.col("workload_type") == F.col("w")) & F.col("sla_runtime_minutes").eqNullSafe(F.col("s"))
    return placed.join(counted, same).select("request_id", "admitted", "nodes", "no_sla_match")


@query("d6_unknown_workloads", "SELECT COUNT(*) AS requests FROM {requests} q WHERE NOT EXISTS (SELECT 1 FROM {runs} r WHERE r.workload_type = q.workload_type AND r.workload_type <> 'io-heavy')")
def _(t):
    """One workload's runs have another name, so its requests are unknown."""
    renamed = F.when(F.col("workload_type") == "io-heavy", F.lit("io-other")).otherwise(F.col("workload_type"))
    return cleaning.unknown_workloads(t("requests"), t("runs").withColumn("workload_type", renamed)).agg(F.count(F.lit(1)).alias("requests"))


@query("d7_coarse_zones", "SELECT electricity_zone, COUNT(*) AS affected_rows, 'IN-WE' AS use_instead FROM {raw_runs} WHERE electricity_zone = 'IN' GROUP BY 1")
def _(t):
    return cleaning.coarse_zone_audit(t("raw_runs"))


@query("d7_zones_in_order", "SELECT electricity_zone, min(l) AS position FROM (SELECT substr(r_name, 1, 2) AS electricity_zone, n_nationkey AS l FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def _(t):
    zones = t.sql("SELECT substr(r_name, 1, 2) AS electricity_zone, n_nationkey AS position FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
    return cleaning.zones_in_order(zones)


_COMBOS = "SELECT DISTINCT Region AS region, VM_Size AS vm_size, Nodes AS nodes FROM {vm_results}"
_CAPS = "SELECT DISTINCT Region AS region, CASE WHEN VM_Size LIKE '%s_v3' THEN 'DSv3' ELSE 'DASv4' END AS family, 10 AS vcpu_cap FROM {vm_results} WHERE VM_Size NOT LIKE '%ds_v4'"


@query("d9_quota", f"""
    SELECT c.region, c.vm_size, c.nodes, s.family, s.vcpus * c.nodes AS needed_vcpus, coalesce(k.vcpu_cap, 0) AS vcpu_cap, s.vcpus * c.nodes <= coalesce(k.vcpu_cap, 0) AS fits,
      CASE WHEN s.vcpus * c.nodes > coalesce(k.vcpu_cap, 0) THEN 'SKIPPED' END AS status,
      CASE WHEN s.vcpus * c.nodes > coalesce(k.vcpu_cap, 0) THEN concat('needs ', s.vcpus * c.nodes, ' vCPU > ', s.family, ' cap ', coalesce(k.vcpu_cap, 0)) END AS note
    FROM ({_COMBOS}) c JOIN ({_SPECS}) s(size, vcpus, ram_gb, family) ON c.vm_size = s.size LEFT JOIN ({_CAPS}) k ON c.region = k.region AND s.family = k.family
""")
def _(t):
    return gaps.quota_check(t.sql(_COMBOS), gaps.vm_specs(t.spark), t.sql(_CAPS))


@query("f12_null_counts", f"SELECT {_RAW_COUNTS} FROM {{raw_runs}}")
def _(t):
    return cleaning.null_counts(t("raw_runs").select("workload_type", "runtime_minutes", "cost_usd", "source", "cpu_avg_pct"))


@query("f27_cleaning_report", f"""
    SELECT CAST(SUM(n) AS BIGINT) AS original_rows, CAST(SUM(n - 1) AS BIGINT) AS duplicates_removed, COUNT(*) - COUNT(CASE WHEN ok THEN 1 END) AS null_rows_removed,
      (SELECT COUNT(*) FROM {_STANDARD} WHERE {_VALID}) AS final_rows
    FROM (SELECT workload_type IS NOT NULL AND runtime_minutes IS NOT NULL AS ok, COUNT(*) AS n FROM {{raw_runs}} r GROUP BY r.*)
""".replace("r GROUP BY r.*", "GROUP BY dataset_size_mb, workload_type, machine_type, nodes, runtime_minutes, cost_usd, region, source, cloud, electricity_zone, cpu_avg_pct, memory_avg_pct"))
def _(t):
    return cleaning.cleaning_report(t("raw_runs"))


@query("i3_distinct_rows", "SELECT COUNT(*) AS rows, round(SUM(cost_usd), 3) AS cost FROM (SELECT DISTINCT * FROM {raw_runs})")
def _(t):
    return cleaning.distinct_rows(t("raw_runs")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("cost_usd"), 3).alias("cost"))


@query("k4_cleaned_runs", f"SELECT * FROM {_STANDARD} WHERE {_VALID}")
def _(t):
    return cleaning.cleaned_runs(t("raw_runs"))


@query("k4_unified_runs", f"SELECT DISTINCT * REPLACE (replace(workload_type, '_', '-') AS workload_type) FROM {_STANDARD} WHERE {_VALID}")
def _(t):
    return cleaning.cleaned_runs(t("raw_runs"), unify_workloads=True)
