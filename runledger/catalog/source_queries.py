"""Sources and sinks: files are written from the given tables and read back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger import schemas
from runledger.catalog.registry import query
from runledger.operators import gaps, profile, regression
from runledger.plans import events as event_plans
from runledger.session import new_path
from runledger.sources import generator, payloads, readers, sinks


@query("a1_event_reader", """
    SELECT f.form, CAST(COUNT(*) AS BIGINT) AS events, CAST(SUM(payload_size) AS BIGINT) AS payload,
      round(SUM(response_time_ms), 4) AS latency, MAX(user_id) AS last_user
    FROM {event_log}, (SELECT 'csv' AS form UNION ALL SELECT 'parquet') f GROUP BY 1
""")
def _(t):
    log = t("event_log")
    csv, parquet = new_path(t.spark, "events"), new_path(t.spark, "events") + ".parquet"
    sinks.write_csv(log.select(*schemas.EVENT.names), csv)
    sinks.write_parquet(log, parquet)
    both = readers.read_events(t.spark, csv).withColumn("form", F.lit("csv")).unionByName(
        readers.read_events(t.spark, parquet).withColumn("form", F.lit("parquet"))
    )
    return both.groupBy("form").agg(
        F.count(F.lit(1)).alias("events"), F.sum("payload_size").alias("payload"),
        F.round(F.sum("response_time_ms"), 4).alias("latency"), F.max("user_id").alias("last_user"),
    )


@query("a2_run_table_scan", """
    SELECT machine_type, COUNT(*) AS rows, COUNT(workload_type) AS labelled, COUNT(runtime_minutes) AS timed,
      round(SUM(cost_usd), 4) AS cost FROM {raw_runs} GROUP BY 1
""")
def _(t):
    path = new_path(t.spark, "runs")
    sinks.write_csv(t("raw_runs").select(*schemas.RUNS.names), path)
    return readers.read_runs(t.spark, path).groupBy("machine_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("workload_type").alias("labelled"),
        F.count("runtime_minutes").alias("timed"), F.round(F.sum("cost_usd"), 4).alias("cost"),
    )


@query("a3_malformed_lines", """
    SELECT CASE WHEN l_tax = 0.08 THEN 'rejected' WHEN l_tax = 0.07 THEN 'short' ELSE 'whole' END AS kind, COUNT(*) AS lines,
      CASE WHEN MIN(l_tax) < 0.065 THEN CAST(SUM(l_orderkey) AS DOUBLE) END AS total
    FROM lineitem GROUP BY 1
""")
def _(t):
    tail = F.when(F.col("l_tax") == 0.08, ",1,2").when(F.col("l_tax") == 0.07, "").otherwise(F.concat(F.lit(","), F.col("l_orderkey").cast("string")))
    path = new_path(t.spark, "lines")
    t("lineitem").select(F.concat(F.lit('"a, b"'), tail).alias("value")).write.text(path)
    schema = schemas.T.StructType().add("label", "string").add("number", "double")
    rows, rejected = readers.read_csv_split(t.spark, path, schema, header=False)
    kinds = rows.select(F.when(F.col("number").isNull(), "short").otherwise("whole").alias("kind"), "number").unionByName(
        rejected.select(F.lit("rejected").alias("kind"), F.lit(None).cast("double").alias("number"))
    )
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.sum("number").alias("total"))


def _dropped_files(t, folder=None):
    """Snapshot files in one sub-folder each, as the machines drop them."""
    folder = folder or new_path(t.spark, "drops")
    sinks.write_drops(t("snapshots"), folder)
    return folder


@query("a4_recursive_result_files", """
    SELECT VM_Size, COUNT(*) AS rows, round(SUM(Runtime_Minutes), 4) AS minutes, TRUE AS all_have_file
    FROM {snapshots} GROUP BY 1
""")
def _(t):
    rows = readers.read_result_drops(t.spark, _dropped_files(t))
    return rows.groupBy("VM_Size").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("Runtime_Minutes"), 4).alias("minutes"),
        F.every(F.endswith("source_file", F.lit(".csv"))).alias("all_have_file"),
    )


@query("a5_result_drop_table", """
    SELECT Region, Workload, Exit_Status, COUNT(*) AS rows, MAX(Timestamp) AS newest FROM {snapshots} GROUP BY 1, 2, 3
""")
def _(t):
    rows = readers.read_result_drops(t.spark, _dropped_files(t))
    return rows.groupBy("Region", "Workload", "Exit_Status").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("Timestamp").cast("timestamp_ntz")).alias("newest"))


def _zone_payloads(t):
    days = t.sql("""
        SELECT electricity_zone AS zone, reading_date, MAX(carbon_intensity) AS intensity,
          MAX(renewable_percentage) AS renewable FROM {readings} GROUP BY 1, 2
    """)
    entry = F.struct(
        F.col("reading_date").cast("string").alias("datetime"), F.col("intensity").alias("carbonIntensity"), F.col("renewable").alias("value"),
        F.lit("%").alias("unit"), F.lit(False).alias("isEstimated"),
    )
    monthly = days.groupBy("zone", F.trunc("reading_date", "month").alias("month")).agg(F.collect_list(entry).alias("data"))
    return monthly.select(F.to_json(F.struct("zone", "data")).alias("payload"))


def _mapping(t):
    return t("readings").select("cloud", "region", "electricity_zone").distinct()


_DAYS = """
    SELECT CAST(d.reading_date AS VARCHAR) AS Date, m.cloud AS Cloud, m.region AS Region, d.electricity_zone AS Electricity_Zone, d.v AS {name}
    FROM (SELECT electricity_zone, reading_date, MAX({column}) AS v FROM {{readings}} GROUP BY 1, 2) d
    JOIN (SELECT DISTINCT cloud, region, electricity_zone FROM {{readings}}) m ON d.electricity_zone = m.electricity_zone
"""


@query("a6_carbon_payloads", _DAYS.format(name="Carbon_Intensity_gCO2eq_per_kWh", column="carbon_intensity"))
def _(t):
    days = payloads.daily_from_payloads(_zone_payloads(t), _mapping(t), "carbon")
    return days.select("Date", "Cloud", "Region", "Electricity_Zone", "Carbon_Intensity_gCO2eq_per_kWh")


@query("a6_renewable_payloads", _DAYS.format(name="Renewable_Percentage", column="renewable_percentage"))
def _(t):
    days = payloads.daily_from_payloads(_zone_payloads(t), _mapping(t), "renewable")
    return days.select("Date", "Cloud", "Region", "Electricity_Zone", "Renewable_Percentage")


def _part_payload(t, template, *cols):
    return t("part").select(
        F.concat(F.lit("region-"), (F.col("p_partkey") % 5).cast("string")).alias("region"),
        F.concat(F.col("p_type"), F.lit("."), F.col("p_partkey").cast("string")).alias("machine_type"),
        F.col("p_size").alias("vcpus"),
        F.format_string(template, *cols).alias("payload"),
    )


_PART_KEYS = "concat('region-', CAST(p_partkey % 5 AS STRING)) AS region, concat(p_type, '.', CAST(p_partkey AS STRING)) AS machine_type, p_size AS vcpus"


@query("a7_on_demand_payloads", f"""
    SELECT {_PART_KEYS}, '' AS availability_zone, 'on-demand' AS tier, p_retailprice AS price_usd_hr FROM part WHERE p_size % 7 <> 0
""")
def _(t):
    template = '{"terms":{"OnDemand":{%s}}}'
    term = F.when(F.col("p_size") % 7 != 0, F.format_string(
        '"t1":{"priceDimensions":{"d1":{"pricePerUnit":{"USD":"%s"}},"d2":{"pricePerUnit":{"USD":"0"}}}}', F.col("p_retailprice").cast("string")
    )).otherwise("")
    return payloads.on_demand_prices(_part_payload(t, template, term))


@query("a7_spot_payloads", f"""
    SELECT {_PART_KEYS}, z.az AS availability_zone, 'spot' AS tier, CASE z.az WHEN 'a' THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS price_usd_hr
    FROM part, (SELECT 'a' AS az UNION ALL SELECT 'b') z
""")
def _(t):
    template = (
        '{"SpotPriceHistory":[{"AvailabilityZone":"a","SpotPrice":"%s"},{"AvailabilityZone":"b","SpotPrice":"%s"},'
        '{"AvailabilityZone":"a","SpotPrice":"0.001"}]}'
    )
    return payloads.spot_prices(_part_payload(t, template, F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")))


def _retail(t):
    template = (
        '{"Items":[{"meterName":"%s","productName":"Virtual Machines","retailPrice":%s},'
        '{"meterName":"%s Spot","productName":"Virtual Machines","retailPrice":%s},'
        '{"meterName":"%s","productName":"Virtual Machines Windows","retailPrice":9.0}]}'
    )
    price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
    return payloads.retail_prices(_part_payload(t, template, "p_brand", price, "p_brand", size, "p_brand"))


@query("a7_retail_payloads", f"""
    SELECT {_PART_KEYS}, p_brand AS tier, p_retailprice AS price_usd_hr FROM part
    UNION ALL SELECT {_PART_KEYS}, concat(p_brand, ' Spot'), CAST(p_size AS DOUBLE) FROM part
""")
def _(t):
    return _retail(t)


def _drifted_retail(t):
    """Retail payloads of which some changed: no JSON, another name of the array, a price that is missing, null or a word, a new field."""
    entry = '{"meterName":"%s","productName":"Virtual Machines"%s}'
    price = F.col("p_retailprice").cast("string")
    rest = (
        F.when(F.col("p_partkey") % 11 == 1, "").when(F.col("p_partkey") % 11 == 2, ',"retailPrice":"n/a"')
        .when(F.col("p_partkey") % 11 == 3, ',"retailPrice":null').when(F.col("p_partkey") % 11 == 4, F.format_string(',"retailPrice":%s,"unit":{"per":"hour"}', price))
        .otherwise(F.format_string(',"retailPrice":%s', price))
    )
    array = F.when(F.col("p_partkey") % 11 == 5, "items").otherwise("Items")
    text = F.format_string('{"%s":[{"meterName":"first","productName":"Virtual Machines","retailPrice":1.5},' + entry + "]}", array, "p_brand", rest)
    return _part_payload(t, "%s", F.when(F.col("p_partkey") % 11 == 0, "<html>busy</html>").otherwise(text))


@query("a7_quarantined_payloads", f"""
    SELECT {_PART_KEYS}, CASE WHEN p_partkey % 11 IN (1, 2, 3) THEN 1 END AS position,
      CASE p_partkey % 11 WHEN 0 THEN '$' WHEN 5 THEN '$.Items' ELSE '$.retailPrice' END AS path,
      CASE p_partkey % 11 WHEN 0 THEN 'not JSON' WHEN 2 THEN 'wrong type' WHEN 3 THEN 'null' ELSE 'missing' END AS reason
    FROM part WHERE p_partkey % 11 IN (0, 1, 2, 3, 5)
""")
def _(t):
    return payloads.quarantined(_drifted_retail(t), "retail").drop("payload")


@query("a7_drifted_payloads", f"""
    SELECT {_PART_KEYS}, 'first' AS tier, CAST(1.5 AS DOUBLE) AS price_usd_hr FROM part WHERE p_partkey % 11 NOT IN (0, 5)
    UNION ALL SELECT {_PART_KEYS}, p_brand, CASE WHEN p_partkey % 11 NOT IN (1, 2, 3) THEN p_retailprice END FROM part WHERE p_partkey % 11 NOT IN (0, 5)
""")
def _(t):
    return payloads.retail_prices(_drifted_retail(t))


@query("a7_unknown_fields", """
    SELECT '$.unit' AS path, COUNT(*) AS entries, 'OBJECT<per: STRING>' AS types FROM part WHERE p_partkey % 11 = 4 HAVING COUNT(*) > 0
""")
def _(t):
    return payloads.unknown_fields(_drifted_retail(t), "retail")


@query("a6_quarantined_payloads", """
    SELECT electricity_zone AS zone, CASE WHEN day(reading_date) = 13 THEN 'missing' ELSE 'wrong type' END AS reason, '$.carbonIntensity' AS path, COUNT(DISTINCT reading_date) AS entries
    FROM {readings} WHERE day(reading_date) IN (13, 14) GROUP BY 1, 2
""")
def _(t):
    """Days without an intensity, and days whose intensity became an object."""
    number = r'"datetime":"(\d{4}-\d\d-%s)","carbonIntensity":[^,}]*'
    drifted = _zone_payloads(t).select(
        F.regexp_replace(F.regexp_replace("payload", number % "13", '"datetime":"$1"'), number % "14", '"datetime":"$1","carbonIntensity":{"lca":1.0}').alias("payload")
    )
    faults = payloads.quarantined(drifted, "carbon")
    return faults.groupBy(F.get_json_object("payload", "$.zone").alias("zone"), "reason", "path").agg(F.count(F.lit(1)).alias("entries"))


@query("d8_price_exclusion", f"SELECT {_PART_KEYS}, p_brand AS tier, p_retailprice AS price_usd_hr FROM part")
def _(t):
    return payloads.without_spot_meters(_retail(t))


@query("a8_lookup_tables", "SELECT machine_type, power_w, 'unspecified' AS source FROM {power}")
def _(t):
    path = new_path(t.spark, "power")
    sinks.write_report_csv(t("power").drop("source"), path)
    return readers.read_lookup(t.spark, path, schemas.POWER, ["machine_type", "power_w"])


@query("a9_generated_events", """
    SELECT COUNT(*) AS events, CAST(0 AS BIGINT) AS out_of_bounds, TRUE AS purchases_near_share, TRUE AS errors_near_share FROM orders
""")
def _(t):
    made = generator.generate_events(t("orders").select("o_orderkey"))
    ok = (
        F.col("payload_size").between(80, 5000) & F.col("response_time_ms").between(5, 2500) & (F.col("amount_usd") >= 0)
        & F.col("user_id").between(1000, 1_999_999) & F.col("region").isin(fv.EVENT_REGIONS)
        & F.col("event_type").isin(fv.EVENT_TYPES) & F.col("device_type").isin(fv.DEVICE_TYPES)
        & ((F.col("error_code") == 0) | F.col("error_code").between(400, 598))
        & F.to_date("timestamp").between("2026-01-01", "2026-01-30")
    )
    share = F.avg((F.col("amount_usd") > 0).cast("int"))
    errors = F.avg((F.col("error_code") > 0).cast("int"))
    return made.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("out_of_bounds"),
        share.between(0.11, 0.19).alias("purchases_near_share"), errors.between(0.02, 0.06).alias("errors_near_share"),
    )


@query("a10_snapshot_compaction", """
    SELECT Region, VM_Size, Workload, COUNT(*) AS runs, round(SUM(Runtime_Minutes), 4) AS minutes
    FROM (SELECT DISTINCT * FROM {vm_results}) GROUP BY 1, 2, 3
""")
def _(t):
    compact = readers.compact_snapshots(t("snapshots"))
    return compact.groupBy("Region", "VM_Size", "Workload").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("Runtime_Minutes"), 4).alias("minutes"))


@query("a10_latest_runs", """
    SELECT Region, VM_Size, Nodes, Dataset_Size_MB, Workload, Run_Number, max(Timestamp) AS newest, COUNT(*) OVER () AS runs,
      arg_max(source_file, (Timestamp, source_file)) AS file
    FROM {snapshots} GROUP BY 1, 2, 3, 4, 5, 6
""")
def _(t):
    latest = readers.latest_runs(t("snapshots"))
    total = latest.agg(F.count(F.lit(1))).scalar()
    return latest.select(
        *readers.VM_RUN_KEY, F.col("Timestamp").cast("timestamp_ntz").alias("newest"), total.alias("runs"), F.col("source_file").alias("file")
    )


@query("b1_parquet_overwrite", """
    SELECT region, event_type, COUNT(*) AS events, round(AVG(response_time_ms), 6) AS avg_response_ms FROM {event_log} GROUP BY 1, 2
""")
def _(t):
    path = new_path(t.spark, "scores")
    for _ in range(2):  # the second write replaces the first
        sinks.write_parquet(event_plans.event_scores(t("event_log")), path)
    return t.spark.read.parquet(path).select("region", "event_type", "events", F.round("avg_response_ms", 6).alias("avg_response_ms"))


@query("b2_region_partitions", """
    SELECT region, COUNT(*) AS events, CAST(SUM(payload_size) AS BIGINT) AS bytes, MIN(timestamp) AS first_event FROM {event_log} GROUP BY 1
""")
def _(t):
    back = sinks.write_by_region(t("event_log"), new_path(t.spark, "by-region"))
    return back.groupBy("region").agg(
        F.count(F.lit(1)).alias("events"), F.sum("payload_size").alias("bytes"), F.min(F.col("timestamp").cast("timestamp_ntz")).alias("first_event")
    )


_GROUPED = """
    SELECT dataset_size_mb, workload_type, machine_type, nodes, round(AVG(runtime_minutes), 9) AS runtime_mean,
      round(AVG(cost_usd), 9) AS cost_mean, COUNT(runtime_minutes) AS runs FROM {dataset} GROUP BY 1, 2, 3, 4
"""


@query("b3_report_csv", _GROUPED)
def _(t):
    table = profile.grouped_summary(t("dataset"))
    path = new_path(t.spark, "report")
    sinks.write_report_csv(table, path)
    return readers.read_csv(t.spark, path, table.schema)


@query("b4_append_rows", """
    SELECT machine_type, 2 * COUNT(*) AS rows, round(2 * SUM(runtime_minutes), 4) AS minutes FROM {raw_runs} GROUP BY 1
""")
def _(t):
    path = new_path(t.spark, "appended")
    runs = t("raw_runs").select(*[F.col(f.name).cast(f.dataType) for f in schemas.RUNS.fields])
    for _ in range(2):
        sinks.append_rows(runs, path, schemas.RUNS)
    return t.spark.read.schema(schemas.RUNS).parquet(path).groupBy("machine_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("runtime_minutes"), 4).alias("minutes")
    )


@query("b5_records_export", """
    SELECT f.form, goal, COUNT(*) AS requests, round(SUM(sla_runtime_minutes), 4) AS sla
    FROM {requests}, (SELECT 'csv' AS form UNION ALL SELECT 'json') f GROUP BY 1, 2
""")
def _(t):
    requests = t("requests")
    columns = requests.select("goal", "request_id", F.col("sla_runtime_minutes").cast("double"))
    forms = []
    for form in ("csv", "json"):
        path = new_path(t.spark, "records")
        sinks.write_records(columns, path, form, by=["goal"])
        reader = t.spark.read.option("header", True).schema("request_id bigint, sla_runtime_minutes double, goal string")
        forms.append((reader.csv(path) if form == "csv" else reader.json(path)).withColumn("form", F.lit(form)))
    return forms[0].unionByName(forms[1]).groupBy("form", "goal").agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.sum("sla_runtime_minutes"), 4).alias("sla")
    )


@query("b6_summary_document", """
    SELECT COUNT(*) AS rows, COUNT(DISTINCT machine_type) AS machines, min(machine_type) AS first_machine,
      round(AVG(runtime_minutes), 4) AS runtime_mean, round(MAX(cost_usd), 6) AS cost_max FROM {dataset}
""")
def _(t):
    summary = profile.dataset_summary(t("dataset"))
    path = new_path(t.spark, "summary")
    sinks.write_summary(summary, path)
    return t.spark.read.schema(summary.schema).json(path).select(
        "rows", F.size("machine_types").cast("bigint").alias("machines"), F.get("machine_types", F.lit(0)).alias("first_machine"),
        F.col("runtime_minutes.mean").alias("runtime_mean"), F.col("cost_usd.max").alias("cost_max"),
    )


@query("b7_model_save_and_load", """
    SELECT workload_type, COUNT(*) AS cells, CAST(0.0 AS DOUBLE) AS largest_change
    FROM (SELECT DISTINCT cloud, region, electricity_zone, dataset_size_mb, workload_type, machine_type, nodes FROM {dataset}) GROUP BY 1
""")
def _(t):
    rows = regression.model_rows(t("dataset"))
    models = regression.fit(regression.training_cells(rows), "decision_tree")
    path = new_path(t.spark, "model")
    regression.save(models, path)
    cells = rows.select(*fv.FEATURES).distinct()
    before = regression.predict(models, cells)
    after = regression.predict(regression.load(path), cells).withColumnRenamed("predicted_runtime_minutes", "_again").drop("predicted_cost_usd")
    change = F.abs(F.col("predicted_runtime_minutes") - F.col("_again"))
    return before.join(after, fv.FEATURES).groupBy("workload_type").agg(F.count(F.lit(1)).alias("cells"), F.max(change).alias("largest_change"))


def _audited(t, success_wins=False):
    results = t.sql("""
        SELECT Region AS region, VM_Size AS vm_size, Nodes AS nodes, Dataset_Size_MB AS dataset_size_mb, Workload AS workload,
          Run_Number AS run_number, Timestamp AS timestamp, Exit_Status AS exit_status FROM {vm_results}
    """)
    return gaps.word_runs(gaps.audited_words(campaign(t), results, t.sql(COMBO_STATUS), success_wins))


COMBO_STATUS = """
    SELECT DISTINCT Region AS region, VM_Size AS vm_size, Nodes AS nodes, CASE WHEN VM_Size = 'Standard_D4s_v3' THEN 'SKIPPED'
      WHEN VM_Size = 'Standard_D2as_v4' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
      CASE WHEN VM_Size = 'Standard_D4s_v3' THEN 'needs 16 vCPU' ELSE NULL END AS note
    FROM {vm_results} WHERE Nodes = 4
"""


def campaign(t):
    """One campaign over all regions, sizes and workloads seen in the results, 45 repetitions."""
    def seen(name, to):
        return F.sort_array(F.collect_set(name)).alias(to)

    return t("vm_results").agg(
        seen("Region", "regions"), seen("VM_Size", "vm_sizes"), seen("Nodes", "node_counts"),
        seen("Dataset_Size_MB", "dataset_sizes"), seen("Workload", "workloads"), F.lit(45).alias("repetitions"),
    )


AUDIT = f"""
    SELECT e.*, coalesce(a.status = 'SUCCESS', FALSE) AS passed,
      CASE WHEN coalesce(a.status = 'SUCCESS', FALSE) THEN NULL WHEN c.status IS NOT NULL THEN c.status || ': ' || coalesce(c.note, '')
        WHEN a.status = 'FAILED' THEN 'run FAILED' ELSE 'never ran / missing' END AS reason,
      NOT coalesce(a.status = 'SUCCESS', FALSE) AND coalesce(c.status, '') <> 'SKIPPED' AS retry
    FROM (SELECT r.region, v.vm_size, n.nodes, d.dataset_size_mb, w.workload, CAST(i.run_number AS INT) AS run_number
          FROM (SELECT DISTINCT Region AS region FROM {{vm_results}}) r, (SELECT DISTINCT VM_Size AS vm_size FROM {{vm_results}}) v,
            (SELECT DISTINCT Nodes AS nodes FROM {{vm_results}}) n, (SELECT DISTINCT Dataset_Size_MB AS dataset_size_mb FROM {{vm_results}}) d,
            (SELECT DISTINCT Workload AS workload FROM {{vm_results}}) w, (SELECT unnest(range(1, 46)) AS run_number) i) e
    LEFT JOIN (SELECT Region, VM_Size, Nodes, Dataset_Size_MB, Workload, Run_Number, PICK AS status FROM {{vm_results}} GROUP BY 1, 2, 3, 4, 5, 6) a
      ON e.region = a.Region AND e.vm_size = a.VM_Size AND e.nodes = a.Nodes AND e.dataset_size_mb = a.Dataset_Size_MB AND e.workload = a.Workload AND e.run_number = a.Run_Number
    LEFT JOIN (SELECT * FROM ({COMBO_STATUS}) WHERE status <> 'SUCCESS') c ON e.region = c.region AND e.vm_size = c.vm_size AND e.nodes = c.nodes
"""
LAST_STATUS = "arg_max(Exit_Status, (Timestamp, Exit_Status))"


@query("b8_retry_lists", f"""
    SELECT region, vm_size, nodes, COUNT(*) AS runs, CAST(SUM(dataset_size_mb) AS BIGINT) AS megabytes
    FROM ({AUDIT.replace('PICK', LAST_STATUS)}) WHERE retry GROUP BY 1, 2, 3
""")
def _(t):
    path = new_path(t.spark, "retry")
    sinks.write_retry_lists(_audited(t), path)
    schema = schemas.T.StructType([*schemas.RETRY_LIST.fields, *schemas.COMBO_STATUS.fields[:3]])
    return t.spark.read.schema(schema).option("header", True).csv(path).groupBy("region", "vm_size", "nodes").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("Dataset_Size_MB").alias("megabytes")
    )


@query("b9_job_metric", "SELECT 'cpu-heavy' AS workload, COUNT(*) AS rows, TRUE AS timed FROM (SELECT DISTINCT region, event_type FROM {event_log})")
def _(t):
    path = new_path(t.spark, "measured")
    metric = sinks.write_measured(event_plans.event_scores(t("event_log")), path, "cpu-heavy", t.folder)
    return metric.select("workload", "rows", (F.col("runtime_seconds") > 0).alias("timed"))


@query("k1_k2_k3_jobs", """
    SELECT 'cpu-heavy' AS workload, COUNT(*) AS rows, TRUE AS same_rows FROM (SELECT DISTINCT region, event_type FROM {event_log})
    UNION ALL SELECT 'memory-heavy', COUNT(*), TRUE FROM (SELECT DISTINCT region, event_type, CAST(floor(payload_size / 250) AS BIGINT) FROM {event_log})
    UNION ALL SELECT 'io-heavy', COUNT(*), TRUE FROM (SELECT DISTINCT region, CAST(timestamp AS DATE) FROM {event_log})
""")
def _(t):
    """The three workloads read from a file, written, and their metric rows read back with what was written."""
    log, metrics = f"{new_path(t.spark, 'events')}.parquet", new_path(t.spark, "metrics")
    t("event_log").write.parquet(log)
    written = None
    for workload in ("cpu-heavy", "memory-heavy", "io-heavy"):
        path = new_path(t.spark, workload)
        event_plans.run_workload(t.spark, workload, log, path, metrics)
        rows = t.spark.read.parquet(path).agg(F.lit(workload).alias("workload"), F.count(F.lit(1)).alias("stored"))
        written = rows if written is None else written.unionByName(rows)
    recorded = t.spark.read.schema(schemas.METRIC).json(metrics)
    return recorded.join(written, "workload").select("workload", "rows", (F.col("rows") == F.col("stored")).alias("same_rows"))


@query("e10_run_matrix_audit", AUDIT.replace("PICK", LAST_STATUS))
def _(t):
    return _audited(t)


@query("e10_run_matrix_success_wins", AUDIT.replace(
    "PICK", "CASE WHEN bool_or(Exit_Status = 'SUCCESS') THEN 'SUCCESS' ELSE 'FAILED' END"
))
def _(t):
    return _audited(t, success_wins=True)


