"""Engine-shaped tables derived from the given star schema.

Each is one SELECT that Spark and the checking database both run; names in
braces are given tables or other entries. They only shape inputs: no operator
of the library is written here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.session import new_path, stage

_SIZE = (
    "CASE {c} WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 500 WHEN 4 THEN 1024 "
    "WHEN 5 THEN 2048 WHEN 6 THEN 3072 ELSE 5120 END"
)

STANDINS = {
    # One run per line item.
    "runs": f"""
        SELECT CASE WHEN l.l_linestatus = 'O' THEN 'AWS' ELSE 'Azure' END AS cloud, r.r_name AS region,
          p.p_type AS machine_type, CAST(2 + 2 * (CAST(l.l_quantity AS INT) % 2) AS INT) AS nodes,
          CASE l.l_returnflag WHEN 'A' THEN 'cpu-heavy' WHEN 'N' THEN 'io-heavy' ELSE 'memory-heavy' END AS workload_type,
          {_SIZE.format(c='l.l_linenumber')} AS dataset_size_mb,
          l.l_quantity / 10.0 AS runtime_minutes, l.l_extendedprice / 1000000.0 AS cost_usd,
          CAST(l.l_shipdate AS DATE) AS run_date,
          CASE WHEN l.l_discount > 0.095 THEN 'FAILED' ELSE 'SUCCESS' END AS exit_status
        FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey
          JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
          JOIN {{part}} p ON l.l_partkey = p.p_partkey
    """,
    # One reading per cloud, region and order date.
    "readings": """
        SELECT CASE WHEN o.o_orderkey % 2 = 0 THEN 'AWS' ELSE 'Azure' END AS cloud, r.r_name AS region,
          substr(r.r_name, 1, 2) AS electricity_zone, CAST(o.o_orderdate AS DATE) AS reading_date,
          round(AVG(o.o_totalprice) / 1000.0, 10) AS carbon_intensity,
          round(100.0 * AVG(CASE WHEN o.o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END), 10) AS renewable_percentage
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
          JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
        GROUP BY 1, 2, 3, 4
    """,
    "daily": """
        SELECT lower(cloud) AS cloud_key, lower(region) AS region_key, electricity_zone, reading_date,
          carbon_intensity, renewable_percentage FROM {readings}
    """,
    "carbon_daily": """
        SELECT CAST(reading_date AS STRING) AS Date, cloud AS Cloud, region AS Region, electricity_zone AS Electricity_Zone,
          carbon_intensity AS Carbon_Intensity_gCO2eq_per_kWh FROM {readings}
    """,
    "renewable_daily": """
        SELECT CAST(reading_date AS STRING) AS Date, cloud AS Cloud, region AS Region, electricity_zone AS Electricity_Zone,
          renewable_percentage AS Renewable_Percentage FROM {readings} WHERE renewable_percentage < 99.0
    """,
    "features": """
        SELECT lower(cloud) AS cloud_key, lower(region) AS region_key, electricity_zone,
          round(AVG(carbon_intensity), 9) AS carbon_intensity_mean, round(AVG(renewable_percentage), 9) AS renewable_percentage_mean
        FROM {readings} GROUP BY 1, 2, 3
    """,
    # Successful runs with regional carbon features: the modelling dataset.
    "dataset": """
        SELECT r.cloud, r.region, f.electricity_zone, CAST(r.dataset_size_mb AS DOUBLE) AS dataset_size_mb, r.workload_type,
          r.machine_type, r.nodes, r.runtime_minutes, r.cost_usd, f.carbon_intensity_mean, f.renewable_percentage_mean
        FROM {runs} r JOIN {features} f ON lower(r.cloud) = f.cloud_key AND lower(r.region) = f.region_key
        WHERE r.exit_status = 'SUCCESS'
    """,
    # Power of the part types; LARGE has only a vCPU count and PROMO nothing.
    "power": """
        SELECT p_type AS machine_type, round(5.0 + AVG(p_size), 2) AS power_w,
          CASE WHEN p_type = 'SMALL' THEN 'PLACEHOLDER' ELSE 'measured' END AS source
        FROM {part} WHERE p_type NOT IN ('PROMO', 'LARGE') GROUP BY p_type
    """,
    "vcpus": """
        SELECT p_type AS machine_type, CAST(MIN(p_size) + 3 AS DOUBLE) AS vcpus FROM {part} WHERE p_type <> 'PROMO' GROUP BY p_type
    """,
    "event_log": """
        SELECT CAST(ts AS TIMESTAMP) AS timestamp, user_id, event_id AS session_id,
          concat('region-', CAST(user_id % 5 AS STRING)) AS region, event_type, 'web' AS device_type,
          value AS response_time_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 50 AS payload_size,
          CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS amount_usd,
          CASE WHEN event_type = 'error' THEN 500 ELSE 0 END AS error_code
        FROM {events}
    """,
    # Uncleaned runs: copies, nulls, padded labels, values out of range.
    "raw_runs": f"""
        SELECT CAST({_SIZE.format(c='l_linenumber')} AS DOUBLE) AS dataset_size_mb,
          CASE WHEN l_discount = 0.05 THEN NULL WHEN l_returnflag = 'A' THEN ' CPU-heavy ' WHEN l_returnflag = 'N' THEN 'io_heavy'
            WHEN l_tax = 0.01 THEN 'gpu-heavy' ELSE 'memory-heavy' END AS workload_type,
          CASE l_partkey % 5 WHEN 0 THEN 'm5.xlarge' WHEN 1 THEN 'M5.xlarge' WHEN 2 THEN 'c5.xlarge' WHEN 3 THEN 'r5.xlarge'
            ELSE 't3.medium' END AS machine_type,
          CAST(CAST(l_quantity AS INT) % 5 AS INT) AS nodes,
          CASE WHEN l_quantity = 50 THEN 1500.0 WHEN l_quantity = 49 THEN NULL ELSE CAST(CAST(l_quantity AS INT) % 7 AS DOUBLE) END AS runtime_minutes,
          CASE WHEN l_tax = 0.02 THEN -0.5 ELSE CAST(CAST(l_quantity AS INT) % 3 AS DOUBLE) / 4.0 END AS cost_usd,
          'ap-south-1' AS region,
          CASE WHEN l_tax = 0.03 THEN '' ELSE 'aws-emr:ap-south-1:j' END AS source,
          'aws' AS cloud, CASE WHEN l_suppkey % 2 = 0 THEN 'IN' ELSE 'SG' END AS electricity_zone,
          CAST(NULL AS DOUBLE) AS cpu_avg_pct, CAST(NULL AS DOUBLE) AS memory_avg_pct
        FROM {{lineitem}}
    """,
    # Raw VM result rows.
    "vm_results": f"""
        SELECT CASE WHEN s.s_nationkey % 2 = 0 THEN 'centralindia' ELSE 'southeastasia' END AS Region,
          CASE p.p_size % 4 WHEN 0 THEN 'Standard_D2s_v3' WHEN 1 THEN 'Standard_D4s_v3' WHEN 2 THEN 'Standard_D2as_v4' ELSE 'Standard_D4ds_v4' END AS VM_Size,
          CASE p.p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 4 END AS vCPU,
          CASE p.p_size % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 8 ELSE 16 END AS RAM_GB,
          CAST(2 + 2 * (CAST(l.l_quantity AS INT) % 2) AS INT) AS Nodes, '3.5.1' AS Spark_Version, '17' AS Java_Version,
          concat(CAST({_SIZE.format(c='l.l_linenumber')} AS STRING), 'MB.csv') AS Dataset,
          {_SIZE.format(c='l.l_linenumber')} AS Dataset_Size_MB,
          CASE l.l_returnflag WHEN 'A' THEN 'cpu' WHEN 'N' THEN 'io' ELSE 'memory' END AS Workload,
          CAST(l.l_orderkey % 40 + 1 AS INT) AS Run_Number, CAST(l.l_shipdate AS TIMESTAMP) AS Timestamp,
          l.l_quantity / 10.0 AS Runtime_Minutes, l.l_discount * 100.0 AS CPU_Avg_Pct, l.l_extendedprice / 1000000.0 AS Cost_USD,
          CASE WHEN l.l_discount > 0.065 THEN 'FAILED' ELSE 'SUCCESS' END AS Exit_Status
        FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey JOIN {{part}} p ON l.l_partkey = p.p_partkey
    """,
    # Cumulative snapshots: later result files repeat the rows of earlier ones.
    "snapshots": """
        SELECT *, 'results-1.csv' AS source_file FROM {vm_results} WHERE extract(year FROM Timestamp) <= 1996
        UNION ALL SELECT *, 'results-2.csv' AS source_file FROM {vm_results} WHERE extract(year FROM Timestamp) <= 1998
        UNION ALL SELECT *, 'results-3.csv' AS source_file FROM {vm_results}
    """,
    # Price list: several offers per region, machine and tier.
    "price_list": """
        SELECT r.r_name AS region, p.p_type AS machine_type,
          CASE p.p_size % 4 WHEN 0 THEN 'on-demand' WHEN 1 THEN 'OnDemand' WHEN 2 THEN 'spot' ELSE 'D4 v3 Low Priority' END AS tier,
          CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE round(p.p_retailprice / 10000.0, 6) END AS price_usd_hr
        FROM {part} p JOIN {region} r ON r.r_regionkey = p.p_partkey % 5
        WHERE NOT (p.p_type = 'PROMO' AND r.r_name = 'ASIA')
    """,
    # One request per order; some have no SLA, some a workload that was never run.
    "requests": """
        SELECT o_orderkey AS request_id,
          CASE WHEN o_orderkey % 17 = 3 THEN 'gpu-heavy' WHEN o_orderstatus = 'F' THEN 'cpu-heavy' WHEN o_orderstatus = 'O' THEN 'io-heavy' ELSE 'memory-heavy' END AS workload_type,
          500.0 AS dataset_size_mb, CASE WHEN o_orderkey % 11 = 5 THEN NULL ELSE 2.3 + o_totalprice / 1000000.0 END AS sla_runtime_minutes,
          CASE o_custkey % 4 WHEN 0 THEN 'cost' WHEN 1 THEN 'runtime' WHEN 2 THEN 'carbon' ELSE 'balanced' END AS goal
        FROM {orders}
    """,
    # Candidates with the workload means as predictions and full emissions.
    "scored": """
        SELECT c.*, round(p.rt, 9) AS predicted_runtime_minutes, round(p.cost, 9) AS predicted_cost_usd,
          coalesce(w.power_w, v.vcpus * 12.0, 60.0) AS power_w,
          (coalesce(w.power_w, v.vcpus * 12.0, 60.0) * c.nodes / 1000.0) * (round(p.rt, 9) / 60.0) * c.carbon_intensity_mean
            * CASE lower(c.cloud) WHEN 'aws' THEN CAST(1.15 AS DOUBLE) WHEN 'azure' THEN CAST(1.18 AS DOUBLE) ELSE CAST(1.2 AS DOUBLE) END AS predicted_emissions_gco2eq
        FROM (SELECT DISTINCT d.workload_type, d.cloud, d.region, d.machine_type, d.nodes, d.electricity_zone, g.carbon_intensity_mean, g.renewable_percentage_mean
              FROM {dataset} d JOIN (SELECT cloud, region, round(AVG(carbon_intensity_mean), 9) AS carbon_intensity_mean,
                round(AVG(renewable_percentage_mean), 9) AS renewable_percentage_mean FROM {dataset} GROUP BY 1, 2) g
                ON d.cloud = g.cloud AND d.region = g.region) c
        JOIN (SELECT workload_type, cloud, region, machine_type, nodes, AVG(runtime_minutes) AS rt, AVG(cost_usd) AS cost
              FROM {dataset} GROUP BY 1, 2, 3, 4, 5) p
          ON c.workload_type = p.workload_type AND c.cloud = p.cloud AND c.region = p.region AND c.machine_type = p.machine_type AND c.nodes = p.nodes
        LEFT JOIN {power} w ON c.machine_type = w.machine_type LEFT JOIN {vcpus} v ON c.machine_type = v.machine_type
    """,
    # Mean cost, runtime and emissions per scenario, configuration and zone.
    "configurations": """
        SELECT d.workload_type, d.dataset_size_mb, d.cloud, d.region, d.machine_type, d.nodes, d.electricity_zone,
          COUNT(*) AS runs, round(AVG(d.runtime_minutes), 9) AS runtime_minutes, round(AVG(d.cost_usd), 9) AS cost_usd,
          round(AVG(d.power * d.nodes / 1000.0 * (d.runtime_minutes / 60.0)), 9) AS energy_kwh,
          round(AVG(d.power * d.nodes / 1000.0 * (d.runtime_minutes / 60.0) * d.carbon_intensity_mean * d.pue), 9) AS emissions_gco2eq,
          round(AVG(d.carbon_intensity_mean), 9) AS carbon_intensity_mean, round(AVG(d.renewable_percentage_mean), 9) AS renewable_percentage_mean,
          round(AVG(d.power), 9) AS power_w, round(AVG(d.pue), 9) AS pue
        FROM (SELECT x.*, coalesce(w.power_w, v.vcpus * 12.0, 60.0) AS power,
                CASE lower(x.cloud) WHEN 'aws' THEN CAST(1.15 AS DOUBLE) WHEN 'azure' THEN CAST(1.18 AS DOUBLE) ELSE CAST(1.2 AS DOUBLE) END AS pue
              FROM {dataset} x LEFT JOIN {power} w ON x.machine_type = w.machine_type LEFT JOIN {vcpus} v ON x.machine_type = v.machine_type) d
        GROUP BY 1, 2, 3, 4, 5, 6, 7
    """,
}
# Stand-ins that several queries share are written once per session, as the run
# store of a deployment would be; the others are views.
TABLES = {"runs", "readings", "dataset", "vm_results", "event_log"}
_WRITTEN: dict[tuple, str] = {}
_SHARED: dict[tuple, DataFrame] = {}
_NAME = re.compile(r"\{(\w+)\}")


class Inputs:
    """Given tables and stand-ins of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        if name not in STANDINS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if name in TABLES and key not in _WRITTEN:
            path = new_path(self.spark, name)
            self.sql(STANDINS[name]).write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key]) if name in TABLES else self.sql(STANDINS[name])

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table several queries select from, computed once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _SHARED:
            _SHARED[key] = stage(build(), name)
        return _SHARED[key]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in set(_NAME.findall(text))})


def clear_shared() -> None:
    """Forget shared derived tables, so that the next query computes its own."""
    _SHARED.clear()


def oracle(text: str) -> str:
    """The query with every stand-in it uses as a preceding WITH entry."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _NAME.findall(sql):
            if name in STANDINS and name not in order:
                visit(STANDINS[name])
                order.append(name)

    visit(text)
    plain = _NAME.sub(lambda m: m.group(1), text).strip()
    if not order:
        return plain
    entries = ", ".join(f"{n} AS ({_NAME.sub(lambda m: m.group(1), STANDINS[n]).strip()})" for n in order)
    if plain.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {entries}, {plain[len('WITH RECURSIVE'):].strip()}"
    if plain.upper().startswith("WITH "):
        return f"WITH {entries}, {plain[5:].strip()}"
    return f"WITH {entries} {plain}"
