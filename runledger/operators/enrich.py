"""Joins that add grid readings, prices and power to runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import labels, measures
from runledger.session import stage

KEYS = ["cloud_key", "region_key"]
RANGE_COLUMNS = [
    "carbon_intensity_min", "carbon_intensity_max", "renewable_percentage_min", "renewable_percentage_max",
]


def with_join_keys(df: DataFrame, cloud: str = "cloud", region: str = "region") -> DataFrame:
    return df.withColumns({"cloud_key": labels.key(F.col(cloud)), "region_key": labels.key(F.col(region))})


def daily_readings(carbon: DataFrame, renewable: DataFrame) -> DataFrame:
    """Carbon and renewable readings matched by day, cloud, region and zone."""
    on = ["reading_date", "Cloud", "Region", "Electricity_Zone"]
    day = F.to_date(F.try_to_timestamp("Date")).alias("reading_date")
    left = carbon.select(day, *on[1:], F.col("Carbon_Intensity_gCO2eq_per_kWh").alias("carbon_intensity"))
    right = renewable.select(day, *on[1:], F.col("Renewable_Percentage").alias("renewable_percentage"))
    return with_join_keys(left.join(right, on, "inner"), "Cloud", "Region").select(
        "reading_date", *KEYS, F.col("Electricity_Zone").alias("electricity_zone"),
        "carbon_intensity", "renewable_percentage",
    )


def regional_features(daily: DataFrame) -> DataFrame:
    """Mean, least and greatest readings and the number of days, by cloud, region and zone."""
    return daily.groupBy(*KEYS, "electricity_zone").agg(
        *[
            f(c).alias(f"{c}_{name}")
            for c in ("carbon_intensity", "renewable_percentage")
            for name, f in (("mean", measures.mean_of), ("min", F.min), ("max", F.max))
        ],
        F.countDistinct("reading_date").alias("carbon_days_available"),
    )


def regional_means(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Average readings by the given keys (the older, zone-keyed merge and the recommender use it)."""
    columns = {"carbon_intensity": "carbon_intensity_mean", "renewable_percentage": "renewable_percentage_mean"}
    have = {c if c in readings.columns else name: name for c, name in columns.items()}
    return readings.groupBy(*keys).agg(*[measures.mean_of(c).alias(name) for c, name in have.items()])


def many_zone_regions(features: DataFrame) -> DataFrame:
    """Regions whose features would multiply rows, being kept for several zones."""
    return features.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("zones")).filter("zones > 1")


def nearest_readings(days: DataFrame, daily: DataFrame) -> DataFrame:
    """The reading nearest to each (cloud_key, region_key, day), either way; ties go to the earlier one.

    Both sides hold at most one row per key and calendar day, so a window
    over one key is bounded by the days on record however many runs it has.
    """
    reading = F.struct("reading_date", "electricity_zone", "carbon_intensity", "renewable_percentage")
    timeline = (
        daily.select(*KEYS, F.col("reading_date").alias("day"), reading.alias("reading"), F.lit(False).alias("asked"))
        .unionByName(days.select(*KEYS, "day", F.lit(True).alias("asked")), allowMissingColumns=True)
        .groupBy(*KEYS, "day")
        .agg(F.max("reading").alias("reading"), F.max("asked").alias("asked"))
    )
    so_far = Window.partitionBy(*KEYS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    day = F.col("day")
    sides = timeline.withColumns({
        "before": F.last("reading", ignorenulls=True).over(so_far.orderBy(day)),
        "after": F.last("reading", ignorenulls=True).over(so_far.orderBy(day.desc())),
    })
    wait, age = F.datediff("after.reading_date", day), F.datediff(day, "before.reading_date")
    nearest = F.when(age.isNull() | (wait < age), F.col("after")).otherwise(F.col("before"))
    return sides.filter("asked").select(*KEYS, "day", nearest.alias("r")).select(
        *KEYS, "day", "r.reading_date", "r.electricity_zone", "r.carbon_intensity", "r.renewable_percentage",
    )


def attach_carbon(runs: DataFrame, daily: DataFrame, features: DataFrame, basis: str = "regional_mean") -> DataFrame:
    """Carbon features on every run.

    regional_mean gives each run its region's overall features; per_run gives
    runs with a run_date the nearest daily reading and only the others the
    regional features. The runs are read once and joined with two small
    staged tables; a run with a date never matches the regional side.
    """
    if basis not in ("regional_mean", "per_run"):
        raise ValueError(f"unknown basis: {basis}")
    feature_columns = [c for c in features.columns if c not in KEYS]
    if basis == "regional_mean":
        return runs.join(stage(features), KEYS, "left").withColumn("carbon_feature_source", F.lit("regional_mean"))

    days = runs.filter("run_date is not null").select(*KEYS, F.col("run_date").alias("day")).distinct()
    found = stage(nearest_readings(days, daily)).select(
        *[F.col(k).alias(f"_{k}") for k in KEYS],
        F.col("day").alias("_day"),
        F.struct("electricity_zone", "carbon_intensity", "renewable_percentage").alias("_near"),
    )
    region = stage(features).select(
        *[F.col(k).alias(f"_r{k}") for k in KEYS], F.struct(*feature_columns).alias("_mean")
    )
    r = runs
    joined = r.join(
        found, (r.cloud_key == F.col("_cloud_key")) & (r.region_key == F.col("_region_key")) & (r.run_date == F.col("_day")), "left"
    )
    undated = F.when(r.run_date.isNull(), r.region_key)
    joined = joined.join(
        region, (r.cloud_key == F.col("_rcloud_key")) & (undated == F.col("_rregion_key")), "left"
    )
    dated = F.col("run_date").isNotNull()
    near = {
        "electricity_zone": F.col("_near.electricity_zone"),
        "carbon_intensity_mean": F.col("_near.carbon_intensity"),
        "renewable_percentage_mean": F.col("_near.renewable_percentage"),
        "carbon_days_available": F.lit(1).cast("bigint"),
    }
    return joined.select(
        *[F.col(c) for c in runs.columns],
        *[
            F.when(dated, near.get(c, F.lit(None))).otherwise(F.col(f"_mean.{c}")).alias(c)
            for c in feature_columns
        ],
        F.when(dated, F.lit("nearest_daily_reading")).otherwise(F.lit("regional_mean")).alias("carbon_feature_source"),
    )


def attach_power(df: DataFrame, power: DataFrame | None, vcpus: DataFrame | None = None) -> DataFrame:
    """power_w and its source: the power table, else vCPUs x 12 W, else 60 W.

    power has machine_type, power_w, source; vcpus has machine_type, vcpus.
    """
    out = df
    if power is not None:
        listed = power if "source" in power.columns else power.withColumn("source", F.lit("unspecified"))
        out = out.join(
            listed.select("machine_type", F.col("power_w").alias("_listed_w"), F.col("source").alias("_listed_source")),
            "machine_type", "left",
        )
    else:
        out = out.withColumns({"_listed_w": F.lit(None).cast("double"), "_listed_source": F.lit(None).cast("string")})
    if vcpus is not None:
        out = out.join(vcpus.select("machine_type", F.col("vcpus").alias("_listed_vcpus")), "machine_type", "left")
    else:
        out = out.withColumn("_listed_vcpus", F.lit(None).cast("double"))
    inferred = labels.inferred_vcpus(F.col("machine_type"), F.col("_listed_vcpus"))
    listed_w = F.nanvl(F.col("_listed_w"), F.lit(None).cast("double"))
    return out.select(
        *[F.col(c) for c in df.columns],
        F.coalesce(listed_w, inferred * fv.WATTS_PER_VCPU, F.lit(fv.DEFAULT_POWER_W)).alias("power_w"),
        F.when(listed_w.isNull(), F.coalesce("_listed_source", F.lit(fv.ESTIMATED_SOURCE)))
        .otherwise(F.col("_listed_source")).alias("power_source"),
        (listed_w.isNull() & inferred.isNull()).alias("vcpus_unknown"),
    )


def power_warnings(powered: DataFrame) -> DataFrame:
    """Machines whose power is a placeholder or a default, one row per machine and warning."""
    placeholder = F.contains(F.upper("power_source"), F.lit("PLACEHOLDER"))
    warning = F.when(placeholder, "placeholder power").when(F.col("vcpus_unknown"), "default power")
    return (
        powered.select("machine_type", warning.alias("warning"))
        .filter("warning is not null")
        .groupBy("machine_type", "warning")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def power_template(df: DataFrame, vcpus: DataFrame | None = None) -> DataFrame:
    """Placeholder power rows of the machines in df."""
    machines = df.select("machine_type").distinct()
    if vcpus is not None:
        machines = machines.join(vcpus.select("machine_type", F.col("vcpus").alias("_listed")), "machine_type", "left")
    else:
        machines = machines.withColumn("_listed", F.lit(None).cast("double"))
    inferred = labels.inferred_vcpus(F.col("machine_type"), F.col("_listed"))
    return machines.select(
        "machine_type",
        inferred.alias("vcpus"),
        F.round(F.coalesce(inferred * fv.WATTS_PER_VCPU, F.lit(fv.DEFAULT_POWER_W)), 1).alias("power_w"),
        F.lit(fv.PLACEHOLDER_SOURCE).alias("source"),
    ).orderBy("machine_type")


def watt_coefficients(spark) -> DataFrame:
    return spark.createDataFrame(
        fv.WATT_COEFFICIENTS, "provider string, architecture string, min_watts double, max_watts double"
    )


def power_table(instances: DataFrame, coefficients: DataFrame, utilisation: float = 0.5) -> DataFrame:
    """Power per machine: mean over its architectures of min + u (max - min), times vCPUs.

    instances has machine_type, provider, vcpus, architectures (array), note.
    """
    if not 0.0 <= utilisation <= 1.0:
        raise ValueError("utilisation must be between 0 and 1")
    span = F.col("max_watts") - F.col("min_watts")
    keys = ["machine_type", "provider", "vcpus", "microarchitecture", "note"]
    per_vcpu = (
        instances.withColumn("microarchitecture", F.array_join("architectures", " + "))
        .withColumn("architecture", F.explode("architectures"))
        .join(coefficients, ["provider", "architecture"])
        .groupBy(*keys)
        .agg(measures.mean_of(F.col("min_watts") + F.lit(utilisation) * span, 12).alias("_w"))
    )
    source = F.format_string(
        f"Cloud Carbon Footprint coefficients (%s, %s) at {utilisation * 100:.0f}%% vCPU utilisation; %s",
        "provider", "microarchitecture", "note",
    )
    return per_vcpu.select(
        "machine_type",
        "vcpus",
        F.round(F.col("_w") * F.col("vcpus"), 2).alias("power_w"),
        source.alias("source"),
        F.round("_w", 4).alias("watts_per_vcpu"),
        "microarchitecture",
        F.lit(float(utilisation)).alias("utilisation_assumed"),
    ).orderBy("machine_type")


def priced_candidates(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    return candidates.join(prices, "instance_type", "inner")


def unpriced_candidates(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """Candidate instance types without an hourly price."""
    priced = prices.filter("hourly_price_usd is not null")
    return candidates.join(priced, "instance_type", "left_anti").select("instance_type").distinct()


def lowest_prices(prices: DataFrame, provider: str = "aws") -> DataFrame:
    """Lowest hourly price by region, machine and pricing model, from one pass over the price list."""
    model = labels.pricing_model(F.col("tier")) if provider == "aws" else labels.tier_pricing_model(F.col("tier"))
    return (
        prices.filter("price_usd_hr is not null")
        .groupBy(labels.key("region").alias("region_key"), F.trim("machine_type").alias("machine_type"), model.alias("pricing_model"))
        .agg(F.round(F.min("price_usd_hr"), 6).alias("hourly_price_usd"))
    )


def priced_runs(runs: DataFrame, lowest: DataFrame, provider: str = "aws") -> DataFrame:
    """Runs with hourly price and run cost; unpriced runs keep nulls (see unpriced_runs)."""
    return _with_price_key(runs, provider).join(lowest, ["region_key", "machine_type", "pricing_model"], "left").withColumn(
        "cost_usd", measures.run_cost(F.col("hourly_price_usd"), F.col("nodes"), F.col("runtime_minutes"))
    )


def unpriced_runs(runs: DataFrame, lowest: DataFrame, provider: str = "aws") -> DataFrame:
    """Region, machine and pricing model combinations of runs without any price."""
    keys = ["region_key", "machine_type", "pricing_model"]
    return _with_price_key(runs, provider).select(*keys).distinct().join(lowest, keys, "left_anti")


def _with_price_key(runs: DataFrame, provider: str) -> DataFrame:
    model = labels.pricing_model(F.col("pricing_model"))
    if provider != "aws":  # any model that is not spot is billed on demand
        model = F.when(model == "spot", F.lit("spot")).otherwise(F.lit("on-demand"))
    return runs.withColumns({"region_key": labels.key("region"), "pricing_model": model})


def with_cpu_mean(runs: DataFrame, samples: DataFrame, key: list[str]) -> DataFrame:
    """Mean CPU sample per run, 0.0 where a run has none."""
    means = samples.groupBy(*key).agg(F.round(F.avg("cpu_pct"), 2).alias("_cpu"))
    return runs.join(means, key, "left").withColumn("cpu_avg_pct", F.coalesce("_cpu", F.lit(0.0))).drop("_cpu")
