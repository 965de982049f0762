"""Landed service payloads (one JSON text per row) flattened to tables.

Payloads whose entries stand in an array are read as variants, field by field:
a field that changes its type or goes missing is null in that entry alone, and
fields that no reader knows stay with the entry. What can't be read is reported
by quarantined(), what isn't known by unknown_fields(); both take one scan.
A text that isn't JSON, or lacks the array, has no entries. On-demand terms are
objects whose first member counts; variants don't keep the members' order, so
these are read with a declared schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger import schemas
from runledger.functions import labels, measures


#: Of each kind of payload: paths outside the entries, the entries' array, and the fields of an entry (path, type, whether it must be there).
LAYOUTS = {
    "carbon": ([("$.zone", "string")], "$.data", [
        ("$.datetime", "string", True), ("$.carbonIntensity", "double", True), ("$.emissionFactorType", "string", False),
        ("$.isEstimated", "boolean", False), ("$.estimationMethod", "string", False), ("$.createdAt", "string", False), ("$.updatedAt", "string", False),
    ]),
    "renewable": ([("$.zone", "string")], "$.data", [
        ("$.datetime", "string", True), ("$.value", "double", True), ("$.unit", "string", False),
        ("$.isEstimated", "boolean", False), ("$.estimationMethod", "string", False), ("$.createdAt", "string", False), ("$.updatedAt", "string", False),
    ]),
    "spot": ([], "$.SpotPriceHistory", [("$.AvailabilityZone", "string", True), ("$.SpotPrice", "double", True)]),
    "retail": ([], "$.Items", [("$.meterName", "string", True), ("$.productName", "string", True), ("$.retailPrice", "double", True)]),
}
_FAULT = "struct<position int, path string, reason string>"


def _entries(landed: DataFrame, kind: str, *kept: Column | str) -> DataFrame:
    """kept (of landed, the payload a variant), position and entry (a variant) of each entry."""
    rows = landed.withColumn("payload", F.try_parse_json("payload"))
    return rows.select(*kept, F.posexplode(F.try_variant_get("payload", LAYOUTS[kind][1], "array<variant>")).alias("position", "entry"))


def _field(kind: str, name: str) -> Column:
    """A field of an entry in its type; null if it is missing or can't be read."""
    path, type_, _ = next(f for f in LAYOUTS[kind][2] if f[0] == f"$.{name}")
    return F.try_variant_get("entry", path, type_)


def _fault(value: Column, path: str, type_: str, needed: bool, position: Column) -> Column:
    """The fault of one path: missing, null, wrong type; null if there is none."""
    raw = F.try_variant_get(value, path, "variant")
    absent = F.when(raw.isNull(), "missing").when(F.is_variant_null(raw), "null") if needed else F.when(raw.isNull() | F.is_variant_null(raw), F.lit(None).cast("string"))
    reason = absent.when(F.try_variant_get(value, path, type_).isNull(), "wrong type")
    return F.when(reason.isNotNull(), F.struct(position.cast("int").alias("position"), F.lit(path).alias("path"), reason.alias("reason")))


def quarantined(landed: DataFrame, kind: str) -> DataFrame:
    """landed, position, path and reason of everything that a payload lacks: one row a fault.

    position is the entry's place in its array (from 0), null for faults of the
    payload itself. Reasons: not JSON, missing, null, wrong type. A null payload
    isn't JSON. The landed text is kept as it came.
    """
    outside, array, fields = LAYOUTS[kind]
    # Parsed once, in a projection of its own.
    rows = landed.select(F.struct("*").alias("row"), F.try_parse_json("payload").alias("document"))
    payload, nowhere = F.col("document"), F.lit(None)
    whole = F.array(F.struct(nowhere.cast("int").alias("position"), F.lit("$").alias("path"), F.lit("not JSON").alias("reason")))
    own = F.array(*[_fault(payload, path, type_, True, nowhere) for path, type_ in outside], _fault(payload, array, "array<variant>", True, nowhere))
    entries = F.coalesce(F.try_variant_get(payload, array, "array<variant>"), F.array().cast("array<variant>"))
    inside = F.flatten(F.transform(entries, lambda e, i: F.array(*[_fault(e, path, type_, needed, i) for path, type_, needed in fields])))
    faults = F.when(payload.isNull(), whole).otherwise(F.concat(own, inside)).cast(f"array<{_FAULT}>")
    return rows.select("row", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault")).select("row.*", "fault.*")


def unknown_fields(landed: DataFrame, kind: str) -> DataFrame:
    """path, entries that have it, and its types (sorted, comma-joined): the fields of entries that no reader knows.

    The types of a path are a handful, so they are gathered as a set.
    """
    known = [path[2:] for path, _, _ in LAYOUTS[kind][2]]
    # An entry that isn't an object has no fields.
    fields = F.explode(F.try_variant_get("entry", "$", "map<string,variant>"))
    rows = _entries(landed, kind).select(fields.alias("name", "value")).filter(~F.col("name").isin(known))
    return rows.groupBy(F.concat(F.lit("$."), "name").alias("path")).agg(
        F.count(F.lit(1)).alias("entries"), F.array_join(F.array_sort(F.collect_set(F.schema_of_variant("value"))), ",").alias("types")
    )


def region_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.REGION_ZONES, "cloud string, region string, electricity_zone string")


def daily_from_payloads(landed: DataFrame, mapping: DataFrame, kind: str = "carbon") -> DataFrame:
    """Daily readings of every (cloud, region) whose zone the payload covers.

    landed has the column payload; mapping has cloud, region, electricity_zone.
    """
    value = {"carbon": "carbonIntensity", "renewable": "value"}[kind]
    name = {"carbon": "Carbon_Intensity_gCO2eq_per_kWh", "renewable": "Renewable_Percentage"}[kind]
    detail = {
        "carbon": ("emissionFactorType", "Emission_Factor_Type"),
        "renewable": ("unit", "Unit"),
    }[kind]
    days = _entries(landed, kind, F.try_variant_get("payload", "$.zone", "string").alias("electricity_zone"))
    return days.join(mapping, "electricity_zone").select(
        _field(kind, "datetime").alias("Date"),
        F.col("cloud").alias("Cloud"),
        F.col("region").alias("Region"),
        F.col("electricity_zone").alias("Electricity_Zone"),
        _field(kind, value).alias(name),
        _field(kind, detail[0]).alias(detail[1]),
        _field(kind, "isEstimated").alias("Is_Estimated"),
        _field(kind, "estimationMethod").alias("Estimation_Method"),
        _field(kind, "createdAt").alias("Created_At"),
        _field(kind, "updatedAt").alias("Updated_At"),
    )


def on_demand_prices(landed: DataFrame) -> DataFrame:
    """First on-demand hourly price of each product payload (region, machine_type, vcpus, payload)."""
    terms = F.from_json("payload", schemas.ON_DEMAND_PAYLOAD)["terms"]["OnDemand"]
    dimensions = F.flatten(F.transform(F.map_values(terms), lambda t: F.map_values(t["priceDimensions"])))
    price = F.get(dimensions, F.lit(0))["pricePerUnit"]["USD"].try_cast("double")
    return landed.select(
        "region", F.lit("").alias("availability_zone"), "machine_type", "vcpus",
        F.lit("on-demand").alias("tier"), price.alias("price_usd_hr"),
    ).filter("price_usd_hr is not null")


def spot_prices(landed: DataFrame) -> DataFrame:
    """The first listed spot price of each availability zone (entries are listed newest first)."""
    entries = _entries(landed, "spot", "region", "machine_type", "vcpus")
    first = F.min(F.struct("position", _field("spot", "SpotPrice").alias("price"))).price
    return (
        entries.groupBy("region", _field("spot", "AvailabilityZone").alias("availability_zone"), "machine_type", "vcpus")
        .agg(first.alias("price_usd_hr"))
        .select("region", "availability_zone", "machine_type", "vcpus", F.lit("spot").alias("tier"), "price_usd_hr")
    )


def retail_prices(landed: DataFrame) -> DataFrame:
    """All retail meters of each payload except Windows products."""
    items = _entries(landed, "retail", "region", "machine_type", "vcpus")
    return items.filter(~F.contains(_field("retail", "productName"), F.lit("Windows"))).select(
        "region", "machine_type", "vcpus", _field("retail", "meterName").alias("tier"), _field("retail", "retailPrice").alias("price_usd_hr")
    )


def without_spot_meters(prices: DataFrame) -> DataFrame:
    """Meters left for on-demand use: neither Spot nor Low Priority."""
    spot = F.contains("tier", F.lit("Spot")) | F.contains("tier", F.lit("Low Priority"))
    return prices.filter(~spot)


def job_runs(landed: DataFrame) -> DataFrame:
    """State, reason and runtime of job-service payloads."""
    p = F.from_json("payload", schemas.JOB_RUN_PAYLOAD)
    life, result = p["state"]["life_cycle_state"], p["state"]["result_state"]
    state_json = F.to_json(p["state"])
    return landed.select(
        *[c for c in landed.columns if c != "payload"],
        labels.run_finished(life).alias("finished"),
        labels.run_succeeded(life, result).alias("succeeded"),
        labels.run_state_text(life, result).alias("state"),
        F.coalesce(F.nullif(p["state"]["state_message"], F.lit("")), state_json).alias("reason"),
        measures.service_minutes(
            p["execution_duration"], p["setup_duration"], p["cleanup_duration"], p["start_time"], p["end_time"]
        ).alias("runtime_minutes"),
    )
