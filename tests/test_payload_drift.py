"""Payloads that change: what is read, what is reported, and what no reader knows."""

from runledger.sources import payloads

LANDED = [
    (1, '{"zone":"A","data":[{"datetime":"2024-01-01","carbonIntensity":5,"isEstimated":"maybe","source":"x"},{"datetime":"2024-01-02","carbonIntensity":"7.5"}]}'),
    (2, '{"zone":"A","data":[{"carbonIntensity":{"lca":1},"datetime":"2024-01-03","source":[1]},4]}'),
    (3, '{"data":[]}'),
    (4, '{"zone":"A","data":null}'),
    (5, '{"zone":null,"data":{"datetime":"2024-01-04"}}'),
    (6, "<html>"),
    (7, None),
    (8, ""),
    (9, '{"zone":"A","data":[{"datetime":"2024-01-05","carbonIntensity":null}]}'),
    (10, "[1]"),
]


def landed(spark):
    return spark.createDataFrame(LANDED, "id long, payload string").repartition(3)


def test_readable_fields_of_an_entry_are_kept(spark):
    mapping = spark.createDataFrame([("aws", "r1", "A"), ("azure", "r2", "A")], "cloud string, region string, electricity_zone string")
    days = payloads.daily_from_payloads(landed(spark), mapping, "carbon").filter("Cloud = 'aws'")
    found = {(r["Date"], r["Carbon_Intensity_gCO2eq_per_kWh"], r["Is_Estimated"]) for r in days.collect()}
    assert found == {("2024-01-01", 5.0, None), ("2024-01-02", 7.5, None), ("2024-01-03", None, None), (None, None, None), ("2024-01-05", None, None)}


def test_every_fault_has_a_row(spark):
    found = sorted(((r["id"], r["position"], r["path"], r["reason"]) for r in payloads.quarantined(landed(spark), "carbon").collect()), key=repr)
    assert found == sorted([
        (1, 0, "$.isEstimated", "wrong type"),
        (2, 0, "$.carbonIntensity", "wrong type"), (2, 1, "$.datetime", "missing"), (2, 1, "$.carbonIntensity", "missing"),
        (3, None, "$.zone", "missing"), (4, None, "$.data", "null"), (5, None, "$.zone", "null"), (5, None, "$.data", "wrong type"),
        (6, None, "$", "not JSON"), (7, None, "$", "not JSON"), (8, None, "$", "not JSON"),
        (9, 0, "$.carbonIntensity", "null"), (10, None, "$.zone", "missing"), (10, None, "$.data", "missing"),
    ], key=repr)
    whole = payloads.quarantined(landed(spark).filter("id = 6"), "carbon").collect()
    assert [r["payload"] for r in whole] == ["<html>"]
    assert payloads.quarantined(landed(spark).limit(0), "carbon").collect() == []


def test_unknown_fields_are_counted(spark):
    found = [tuple(r) for r in payloads.unknown_fields(landed(spark), "carbon").collect()]
    assert found == [("$.source", 2, "ARRAY<BIGINT>,STRING")]


def test_nothing_is_shuffled_for_the_quarantine(spark):
    plan = payloads.quarantined(landed(spark).coalesce(1), "retail")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
