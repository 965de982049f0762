import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import labels
from runledger.operators import scoring
from runledger.plans import recommend

COLUMNS = (
    "id string, predicted_runtime_minutes double, predicted_cost_usd double, predicted_emissions_gco2eq double, "
    "carbon_intensity_mean double, renewable_percentage_mean double, cloud string, region string, machine_type string, nodes int"
)
FOUR = [
    ("A", 2.0, 4.0, 3.0, 500.0, 20.0, "aws", "us-east-1", "m5.large", 2),
    ("B", 5.0, 1.0, 2.0, 300.0, 60.0, "azure", "central-india", "d2as", 4),
    ("C", 1.0, 6.0, 9.0, 700.0, 5.0, "aws", "us-west-2", "m5.xlarge", 1),
    ("D", 8.0, 0.5, 1.0, 200.0, 80.0, "azure", "southeast-asia", "d4s", 4),
]


def ranked(spark, rows, goal, sla=100.0):
    df = spark.createDataFrame(rows, COLUMNS).withColumns({
        "request_id": F.lit(1), "goal": F.lit(goal), "sla_runtime_minutes": F.lit(sla), "electricity_zone": F.lit("z"),
    })
    return scoring.rank_candidates(df.repartition(3)).orderBy("rank").collect()


@pytest.mark.parametrize("goal, scores, order", [
    ("cost", {"A": 0.6363636363636364, "B": 0.09090909090909091, "C": 1.0, "D": 0.0}, "DBAC"),
    ("runtime", {"A": 0.14285714285714285, "B": 0.5714285714285714, "C": 0.0, "D": 1.0}, "CABD"),
    ("carbon", {"A": 0.45, "B": 0.19166666666666668, "C": 1.25, "D": 0.0}, "DBAC"),
])
def test_published_scores_and_orders(spark, goal, scores, order):
    rows = ranked(spark, FOUR, goal)
    assert {r.id: r.optimization_score for r in rows} == pytest.approx(scores)
    assert "".join(r.id for r in rows) == order


def candidate(name, runtime, cost, emitted, renewable, cloud="aws"):
    return (name, float(runtime), float(cost), float(emitted), 1.0, float(renewable), cloud, "us-east-1", "m5.large", 2)


@pytest.mark.parametrize("points, expected", [
    ([(1, 1, 1, 100), (2, 2, 2, 0)], {"0": 0.0, "1": 1.0}),
    ([(1, 2, 1, 50), (1.5, 1, 1, 50), (5, 100, 1, 50)], {"0": 0.5916079783, "1": 0.2958039892}),
])
def test_balanced_scores(spark, points, expected):
    rows = ranked(spark, [candidate(str(i), *p) for i, p in enumerate(points)], "balanced")
    got = {r.id: r.optimization_score for r in rows}
    assert {k: got[k] for k in expected} == pytest.approx(expected)


def test_balanced_prefers_the_compromise(spark):
    points = [(1, 10, 10, 0), (5, 5, 5, 50), (10, 1, 1, 100)]
    assert ranked(spark, [candidate(str(i), *p) for i, p in enumerate(points)], "balanced")[0].id == "1"


def test_scaling_helpers(spark):
    def scaled(values, column):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        return [r.s for r in df.withColumn("s", column(F.col("v"), Window.partitionBy(F.lit(0)))).orderBy("i").collect()]

    assert scaled([10.0, 20.0, 30.0], scoring.min_max) == [0.0, 0.5, 1.0]
    assert scaled([4.0, 4.0], scoring.min_max) == [0.0, 0.0]
    assert scaled([10.0, 15.0, 20.0], scoring.ratio_to_best) == [0.0, 0.5, 1.0]
    assert scaled([100.0, 75.0, 50.0], lambda v, w: scoring.ratio_to_best(v, w, higher_is_better=True)) == [0.0, 0.25, 0.5]
    assert scaled([0.0, 5.0, 10.0], scoring.ratio_to_best) == [0.0, 0.5, 1.0]


def test_ties_end_in_the_configuration_key(spark):
    tied = [candidate("x", 1, 1, 1, 50, "azure"), candidate("y", 1, 1, 1, 50, "aws")]
    for goal in fv.GOALS:
        assert [r.id for r in ranked(spark, tied, goal)] == ["y", "x"]


def test_without_match_all_are_ranked_and_the_reason_says_so(spark):
    rows = ranked(spark, FOUR, "cost", sla=0.5)
    assert len(rows) == 4 and all(r.recommendation_reason.startswith("No configuration satisfied the SLA; ") for r in rows)
    assert [r.id for r in ranked(spark, FOUR, "cost", sla=2.0)] == ["A", "C"]


def test_goal_names(spark):
    names = {"Lowest-Cost": "cost", " fastest ": "runtime", "lowest carbon": "carbon", "Balance": "balanced"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.g for r in df.select("n", labels.goal("n").alias("g")).collect()} == names
    with pytest.raises(Exception, match="unknown optimization goal"):
        spark.createDataFrame([("cheap",)], "n string").select(labels.goal("n")).collect()


def test_shared_rankings_equal_ranking_each_request(spark):
    """Requests sharing a prefix of admitted candidates get what they would get alone."""
    scored = spark.createDataFrame(FOUR, COLUMNS).withColumns({"workload_type": F.lit("w"), "electricity_zone": F.lit("z")})
    slas = [0.5, 1.0, 1.5, 2.0, 4.9, 5.0, 7.0, 8.0, 90.0, None]
    rows = [(i, "w", 10.0, sla, goal) for i, (sla, goal) in enumerate((s, g) for s in slas for g in fv.GOALS)]
    requests = spark.createDataFrame(rows, "request_id int, workload_type string, dataset_size_mb double, sla_runtime_minutes double, goal string")

    def answer(out):
        return sorted((r.request_id, r["rank"], r.id, round(r.optimization_score, 9), r.no_sla_match, r.recommendation_reason) for r in out.collect())

    shared = answer(recommend.recommend(requests, scored, 3))
    alone = scoring.top_n(scoring.rank_candidates(scoring.expand_requests(requests, scored)), 3)
    assert shared == answer(alone) and len({r[0] for r in shared}) == len(rows)
    with pytest.raises(ValueError):
        recommend.recommend(requests, scored, 0)
