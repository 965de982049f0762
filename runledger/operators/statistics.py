"""Repeatability, fold metrics and paired comparisons of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as fv
from runledger.functions import measures
from runledger.functions.labels import fold_of, group_key
from runledger.functions.significance import t_critical_95, t_p_value, wilcoxon_p_value
from runledger.operators.quantiles import exact_quantiles
from runledger.session import stage

PAIR = ["target", "model_a", "model_b"]


def repeat_statistics(runs: DataFrame) -> DataFrame:
    """Unrounded moments of the runtime of every scenario and configuration run at least twice."""
    keys = [*fv.SCENARIO, *fv.CONFIG]
    x = F.col("runtime_minutes")
    return (
        runs.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            F.count(x).alias("runs"), measures.mean_of(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("least"), F.max(x).alias("greatest"),
        )
        .filter("runs >= 2")
    )


def repeatability(runs: DataFrame) -> DataFrame:
    """Mean, spread, CV and 95 % confidence interval of repeated runs."""
    stats = repeat_statistics(runs)
    mean, std = F.col("mean"), F.col("std")
    margin = t_critical_95((F.col("runs") - 1).cast("bigint")) * std / F.sqrt("runs")
    return stats.withColumn("margin", margin).select(
        *fv.SCENARIO, *fv.CONFIG, "runs",
        F.round(mean, 4).alias("mean_runtime_minutes"),
        F.round(std, 4).alias("std_runtime_minutes"),
        F.round(F.when(mean > 0, std / mean * 100.0).otherwise(F.lit(0.0)), 2).alias("coefficient_of_variation_pct"),
        F.round(mean - F.col("margin"), 4).alias("ci95_lower"),
        F.round(mean + F.col("margin"), 4).alias("ci95_upper"),
        F.round("least", 4).alias("min_runtime_minutes"),
        F.round("greatest", 4).alias("max_runtime_minutes"),
    )


def repeatability_summary(repeats: DataFrame) -> DataFrame:
    """Number of repeated configurations, median and greatest CV."""
    repeats = stage(repeats.select("coefficient_of_variation_pct"), "repeats")
    median = exact_quantiles(repeats, [], "coefficient_of_variation_pct", {"median": 0.5})
    return repeats.agg(
        F.count(F.lit(1)).alias("configurations_with_repeats"),
        F.round(F.max("coefficient_of_variation_pct"), 2).alias("max_coefficient_of_variation_pct"),
    ).withColumn("median_coefficient_of_variation_pct", F.round(median.select("median").scalar(), 2))


def fold_count(runs: DataFrame, wanted: int = 5) -> DataFrame:
    """Number of distinct groups and the folds they allow: at least 2, at most the groups."""
    return runs.select(*fv.GROUP).distinct().agg(F.count(F.lit(1)).alias("groups")).withColumn(
        "folds", F.greatest(F.lit(2), F.least(F.lit(wanted).cast("bigint"), F.col("groups"))).cast("int")
    )


def with_folds(runs: DataFrame, folds: int = 5) -> DataFrame:
    """Fold 1..folds; all repeats of a group share a fold."""
    return runs.withColumn("fold", fold_of(group_key(*fv.GROUP), folds))


def regression_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE and R2 per key from actual and predicted, in one aggregation."""
    error = F.col("actual") - F.col("predicted")
    sums = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("_mse"),
        F.var_pop("actual").alias("_variance"),
    )
    # Without any spread in the actual values R2 is 1 for a perfect fit and 0 otherwise.
    flat = F.when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("_variance") > 0, 1.0 - F.col("_mse") / F.col("_variance")).otherwise(flat)
    return sums.select(*keys, "n_test", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"))


def average_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean R2 and RMSE over the targets."""
    return metrics.groupBy(*keys).agg(
        F.round(F.avg("r2"), 4).alias("average_r2"), F.round(F.avg("rmse"), 4).alias("average_rmse")
    )


def fold_summary(per_fold: DataFrame, digits: int = 6) -> DataFrame:
    """Mean and sample standard deviation over the folds, per model and target."""
    return per_fold.groupBy("model", "target").agg(
        F.countDistinct("fold").alias("folds"),
        *[
            F.round(f(m), digits).alias(f"{m}_{name}")
            for m in ("mae", "rmse", "r2")
            for name, f in (("mean", F.avg), ("std", F.stddev_samp))
        ],
    )


def fold_table(per_fold: DataFrame, models: list[str], metric: str = "mae") -> DataFrame:
    """One row per target and fold, one column per model; incomplete folds are dropped."""
    return per_fold.groupBy("target", "fold").pivot("model", models).agg(F.first(metric)).dropna()


def model_pairs(per_fold: DataFrame, metric: str = "mae") -> DataFrame:
    """Values of two models on the same fold, for every unordered pair, over folds all models have."""
    values = per_fold.select("target", "fold", "model", F.col(metric).alias("value")).dropna(subset=["value"])
    models = values.groupBy("target").agg(F.countDistinct("model").alias("_models"))
    complete = values.groupBy("target", "fold").agg(F.count(F.lit(1)).alias("_n")).join(models, "target").filter("_n = _models")
    values = values.join(complete, ["target", "fold"], "left_semi")
    a = values.select("target", "fold", F.col("model").alias("model_a"), F.col("value").alias("a"))
    b = values.select("target", "fold", F.col("model").alias("model_b"), F.col("value").alias("b"))
    return a.join(b, ["target", "fold"]).filter("model_a < model_b")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """W, number of non-zero differences, whether ranks are tied or zeros were dropped, and the tie term, per pair."""
    d = pairs.withColumn("d", F.col("a") - F.col("b"))
    size = F.abs("d")
    nonzero = d.filter("d <> 0")
    ties = Window.partitionBy(*PAIR, size)
    rank = F.rank().over(Window.partitionBy(*PAIR).orderBy(size)) + (F.count(F.lit(1)).over(ties) - 1) / 2
    ranked = nonzero.withColumns({"rank": rank, "_same": F.count(F.lit(1)).over(ties)})
    sums = ranked.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("nonzero"),
        F.least(
            F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)),
            F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)),
        ).alias("w"),
        (F.max("_same") > 1).alias("_tied"),
        # sum over tie groups of t^3 - t, written per row
        F.sum((F.col("_same") * F.col("_same") - 1).cast("double")).alias("tie_term"),
    )
    flags = d.groupBy(*PAIR).agg((F.count_if(F.col("d") == 0) > 0).alias("_zeros"))
    return sums.join(flags, PAIR).withColumn("approximate", F.col("_tied") | F.col("_zeros")).drop("_tied", "_zeros")


def paired_moments(pairs: DataFrame) -> DataFrame:
    d = F.col("a") - F.col("b")
    return pairs.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"), F.max(F.abs(d)).alias("_largest"),
    )


def paired_tests(per_fold: DataFrame, metric: str = "mae") -> DataFrame:
    """t interval, paired t, signed-rank test and Cohen's d of every model pair."""
    pairs = model_pairs(per_fold, metric)
    stats = paired_moments(pairs).join(signed_ranks(pairs), PAIR, "left")
    mean, sd, n = F.col("mean_difference"), F.col("sd"), F.col("folds")
    sem = sd / F.sqrt(n)
    df = (n - 1).cast("bigint")
    t = F.when(sem > 0, mean / sem).when(mean != 0, F.signum(mean) * F.lit(float("inf")))
    equal = F.col("_largest") <= 1e-8
    stats = stats.withColumns({"t": t, "margin": F.when(sem > 0, t_critical_95(F.greatest(df, F.lit(1))) * sem).otherwise(F.lit(0.0))})
    stats = stats.withColumns({
        "t_p": t_p_value(F.col("t"), F.greatest(df, F.lit(1))),
        "w_p": wilcoxon_p_value(F.col("w"), F.coalesce("nonzero", F.lit(0)), F.coalesce("approximate", F.lit(False)), F.coalesce("tie_term", F.lit(0.0))),
    })
    low, high = mean - F.col("margin"), mean + F.col("margin")
    return stats.select(
        "target", F.lit(metric).alias("metric"), "model_a", "model_b", "folds",
        F.round("mean_a", 6).alias("mean_a"),
        F.round("mean_b", 6).alias("mean_b"),
        F.round(mean, 6).alias("mean_difference"),
        F.round(low, 6).alias("ci95_lower"),
        F.round(high, 6).alias("ci95_upper"),
        F.round("t", 4).alias("paired_t_statistic"),
        F.round("t_p", 4).alias("paired_t_p_value"),
        F.when(~equal, F.round("w", 4)).alias("wilcoxon_statistic"),
        F.when(equal, F.lit(1.0)).otherwise(F.round("w_p", 4)).alias("wilcoxon_p_value"),
        F.round(F.when(sd > 0, mean / sd).otherwise(F.lit(0.0)), 4).alias("cohens_d"),
        F.coalesce(F.col("t_p") < 0.05, F.lit(False)).alias("significant_at_0_05"),
        ((low > 0) | (high < 0)).alias("ci_excludes_zero"),
    )


def significance_summary(tests: DataFrame) -> DataFrame:
    return tests.agg(
        F.count_if("significant_at_0_05").alias("significant_pairs"), F.count(F.lit(1)).alias("total_pairs"),
        F.max("folds").alias("folds"),
    )


def fold_cells(runs: DataFrame, folds: int = 5) -> DataFrame:
    """Run count and target sums per group, with the group's fold; everything the fold means need."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in fv.TARGETS]]
    return with_folds(runs.groupBy(*fv.GROUP).agg(*sums), folds)


def left_out_fold_means(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean targets of each key over the folds other than each fold.

    The mean of the other folds is the key's total minus its own fold, so no
    fold is fitted separately. Keys seen in one fold only fall back to all
    runs of the other folds.
    """
    columns = ["n", *fv.TARGETS]
    own = cells.groupBy(*keys, "fold").agg(*[F.sum(c).alias(c) for c in columns])
    fold = cells.groupBy("fold").agg(*[F.sum(c).alias(c) for c in columns])
    total = cells.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()
    others = fold.select("fold", *[((total[t] - F.col(t)) / (total["n"] - F.col("n"))).alias(f"{t}_other") for t in fv.TARGETS])
    if keys:
        whole = cells.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        own = own.join(whole, keys)
    else:
        own = own.withColumns({f"_{c}": total[c] for c in columns})
    rest = F.col("_n") - F.col("n")

    def hat(t: str) -> Column:
        return F.coalesce(F.when(rest > 0, (F.col(f"_{t}") - F.col(t)) / rest), F.col(f"{t}_other")).alias(f"{t}_hat")

    return own.join(others, "fold").select(*keys, "fold", *[hat(t) for t in fv.TARGETS])


def left_out_fold_predictions(runs: DataFrame, models: dict[str, list[str]], folds: int = 5) -> DataFrame:
    """(model, fold, target, actual, predicted) of every run for several key sets at once.

    The runs are read twice: once into cells, once to meet the cells'
    predictions, all models in one join.
    """
    cells = stage(fold_cells(runs, folds), "fold-cells")
    table = cells.select(*fv.GROUP, "fold")
    for name, keys in models.items():
        means = left_out_fold_means(cells, keys).withColumnsRenamed({f"{t}_hat": f"_{name}_{t}" for t in fv.TARGETS})
        table = table.join(means, [*keys, "fold"])
    table = stage(table, "fold-predictions")
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("model"), F.lit(t).alias("target"), F.col(t).cast("double").alias("actual"),
            F.col(f"_{name}_{t}").alias("predicted"),
        )
        for name in models for t in fv.TARGETS
    ]))
    return runs.join(table, fv.GROUP).select("fold", rows.alias("_r")).select("_r.model", "fold", "_r.target", "_r.actual", "_r.predicted")
