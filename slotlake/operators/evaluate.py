"""Metrics of predictions.

Everything about classes comes from the confusion counts, one small pre-aggregated table, so
a frequent class costs no more than a rare one and the predictions are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """``label, prediction, n`` per group; rows without a prediction are left out."""
    return (
        df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction"))
        .agg(F.count("*").alias("n"))
    )


def _hits(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")


def within(tolerance: int) -> Column:
    return F.abs(F.col("label") - F.col("prediction")) <= tolerance


def accuracy(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return conf.groupBy(*by).agg(F.sum("n").alias("n"), _hits(within(0)).alias("accuracy"))


def tolerance_accuracy(conf: DataFrame, tolerance: int = 1, by: Sequence[str] = ()) -> DataFrame:
    return conf.groupBy(*by).agg(
        F.sum("n").alias("n"), _hits(within(tolerance)).alias("tolerance_accuracy"))


def tolerance_curve(conf: DataFrame, tolerances: Sequence[int] = (0, 1, 2, 3),
                    by: Sequence[str] = ()) -> DataFrame:
    """Accuracy for each tolerance, one pass over the counts."""
    points = F.array(*[F.struct(F.lit(t).alias("tolerance"), F.col(f"t{t}").alias("accuracy"))
                       for t in tolerances])
    wide = conf.groupBy(*by).agg(*[_hits(within(t)).alias(f"t{t}") for t in tolerances])
    return wide.select(*by, F.inline(points))


def class_scores(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where a denominator is 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hits")),
    )
    totals = conf.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return totals.select(
        *by, "class",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def _weighted(c: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")), F.lit(0.0))


def weighted_f1(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_scores(conf, by).groupBy(*by).agg(_weighted("f1").alias("f1_weighted"))


def classification_report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per class and the rows ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = class_scores(conf, by)
    per_class = scores.withColumn("class", F.col("class").cast("string"))
    total = F.sum("support").alias("support")
    macro = scores.groupBy(*by).agg(
        F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total)
    weighted = scores.groupBy(*by).agg(
        F.lit("weighted avg").alias("class"), _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"), _weighted("f1").alias("f1"), total)
    overall = accuracy(conf, by).select(
        *by, F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
        F.col("n").alias("support"))
    return per_class.unionByName(overall).unionByName(macro).unionByName(weighted)


def confusion_normalised(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Full label grid with the share of each actual class; an empty class gives zeros."""
    classes = conf.select(*by, F.explode(F.array("label", "prediction")).alias("class")).distinct()
    domain = classes.groupBy(*by).agg(F.sort_array(F.collect_set("class")).alias("classes"))
    grid = domain.select(*by, F.explode("classes").alias("label"), "classes").select(
        *by, "label", F.explode("classes").alias("prediction"))
    totals = Window.partitionBy(*by, "label")
    return (
        grid.join(conf, [*by, "label", "prediction"], "left")
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("bigint")))
        .withColumn("share", F.coalesce(
            F.try_divide(F.col("n").cast("double"), F.sum("n").over(totals).cast("double")), F.lit(0.0)))
    )


def per_class_accuracy(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return conf.groupBy(*by, "label").agg(F.sum("n").alias("n"), _hits(within(0)).alias("accuracy"))


def top_confusions(conf: DataFrame, by: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Most frequent wrong pairs per group, ranked; ties go to the smaller label, then prediction."""
    wrong = conf.filter(F.col("label") != F.col("prediction"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "label", "prediction")
    return wrong.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def label_domain(conf: DataFrame) -> DataFrame:
    """Labels that occur as actual or as predicted."""
    return conf.select(F.col("label").alias("class")).union(conf.select("prediction")).distinct()


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 in one pass."""
    rows = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    e = F.col(label) - F.col(prediction)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg((e * e).cast("double")), F.var_pop(label))).alias("r2"),
    )


def slot_metrics(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, mean error in slots and shares within one and two slots."""
    off = F.abs(F.col("label") - F.col("prediction"))
    return conf.groupBy(*by).agg(
        F.sum("n").alias("n"), _hits(within(0)).alias("accuracy"),
        (F.sum(off * F.col("n")) / F.sum("n")).alias("mae_slots"),
        _hits(within(1)).alias("within_1"), _hits(within(2)).alias("within_2"),
    )


def residual_stats(df: DataFrame, residual: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(residual.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(residual).alias("mean"), F.stddev_samp(residual).alias("std"),
        F.avg(F.abs(residual)).alias("mae"))


def residual_histogram(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    error = (F.col("prediction") - F.col("label")).cast("int").alias("error")
    return conf.groupBy(*by, error).agg(F.sum("n").alias("n"))


def model_vs_baseline(df: DataFrame, label: str, model: str, baseline: str, group: str,
                      tolerance: int = 1) -> DataFrame:
    """Both accuracies, both tolerance accuracies and the lift, per group and ``overall``."""
    rows = df.filter(F.col(label).isNotNull() & F.col(model).isNotNull() & F.col(baseline).isNotNull())
    hit = lambda p, t: F.avg((F.abs(F.col(label) - F.col(p)) <= t).cast("double"))
    wide = rows.rollup(group).agg(
        F.count("*").alias("n"),
        hit(baseline, 0).alias("baseline_accuracy"), hit(model, 0).alias("model_accuracy"),
        hit(baseline, tolerance).alias("baseline_tolerance"), hit(model, tolerance).alias("model_tolerance"))
    return wide.select(
        F.coalesce(F.col(group), F.lit("overall")).alias(group), "n",
        "baseline_accuracy", "model_accuracy",
        (F.col("model_accuracy") - F.col("baseline_accuracy")).alias("accuracy_lift"),
        "baseline_tolerance", "model_tolerance",
        (F.col("model_tolerance") - F.col("baseline_tolerance")).alias("tolerance_lift"))


def distribution_compare(conf: DataFrame, first_slot: int = 18) -> DataFrame:
    """Rows per slot, actual beside predicted, from ``first_slot`` on."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("slot"), F.col("n").alias("actual"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("slot"), zero.alias("actual"), F.col("n").alias("predicted")))
    return (
        conf.select(F.inline(sides)).filter(F.col("slot") >= first_slot)
        .groupBy("slot").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
        .orderBy("slot")
    )


def top_by_magnitude(df: DataFrame, value: str, top: int) -> DataFrame:
    """Rows with the largest absolute value, by a per-task heap rather than a sort."""
    return df.orderBy(F.abs(F.col(value)).desc(), *[c for c in df.columns if c != value]).limit(top)


def assert_no_leakage(features: Sequence[str], banned: Sequence[str]) -> None:
    leaked = sorted(set(features) & set(banned))
    if leaked:
        raise ValueError(f"leaking columns among the features: {leaked}")
