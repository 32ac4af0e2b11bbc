"""Queries that evaluate predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotlake.catalog import roles
from slotlake.catalog.registry import comparable, query, table
from slotlake.catalog.roles import PREDICTIONS_SQL
from slotlake.config import MEAL_BANDS, OVERLAPPING_BANDS, TWO_BANDS
from slotlake.operators import evaluate, profile, routing
from slotlake.operators.split import stratified_folds
from slotlake.plans.training import scores_by_fold, summarise_folds

_BY = ["subset"]


def _conf(spark, sf, by=()):
    return evaluate.confusion(roles.predictions(spark, sf), by=by)


@query("eval_accuracy", f"""
WITH {PREDICTIONS_SQL} SELECT subset, count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY subset""")
def eval_accuracy(spark, sf):
    return comparable(evaluate.accuracy(_conf(spark, sf, _BY), _BY))


_CLASSES_SQL = """
cls AS (SELECT label AS class FROM pred UNION SELECT prediction FROM pred),
sc AS (SELECT c.class, (SELECT count(*) FROM pred WHERE label = c.class) AS support,
              (SELECT count(*) FROM pred WHERE prediction = c.class) AS predicted,
              (SELECT count(*) FROM pred WHERE label = c.class AND prediction = c.class) AS hits FROM cls c),
f AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS p,
             CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r,
             CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * hits / (support + predicted) END AS f1 FROM sc)"""


@query("eval_weighted_f1", f"""
WITH {PREDICTIONS_SQL.replace('sc AS', 'slc AS').replace('FROM sc)', 'FROM slc)')}, {_CLASSES_SQL}
SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f""")
def eval_weighted_f1(spark, sf):
    return comparable(evaluate.weighted_f1(_conf(spark, sf)))


@query("classification_report", f"""
WITH {PREDICTIONS_SQL.replace('sc AS', 'slc AS').replace('FROM sc)', 'FROM slc)')}, {_CLASSES_SQL}
SELECT CAST(class AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6), count(*) FROM pred
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, sf):
    return comparable(evaluate.classification_report(_conf(spark, sf)))


@query("eval_tolerance", f"""
WITH {PREDICTIONS_SQL} SELECT subset, count(*) AS n, round(avg(CASE WHEN abs(label - prediction) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS tolerance_accuracy
FROM pred GROUP BY subset""")
def eval_tolerance(spark, sf):
    return comparable(evaluate.tolerance_accuracy(_conf(spark, sf, _BY), 1, _BY))


@query("tolerance_curve", f"""
WITH {PREDICTIONS_SQL}, both_models AS (
    SELECT 'model' AS source, subset, label, prediction FROM pred UNION ALL SELECT 'baseline', subset, label, baseline FROM pred)
SELECT source, subset, CAST(t AS INT) AS tolerance, round(avg(CASE WHEN abs(label - prediction) <= t THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM both_models, (VALUES (0), (1), (2), (3)) v(t) GROUP BY 1, 2, 3""")
def tolerance_curve(spark, sf):
    p = roles.predictions(spark, sf)
    both = p.select("subset", "label", F.inline(F.array(
        F.struct(F.lit("model").alias("source"), F.col("prediction").alias("prediction")),
        F.struct(F.lit("baseline").alias("source"), F.col("baseline").alias("prediction")))))
    by = ["source", "subset"]
    return comparable(evaluate.tolerance_curve(evaluate.confusion(both, by=by), by=by))


@query("confusion_matrix", f"WITH {PREDICTIONS_SQL} SELECT subset, label, prediction, count(*) AS n FROM pred GROUP BY 1, 2, 3")
def confusion_matrix(spark, sf):
    return _conf(spark, sf, _BY)


@query("confusion_normalised", f"""
WITH {PREDICTIONS_SQL}, cls AS (SELECT label AS class FROM pred UNION SELECT prediction FROM pred),
n AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2), tot AS (SELECT label, count(*) AS t FROM pred GROUP BY 1)
SELECT a.class AS label, b.class AS prediction, coalesce(n.n, 0) AS n, round(coalesce(n.n / tot.t, 0.0), 6) AS share
FROM cls a CROSS JOIN cls b LEFT JOIN n ON n.label = a.class AND n.prediction = b.class LEFT JOIN tot ON tot.label = a.class""")
def confusion_normalised(spark, sf):
    return comparable(evaluate.confusion_normalised(_conf(spark, sf)))


@query("per_class_accuracy", f"""
WITH {PREDICTIONS_SQL} SELECT label, count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred GROUP BY 1""")
def per_class_accuracy(spark, sf):
    return comparable(evaluate.per_class_accuracy(_conf(spark, sf)))


@query("top_confusions", f"""
WITH {PREDICTIONS_SQL}, w AS (SELECT subset, label, prediction, count(*) AS n FROM pred WHERE label <> prediction GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subset ORDER BY n DESC, label, prediction) AS INT) AS rank FROM w) WHERE rank <= 5""")
def top_confusions(spark, sf):
    return evaluate.top_confusions(_conf(spark, sf, _BY), _BY)


@query("label_domain", f"WITH {PREDICTIONS_SQL} SELECT label AS class FROM pred UNION SELECT prediction FROM pred")
def label_domain(spark, sf):
    return evaluate.label_domain(_conf(spark, sf))


@query("eval_regression", """
WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
       round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM p GROUP BY 1""")
def eval_regression(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000).alias("prediction"))
    found = evaluate.regression_metrics(rows, by=["l_returnflag"])
    return found.select("l_returnflag", "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                        F.round("r2", 6).alias("r2"))


@query("eval_slot_regression", f"""
WITH {PREDICTIONS_SQL}
SELECT subset, count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(abs(label - prediction)), 6) AS mae_slots,
       round(avg(CASE WHEN abs(label - prediction) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_1,
       round(avg(CASE WHEN abs(label - prediction) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS within_2 FROM pred GROUP BY subset""")
def eval_slot_regression(spark, sf):
    return comparable(evaluate.slot_metrics(_conf(spark, sf, _BY), _BY))


@query("residual_stats", f"""
WITH {PREDICTIONS_SQL}
SELECT subset, count(*) AS n, round(avg((label - prediction) * 30), 6) AS mean, round(stddev_samp((label - prediction) * 30), 6) AS std,
       round(avg(abs(label - prediction) * 30), 6) AS mae FROM pred GROUP BY subset""")
def residual_stats(spark, sf):
    minutes = (F.col("label") - F.col("prediction")) * 30
    return comparable(evaluate.residual_stats(roles.predictions(spark, sf), minutes, _BY))


@query("residual_hist", f"WITH {PREDICTIONS_SQL} SELECT subset, prediction - label AS error, count(*) AS n FROM pred GROUP BY 1, 2")
def residual_hist(spark, sf):
    return evaluate.residual_histogram(_conf(spark, sf, _BY), _BY)


_VERSUS_SQL = """
count(*) AS n, avg(CASE WHEN label = baseline THEN 1.0 ELSE 0.0 END) AS ba, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS ma,
avg(CASE WHEN abs(label - baseline) <= 1 THEN 1.0 ELSE 0.0 END) AS bt, avg(CASE WHEN abs(label - prediction) <= 1 THEN 1.0 ELSE 0.0 END) AS mt
FROM pred"""


@query("model_vs_baseline", f"""
WITH {PREDICTIONS_SQL}, v AS (SELECT subset, {_VERSUS_SQL} GROUP BY subset UNION ALL SELECT 'overall', {_VERSUS_SQL})
SELECT subset, n, round(ba, 6) AS baseline_accuracy, round(ma, 6) AS model_accuracy, round(ma - ba, 6) AS accuracy_lift,
       round(bt, 6) AS baseline_tolerance, round(mt, 6) AS model_tolerance, round(mt - bt, 6) AS tolerance_lift FROM v""")
def model_vs_baseline(spark, sf):
    return comparable(evaluate.model_vs_baseline(
        roles.predictions(spark, sf), "label", "prediction", "baseline", "subset"))


@query("overall_rollup", f"""
WITH {PREDICTIONS_SQL}
SELECT subset, count(*) AS n, round(avg(prediction - label), 6) AS mean_error, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY subset UNION ALL SELECT NULL, count(*), round(avg(prediction - label), 6), round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) FROM pred""")
def overall_rollup(spark, sf):
    return comparable(profile.segment_summary(roles.predictions(spark, sf), _BY, {
        "mean_error": F.avg(F.col("prediction") - F.col("label")),
        "accuracy": F.avg((F.col("label") == F.col("prediction")).cast("double"))}, totals="rollup"))


@query("distribution_compare", f"""
WITH {PREDICTIONS_SQL}, s AS (SELECT label AS slot, 1 AS a, 0 AS p FROM pred UNION ALL SELECT prediction, 0, 1 FROM pred)
SELECT slot, CAST(sum(a) AS BIGINT) AS actual, CAST(sum(p) AS BIGINT) AS predicted FROM s WHERE slot >= 18 GROUP BY 1""")
def distribution_compare(spark, sf):
    return evaluate.distribution_compare(_conf(spark, sf))


@query("topn_abs", """
SELECT s_suppkey, s_acctbal FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 20""")
def topn_abs(spark, sf):
    return evaluate.top_by_magnitude(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 20)


@query("subset_sizes", """
SELECT 'two' AS split, 'lunch2' AS subset, count(*) AS n FROM events WHERE hour(ts) BETWEEN 9 AND 14
UNION ALL SELECT 'two', 'dinner2', count(*) FROM events WHERE hour(ts) BETWEEN 15 AND 23
UNION ALL SELECT 'two', '_unmatched', count(*) FROM events WHERE hour(ts) < 9
UNION ALL SELECT 'overlapping', 'lunch', count(*) FROM events WHERE hour(ts) BETWEEN 10 AND 14
UNION ALL SELECT 'overlapping', 'afternoon', count(*) FROM events WHERE hour(ts) BETWEEN 14 AND 17
UNION ALL SELECT 'overlapping', 'dinner', count(*) FROM events WHERE hour(ts) BETWEEN 17 AND 23
UNION ALL SELECT 'overlapping', '_unmatched', count(*) FROM events WHERE hour(ts) < 10""")
def subset_sizes(spark, sf):
    rows = table(spark, sf, "events").select(F.hour("ts").alias("reservation_hour"))
    two = routing.band_sizes(rows, TWO_BANDS).select(F.lit("two").alias("split"), "subset", "n")
    return two.unionByName(
        routing.band_sizes(rows, OVERLAPPING_BANDS).select(F.lit("overlapping").alias("split"), "subset", "n"))


def _cv_sql(band: str) -> str:
    return f"""
SELECT '{band}' AS subset, * FROM (
WITH ev AS (SELECT event_id, slot, (row_number() OVER (PARTITION BY slot ORDER BY md5(CAST(event_id AS VARCHAR))) - 1) % 5 AS fold
            FROM ({roles.SLOTTED_SQL}) WHERE subset = '{band}'),
c AS (SELECT f.fold, e.slot, count(*) AS c FROM ev e JOIN (SELECT DISTINCT fold FROM ev) f ON e.fold <> f.fold GROUP BY 1, 2),
m AS (SELECT fold, slot AS guess FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY c DESC, slot) AS rn FROM c) WHERE rn = 1),
t AS (SELECT e.fold, count(*) AS n, sum(CASE WHEN e.slot = m.guess THEN 1 ELSE 0 END) AS hit FROM ev e JOIN m ON e.fold = m.fold GROUP BY 1),
s AS (SELECT hit / n AS acc, (hit / n) * (2.0 * hit / (hit + n)) AS f1 FROM t)
SELECT round(avg(acc), 6) AS cv_acc_mean, round(stddev_pop(acc), 6) AS cv_acc_std, round(avg(f1), 6) AS cv_f1_mean,
       round(stddev_pop(f1), 6) AS cv_f1_std FROM s)"""


@query("cv_baseline", " UNION ALL ".join(_cv_sql(b.name) for b in MEAL_BANDS))
def cv_baseline(spark, sf):
    """Cross-validation of the most-frequent-slot model on every band, without a loop over the folds."""
    held_out = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("fold"))
    parts = []
    for band in MEAL_BANDS:
        rows = roles.slotted_events(spark, sf).filter(F.col("subset") == band.name).select("event_id", "slot")
        marked = stratified_folds(rows, "slot", "event_id")
        guesses = routing.fit_most_frequent(marked.select("slot", F.explode(held_out).alias("fold")), "slot", "fold")
        scored = routing.apply_most_frequent(marked, guesses, "fold")
        found = summarise_folds(scores_by_fold(evaluate.confusion(scored, "slot", "baseline", ["fold"])))
        parts.append(found.select(F.lit(band.name).alias("subset"), "*"))
    return comparable(parts[0].unionByName(parts[1]).unionByName(parts[2]))
