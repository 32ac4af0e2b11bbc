"""Queries that train, store and use models.

Fits have no SQL counterpart; the queries return what SQL can prove about them: keys, bands, row
counts, and whether slots, probabilities and scores are where they must be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.catalog import roles
from slotlake.catalog.registry import query, r6, table
from slotlake.catalog.tables import EVENT_FEATURES_SQL
from slotlake.config import (
    FOREST_SEARCH_SPACE, MEAL_BANDS, TWO_BANDS, Band, BoostSettings, Choice, ForestSettings, Whole, resolve_granularity,
)
from slotlake.operators import evaluate, split
from slotlake.operators.cleaning import fill_numeric, numeric_columns
from slotlake.plans import boosting, etl, importance, linear, scoring, search, training
from slotlake.schema import BOOKING_RECORD, FEATURE_COLUMNS
from slotlake.session import freeze, new_path
from slotlake.sources import payload
from slotlake.streaming import scorer

# sized for one machine; the defaults of the settings are the production sizes
FOREST = ForestSettings(trees=10, depth=5)
BOOST = BoostSettings(rounds=5, depth=3)
TARGET, LEAKAGE = resolve_granularity("half_hour")


def feature_rows(spark, sf):
    """The feature table of all event bookings, filled by the mean, with the booking id."""
    features = etl.build_features(
        roles.event_bookings(spark, sf), roles.restaurants(spark, sf), roles.members(spark, sf),
        keep=["booking_id"], holidays=roles.HOLIDAYS_2024)
    features = freeze(features, "features")
    whole = {"booking_id", *K.TIME_SIBLINGS}
    return fill_numeric(features, "mean", columns=[c for c in numeric_columns(features) if c not in whole])


def model_features(df):
    return training.candidate_features(df, TARGET, LEAKAGE, ["booking_id"])


def _forest():
    return training.forest_classifier(FOREST)


def _boosted():
    return training.boosted_classifier(BOOST)


def _trained(spark, sf, estimator=_forest):
    df = feature_rows(spark, sf)
    return df, *training.train_bands(df, TARGET, "booking_id", model_features(df), estimator)


# --- linear models --------------------------------------------------------------------------------


@query("ols_simple", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag""")
def ols_simple(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"),
        r6(F.regr_r2(y, x)).alias("r2"))


@query("linear_closed_form", """
SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity) * stddev_pop(l_quantity), 3) AS coefficient,
       count(*) AS n_predicted, round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*)), 3) AS rmse
FROM lineitem""")
def linear_closed_form(spark, sf):
    """Least squares on one input, where slope and error have a closed form."""
    rows = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    model = training.fit_linear(rows, "l_extendedprice", ["l_quantity"])
    error = F.col("prediction") - F.col("l_extendedprice")
    fit = model.predict(rows, ["l_extendedprice"]).agg(
        F.count("prediction").alias("n_predicted"), F.round(F.sqrt(F.avg(error * error)), 3).alias("rmse"))
    return model.coefficients().select("feature", F.round("coefficient", 3).alias("coefficient")).crossJoin(fit)  # one row each


@query("linear_regression", f"""
WITH {EVENT_FEATURES_SQL}, train AS (SELECT * FROM feat WHERE NOT {roles.is_test_sql('booking_id')}),
levels AS (SELECT count(DISTINCT dining_purpose) + count(DISTINCT booked_by_gender) + count(DISTINCT account_gender)
                  + count(DISTINCT CASE WHEN booking_hour <> 0 THEN booking_hour END)
                  + count(DISTINCT CASE WHEN weekday <> 1 THEN weekday END) + count(DISTINCT popular_hour) AS n FROM train)
SELECT count(*) AS n_train, (SELECT count(*) FROM feat) - count(*) AS n_predicted,
       19 + (SELECT n FROM levels) AS n_coefficients, true AS balanced, true AS orthogonal, true AS sound FROM train""")
def linear_regression(spark, sf):
    """Seconds of the day on all features, one-hot and scaled, fitted on the training rows, judged on the others. The
    residuals of the training rows add up to zero in every level, and with every number."""
    df, target = feature_rows(spark, sf), "reservation_seconds"
    features = training.candidate_features(df, target, (), ["booking_id"])
    train, test = split.split_random(df, "booking_id")
    model = linear.fit_least_squares(train, target, features)
    zero = F.bool_and(F.abs("total") <= 1e-7 * F.col("size"))
    sums = linear.residual_sums(model, train, target).groupBy(F.col("level").isNotNull().alias("l")).agg(zero.alias("zero"))
    zeros = {r.l: r.zero for r in sums.collect()}
    predicted = freeze(model.predict(test).select(target, "prediction"), "predicted")
    fit = evaluate.regression_metrics(predicted, target, "prediction")
    return predicted.agg(F.count("prediction").alias("n_predicted")).crossJoin(fit).select(  # one row each
        F.lit(model.n_rows).cast("long").alias("n_train"), "n_predicted", F.lit(model.coefficients().count()).cast("long").alias("n_coefficients"),
        F.lit(zeros[True]).alias("balanced"), F.lit(zeros[False]).alias("orthogonal"), ((F.col("rmse") > 0) & (F.col("r2") <= 1)).alias("sound"))


# --- classifiers and regressors -----------------------------------------------------------------------

_BANDS_SQL = f"SELECT subset, count(*) AS n, true AS sound FROM ({roles.SLOTTED_SQL}) WHERE is_test AND subset <> '_unmatched' GROUP BY subset"
_TEST_SQL = f"SELECT count(*) AS n, true AS sound FROM ({roles.SLOTTED_SQL}) WHERE is_test"


def _share(*columns):
    """Whether all columns are shares."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).between(0, 1)
    return out


def _sound_summary(predicted):
    scores = training.summary(predicted)
    sound = _share("accuracy", "f1_weighted", "tolerance_accuracy") & (F.col("tolerance_accuracy") >= F.col("accuracy"))
    return scores.select("subset", "n", sound.alias("sound"))


@query("rf_classifier", _BANDS_SQL)
def rf_classifier(spark, sf):
    return _sound_summary(_trained(spark, sf)[2])


@query("gbt_classifier", _BANDS_SQL)
def gbt_classifier(spark, sf):
    return _sound_summary(_trained(spark, sf, _boosted)[2])


def _regression(spark, sf, estimator, target="reservation_seconds"):
    df = feature_rows(spark, sf)
    features = training.candidate_features(df, target, K.TIME_SIBLINGS, ["booking_id"])
    train, test = split.split_random(df, "booking_id")
    return training.fit_regressor(train, target, features, estimator), test


def _sound_error(model, test):
    """Every test row has a prediction, within the range of a day."""
    seconds = F.col("prediction")
    return model.predict(test).agg(F.count(seconds).alias("n"), F.bool_and(seconds.between(0, 86_400)).alias("sound"))


@query("rf_regressor", _TEST_SQL)
def rf_regressor(spark, sf):
    return _sound_error(*_regression(spark, sf, training.forest_regressor(FOREST)))


@query("gbt_regressor", _TEST_SQL)
def gbt_regressor(spark, sf):
    return _sound_error(*_regression(spark, sf, training.boosted_regressor(BOOST)))


@query("ordinal_slot_regression", _TEST_SQL)
def ordinal_slot_regression(spark, sf):
    model, test = _regression(spark, sf, training.boosted_regressor(BOOST, "absolute"), TARGET)
    slot = F.col("prediction")
    return training.predict_slots(model, test).agg(F.count(slot).alias("n"), F.bool_and(slot.between(0, 47)).alias("sound"))


@query("softmax_boosting", f"""
WITH classes AS (SELECT subset, slot, count(*) AS k FROM ({roles.SLOTTED_SQL}) WHERE NOT is_test AND subset <> '_unmatched' GROUP BY ALL),
train AS (SELECT subset, CAST(sum(k) AS BIGINT) AS n_train, round(ln(sum(k)) - sum(k * ln(k)) / sum(k), 6) AS first_loss FROM classes GROUP BY subset)
SELECT t.subset, n_train, first_loss, n, true AS falls, true AS shares
FROM train t JOIN ({_BANDS_SQL}) b ON t.subset = b.subset""")
def softmax_boosting(spark, sf):
    """One loss over all slots of a band. It starts as the entropy of the slots and falls every round; the probabilities
    of every test row are shares of one."""
    df, parts = feature_rows(spark, sf), []
    for band in MEAL_BANDS:
        train, test = split.split_random(_band_rows(df, band), "booking_id")
        model = boosting.fit_softmax(train, TARGET, model_features(df), BOOST)
        losses = model.losses()
        falls = len(losses) > 1 and all(b < a for a, b in zip(losses, losses[1:]))
        p = F.col("probabilities")
        one = F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
        parts.append(model.probabilities(test).agg(
            F.lit(band.name).alias("subset"), F.lit(sum(model.rounds[0].rows[0])).alias("n_train"), r6(F.lit(losses[0])).alias("first_loss"),
            F.count("*").alias("n"), F.lit(falls).alias("falls"), F.bool_and(one & F.forall(p, lambda x: x.between(0, 1))).alias("shares")))
    return reduce(DataFrame.unionByName, parts).select("subset", F.col("n_train").cast("long").alias("n_train"), "first_loss", "n", "falls", "shares")


@query("absolute_boosting", f"""
WITH train AS (SELECT slot, median(slot) OVER () AS middle FROM ({roles.SLOTTED_SQL}) WHERE NOT is_test)
SELECT count(*) AS n_train, round(avg(abs(slot - middle)), 6) AS first_error, true AS falls, true AS medians,
       (SELECT count(*) FROM ({roles.SLOTTED_SQL}) WHERE is_test) AS n, true AS slots FROM train""")
def absolute_boosting(spark, sf):
    """Slots by absolute error. The first error is that of the median slot and never rises; each leaf adds the
    exact median of what is left in it, here compared with the engine's own; predictions are slots."""
    df = feature_rows(spark, sf)
    features = training.candidate_features(df, TARGET, K.TIME_SIBLINGS, ["booking_id"])
    train, test = split.split_random(df, "booking_id")
    same = []

    def compare(rows, done):
        left = F.col("label") - F.get("scores", F.lit(0))
        own = rows.groupBy(F.get("_leaves", F.lit(0)).alias("leaf")).agg(F.percentile(left, F.lit(0.5)).alias("m"))
        same.extend(abs(done.values[0][r.leaf] - r.m) < 1e-9 for r in own.collect())  # one row a leaf

    model = boosting.fit_absolute(train, TARGET, features, BOOST, compare)
    losses, slot = model.losses(), F.col("prediction")
    falls = all(b <= a for a, b in zip(losses, losses[1:]))
    return boosting.predict_slots(model, test).agg(
        F.lit(sum(model.rounds[0].rows[0])).cast("long").alias("n_train"), r6(F.lit(losses[0])).alias("first_error"), F.lit(falls).alias("falls"),
        F.lit(all(same)).alias("medians"), F.count(slot).alias("n"), F.bool_and(slot.between(0, 47)).alias("slots"))


@query("feature_importance", f"""
SELECT DISTINCT subset, CAST(25 AS BIGINT) AS n_features, 1.0::DOUBLE AS total FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched'""")
def feature_importance(spark, sf):
    """All features of every band; their shares add up to one."""
    _, models, _ = _trained(spark, sf)
    tables = [training.feature_importance(m.model).withColumn("subset", F.lit(m.band.name)) for m in models]
    return reduce(DataFrame.unionByName, tables).groupBy("subset").agg(
        F.count("*").alias("n_features"), r6(F.sum("importance")).alias("total"))


@query("gain_importance", f"""
SELECT subset, feature, 1.0::DOUBLE AS total, true AS sound FROM (SELECT DISTINCT subset FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched')
CROSS JOIN (SELECT unnest({list(FEATURE_COLUMNS)!r}) AS feature)""")
def gain_importance(spark, sf):
    """Gain times rows over all splits of all trees of every band; shares of a band add up to one."""
    _, models, _ = _trained(spark, sf)
    parts = [importance.gain_importance(m.model).withColumn("subset", F.lit(m.band.name)) for m in models]
    found = freeze(reduce(DataFrame.unionByName, parts), "gains")
    total = found.groupBy("subset").agg(r6(F.sum("share")).alias("total"))
    used = (F.col("n_splits") > 0) == (F.col("gain") > 0)
    return found.join(total, "subset").select("subset", "feature", "total", (used & _share("share")).alias("sound"))


@query("permutation_importance", f"""
SELECT b.subset, CAST(26 AS BIGINT) AS n_features, b.n, 0.0::DOUBLE AS constant, true AS sound FROM ({_BANDS_SQL}) b""")
def permutation_importance(spark, sf):
    """What each feature shuffled costs on all test rows of a band. A constant column costs nothing."""
    df, parts = feature_rows(spark, sf).withColumn("constant", F.lit(1.0)), []
    for band in MEAL_BANDS:
        train, test = split.split_random(_band_rows(df, band), "booking_id")
        model = training.fit_classifier(train, TARGET, model_features(df), _forest())
        found = importance.permutation_importance(model, test, TARGET, "booking_id")
        parts.append(found.agg(
            F.lit(band.name).alias("subset"), F.count("*").alias("n_features"), F.max("n").alias("n"),
            F.max(F.when(F.col("feature") == "constant", F.col("importance"))).alias("constant"),
            F.bool_and(F.col("importance").between(-1, 1)).alias("sound")))
    return reduce(DataFrame.unionByName, parts)


@query("train_summary", f"""
SELECT subset, count(*) AS n_samples, CAST(count_if(is_test) AS BIGINT) AS n, true AS sound FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched' GROUP BY subset""")
def train_summary(spark, sf):
    _, models, predicted = _trained(spark, sf)
    sizes = spark.createDataFrame([(m.band.name, m.n_rows) for m in models], "subset STRING, n_samples BIGINT")
    return sizes.join(_sound_summary(predicted), "subset")


def _band_rows(df, band):
    return df.filter(F.col("reservation_hour").between(band.first, band.last))


def _sound_folds(scores):
    return scores.select(*[c for c in ("subset", "variant") if c in scores.columns],
                         (_share("cv_acc_mean", "cv_f1_mean") & (F.col("cv_acc_std") >= 0)).alias("sound"))


@query("cv_model", f"SELECT DISTINCT subset, true AS sound FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched'")
def cv_model(spark, sf):
    """Five folds on every band."""
    df = feature_rows(spark, sf)
    parts = [training.cross_validate(_band_rows(df, b), TARGET, "booking_id", model_features(df), _forest).withColumn("subset", F.lit(b.name))
             for b in MEAL_BANDS]
    return _sound_folds(reduce(DataFrame.unionByName, parts))


@query("param_search", f"""
SELECT subset, CAST(trial AS INT) AS trial, true AS sound
FROM (SELECT DISTINCT subset FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched') CROSS JOIN range(2) AS t(trial)""")
def param_search(spark, sf):
    """Random search on every band; the ranges are narrow and the trials few so that one machine bears it."""
    df = feature_rows(spark, sf)
    space = {"trees": Choice((5, 10)), "depth": Whole(2, 5), "min_leaf": Whole(2, 20)}
    parts = []
    for band in MEAL_BANDS:
        _, trials = training.search_params(
            _band_rows(df, band), TARGET, "booking_id", model_features(df),
            lambda p: training.forest_classifier(ForestSettings(p["trees"], p["depth"], p["min_leaf"])), space, trials=2)
        parts.append(trials.select(F.lit(band.name).alias("subset"), "trial", _share("cv_acc_mean").alias("sound")))
    return reduce(DataFrame.unionByName, parts)


@query("sequential_search", f"""
SELECT subset, origin, CAST(n_folds AS INT) AS n_folds, CAST(n AS BIGINT) AS n, true AS sound
FROM (SELECT DISTINCT subset FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched')
CROSS JOIN (VALUES ('random'), ('density')) AS o(origin) CROSS JOIN (VALUES (1, 2), (5, 1)) AS f(n_folds, n)""")
def sequential_search(spark, sf):
    """Draws from the whole declared space on every band, two batches of three trials: of each batch one trial sees all five
    folds, two see one. Fits grow a twentieth of the drawn trees, as ``FOREST`` does, so that one machine bears it."""
    df = feature_rows(spark, sf)

    def judged(band):
        best, trials = search.search(
            _band_rows(df, band), TARGET, "booking_id", model_features(df),
            lambda p: training.forest_classifier(ForestSettings(p["trees"] // 20, p["depth"], p["min_leaf"])), FOREST_SEARCH_SPACE,
            trials=6, batch=3, threads=8)
        inside = F.lit(True)
        for name, values in FOREST_SEARCH_SPACE.items():
            drawn = F.col("params")[name].cast("int")
            inside = inside & (drawn.isin(*values.options) if isinstance(values, Choice) else drawn.between(values.low, values.high))
        return trials.groupBy("origin", "n_folds").agg(
            F.count("*").alias("n"), F.bool_and(_share("accuracy") & inside).alias("sound")).withColumn("subset", F.lit(band.name))

    # a batch ends with single fits, which would leave executors idle
    parts = training.in_parallel(judged, MEAL_BANDS)
    return reduce(DataFrame.unionByName, parts).select("subset", "origin", "n_folds", "n", "sound")


@query("feature_ablation", f"""
SELECT subset, variant, true AS sound FROM (SELECT DISTINCT subset FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched')
CROSS JOIN (VALUES ('all_geo'), ('codes_only'), ('latlng_only'), ('no_geo')) AS v(variant)""")
def feature_ablation(spark, sf):
    """Four feature sets, every band, five folds."""
    df = feature_rows(spark, sf)
    variants = training.geo_variants([*model_features(df), *K.GEO_CATEGORICAL_COLUMNS])
    small = lambda: training.forest_classifier(ForestSettings(trees=5, depth=4))
    return _sound_folds(training.ablate(df, variants, TARGET, "booking_id", small))


BAND_SETS = {"full": (Band("full", 0, 23),), "two-way": TWO_BANDS, "three-way": MEAL_BANDS}


@query("band_comparison", f"""
SELECT kind, band_set, n_bands, n, true AS sound
FROM (SELECT 'full' AS band_set, 1 AS n_bands, count(*) AS n FROM ({roles.SLOTTED_SQL}) WHERE is_test
      UNION ALL SELECT 'two-way', 2, count(*) FROM ({roles.SLOTTED_SQL}) WHERE is_test AND h BETWEEN 9 AND 23
      UNION ALL SELECT 'three-way', 3, count(*) FROM ({roles.SLOTTED_SQL}) WHERE is_test AND h BETWEEN 11 AND 23)
CROSS JOIN (VALUES ('classifier'), ('ordinal')) AS k(kind)""")
def band_comparison(spark, sf):
    """One model for all hours against one per band, two and three bands, on the same split."""
    df = feature_rows(spark, sf)
    found = training.compare_band_sets(
        df, TARGET, "booking_id", model_features(df), BAND_SETS, _forest, lambda: training.forest_regressor(FOREST))
    return found.select("kind", "band_set", "n_bands", "n", _share("accuracy", "f1_weighted", "tolerance_accuracy").alias("sound"))


# --- bundles and scoring --------------------------------------------------------------------------------


@query("model_roundtrip", f"""
SELECT subset, count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM ({roles.SLOTTED_SQL}) WHERE is_test GROUP BY subset""")
def model_roundtrip(spark, sf):
    """Predictions of a stored and reloaded bundle beside those of the models in memory."""
    df, models, _ = _trained(spark, sf)
    path = new_path(spark, "bundle")
    scoring.save_bundle(models, path, TARGET, LEAKAGE)
    _, test = split.split_random(df, "booking_id")
    loaded = scoring.load_bundle(spark, path)
    stored = scoring.score_rows(test, loaded, ["booking_id"])
    fresh = scoring.score_rows(test, scoring.bundle_of(models), ["booking_id"]).select(
        "booking_id", F.col("reservation_half_hour").alias("slot_in_memory"))
    return stored.join(fresh, "booking_id").groupBy("subset").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("reservation_half_hour").eqNullSafe(F.col("slot_in_memory"))).alias("n_different"))


@query("bundle_manifest", f"""
SELECT subset, CAST(min(h) AS INT) AS hour_min, CAST(max(h) AS INT) AS hour_max,
       CAST(count(DISTINCT CASE WHEN NOT is_test THEN slot END) AS INT) AS n_classes, 25 AS n_features
FROM ({roles.SLOTTED_SQL}) WHERE subset <> '_unmatched' GROUP BY subset""")
def bundle_manifest(spark, sf):
    _, models, _ = _trained(spark, sf)
    path = new_path(spark, "bundle")
    scoring.save_bundle(models, f"{path}/nested/deeper", TARGET, LEAKAGE)
    return scoring.manifest_table(spark, scoring.load_bundle(spark, path).manifest)


_SCORED_SQL = f"""
SELECT booking_id, subset, true AS sound FROM (SELECT event_id AS booking_id, subset FROM ({roles.SLOTTED_SQL}) WHERE %s)"""


def _sound_score():
    """A slot of the band with a probability, or nothing outside the bands."""
    hour = F.floor(F.col("reservation_half_hour") / 2)
    inside = F.lit(False)
    for band in MEAL_BANDS:
        inside = inside | ((F.col("subset") == band.name) & hour.between(band.first, band.last))
    none = (F.col("subset") == K.UNMATCHED) & F.col("reservation_half_hour").isNull() & F.col("probability").isNull()
    return F.coalesce(inside & _share("probability"), F.lit(False)) | none


@query("score_batch", _SCORED_SQL % "is_test")
def score_batch(spark, sf):
    df, models, _ = _trained(spark, sf)
    _, test = split.split_random(df, "booking_id")
    scored = scoring.run_inference(test, scoring.bundle_of(models), ["booking_id"])
    return scored.select("booking_id", "subset", _sound_score().alias("sound"))


def full_requests(df):
    """A scoring request per eight consecutive bookings, with all fields of the contract."""
    names = [f.name for f in BOOKING_RECORD if f.name in df.columns]
    entry = F.struct("booking_id", payload.json_array(names).alias("row"))
    grouped = df.groupBy(F.floor(F.col("booking_id") / 8).cast("bigint").alias("request_id")).agg(
        F.sort_array(F.collect_list(entry)).alias("rows"))
    columns = ",".join(f'"{n}"' for n in names)
    return grouped.select("request_id", F.concat(
        F.lit(f'{{"input_data":{{"columns":[{columns}],"index":['), F.array_join(F.transform("rows", lambda r: r["booking_id"].cast("string")), ","),
        F.lit('],"data":['), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]}}")).alias("payload"))


@query("score_payload", f"""
SELECT event_id // 8 AS request_id, count(*) AS n_rows, sum(event_id)::BIGINT AS sum_labels, true AS sound
FROM ({roles.SLOTTED_SQL}) GROUP BY 1""")
def score_payload(spark, sf):
    """Requests with all fields; every one is answered once, row for row."""
    df, models, _ = _trained(spark, sf)
    documents, _ = scoring.score_payloads(full_requests(df), scoring.bundle_of(models))
    shape = "predictions STRUCT<columns: ARRAY<STRING>, index: ARRAY<BIGINT>, data: ARRAY<ARRAY<STRING>>>"
    body = F.from_json("document", shape)["predictions"]
    sound = (F.size(body["index"]) == F.size(body["data"])) & (F.size(body["columns"]) == 4)
    total = F.aggregate(body["index"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    return documents.select("request_id", F.size(body["data"]).cast("bigint").alias("n_rows"), total.alias("sum_labels"), sound.alias("sound"))


@query("score_stream", f"""
SELECT booking_id, {roles.band_sql('hour(datetime)')} AS subset, true AS as_in_batch FROM ({roles.EVENT_BOOKINGS_SQL})""")
def score_stream(spark, sf):
    """Arriving bookings joined, featured and scored; slot and probability agree with batch scoring of the same rows."""
    df, models, _ = _trained(spark, sf)
    bundle = scoring.bundle_of(models)
    stage = new_path(spark, "arriving")
    df.repartition(4, "booking_id").write.parquet(stage)
    stream = scorer.read_stream(spark, stage, df.schema)
    output = new_path(spark, "scored")
    scorer.start_scoring(stream, lambda rows: scoring.score_rows(rows, bundle, ["booking_id"], stage=False), output,
                         new_path(spark, "scored-checkpoint")).awaitTermination()
    batch = scoring.score_rows(df, bundle, ["booking_id"]).select(
        "booking_id", F.col("reservation_half_hour").alias("_slot"), F.col("probability").alias("_p"))
    same = F.col("reservation_half_hour").eqNullSafe(F.col("_slot")) & F.col("probability").eqNullSafe(F.col("_p"))
    return spark.read.parquet(output).join(batch, "booking_id").select("booking_id", "subset", same.alias("as_in_batch"))
