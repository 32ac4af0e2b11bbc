"""The scoring contract on a small bundle, and its parts."""

import json

import pytest
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.config import (
    BoostSettings, Choice, EvaluationSettings, ForestSettings, MEAL_BANDS, Real, Whole, resolve_granularity,
)
from slotlake.operators import evaluate
from slotlake.plans import scoring, training
from slotlake.schema import BOOKING_RECORD, FEATURE_COLUMNS
from slotlake.streaming import scorer

TARGET, LEAKAGE = resolve_granularity("half_hour")


@pytest.fixture(scope="module")
def features(spark):
    """Bookings whose slot depends on party size, so that a model has something to learn."""
    base = spark.range(900).select(F.col("id").alias("booking_id"), (F.col("id") % 13 + 11).cast("int").alias("reservation_hour"))
    numeric = [f.name for f in BOOKING_RECORD if f.name in FEATURE_COLUMNS and f.dataType.typeName() != "string"]
    party = (F.col("booking_id") % 2 + 1).cast("int")
    return base.withColumns({
        **{c: F.pmod(F.xxhash64("booking_id", F.lit(c)), F.lit(10)).cast("double") for c in numeric},
        "party_size": party,
        **{c: F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), F.pmod(F.xxhash64("booking_id", F.lit(c)), F.lit(3)).cast("int") + 1)
           for c in K.CATEGORICAL_COLUMNS},
        "reservation_half_hour": F.col("reservation_hour") * 2 + party - 1,
    })


@pytest.fixture(scope="module")
def trained(features):
    columns = training.candidate_features(features, TARGET, LEAKAGE, ["booking_id"])
    assert set(columns) == set(FEATURE_COLUMNS)
    return training.train_bands(features, TARGET, "booking_id", columns,
                                lambda: training.forest_classifier(ForestSettings(trees=5, depth=4)))


@pytest.fixture(scope="module")
def bundle(spark, trained, tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    scoring.save_bundle(trained[0], f"{root}/registered/bundle", TARGET, LEAKAGE)
    return scoring.load_bundle(spark, str(root))


EXAMPLE = [
    [12, 3, "家人用餐", "F", 1, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 25.05, 121.52, 0.0, "F", 287.87, 46.0, 15.0, 7, 844.5, 1, 3.0, 15, 0.377, 13],
    [19, 11, "朋友聚餐", "F", 1, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 25.03, 121.54, 0.0, "M", 53.45, 35.0, 10.0, 6, 488.5, 0, 12.0, 19, 0.771, 10],
    [16, 2, "朋友聚餐", "F", 1, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 22.63, 120.30, 0.0, "F", 69.23, 33.0, 15.0, 5, 505.0, 0, 7.0, 17, 0.625, 443],
]


def send(spark, bundle, data, columns=None):
    columns = columns or [f.name for f in BOOKING_RECORD]
    body = json.dumps({"input_data": {"columns": columns, "index": list(range(len(data))), "data": data}})
    requests = spark.createDataFrame([("r", body)], "request_id string, payload string")
    documents, rejected = scoring.score_payloads(requests, bundle)
    out = [json.loads(r["document"])["predictions"] for r in documents.collect()]
    return out, [r["problem"] for r in rejected.collect()]


def test_bundle_holds_every_band(bundle):
    assert set(bundle.models) == {"lunch", "afternoon", "dinner"}
    assert bundle.manifest["routing_column"] == "reservation_hour" and len(bundle.manifest["feature_columns"]) == 25


def test_missing_bundle(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scoring.find_bundle(spark, str(tmp_path))


def test_rows_go_to_their_band_and_slot_stays_inside(spark, bundle):
    (out,), rejected = send(spark, bundle, EXAMPLE)
    assert rejected == [] and out["columns"] == list(K.PREDICTION_COLUMNS) and out["index"] == [0, 1, 2]
    assert [row[2] for row in out["data"]] == ["lunch", "dinner", "afternoon"]
    limits = {b.name: (b.first, b.last) for b in MEAL_BANDS}
    for slot, time_range, subset, probability in out["data"]:
        assert limits[subset][0] <= slot // 2 <= limits[subset][1] and 0 <= probability <= 1
        assert time_range == f"{slot // 2:02d}:{slot % 2 * 30:02d}-{slot // 2:02d}:{slot % 2 * 30 + 29:02d}"


def test_hour_outside_the_bands(spark, bundle):
    (out,), _ = send(spark, bundle, [[5, *EXAMPLE[0][1:]], EXAMPLE[1]])
    assert out["data"][0] == [None, None, "_unmatched", None] and out["data"][1][2] == "dinner"


def test_missing_routing_column(spark, bundle, features):
    out, rejected = send(spark, bundle, [row[1:] for row in EXAMPLE], [f.name for f in BOOKING_RECORD][1:])
    assert out == [] and rejected == ["no routing column"]
    with pytest.raises(ValueError):
        scoring.score_rows(features.drop("reservation_hour"), bundle, ["booking_id"])


def test_unseen_category_still_predicts(spark, bundle):
    (out,), _ = send(spark, bundle, [[12, 3, "UNSEEN_PURPOSE", *EXAMPLE[0][3:]]])
    assert out["data"][0][2] == "lunch" and out["data"][0][0] is not None


def test_ragged_payload_is_rejected(spark, bundle):
    assert send(spark, bundle, [EXAMPLE[0][:-1]]) == ([], ["row width"])


def test_model_learns_and_beats_the_baseline(trained):
    summary = {r["subset"]: r for r in training.summary(trained[1]).collect()}
    assert set(summary) == {"lunch", "afternoon", "dinner"}
    assert all(r["tolerance_accuracy"] >= r["accuracy"] for r in summary.values())


def test_every_row_is_scored_once(features, bundle):
    mixed = features.withColumn("reservation_hour", F.when(F.col("booking_id") % 10 == 0, 3).otherwise(F.col("reservation_hour")))
    out = scoring.run_inference(mixed, bundle, ["booking_id"])
    assert out.count() == 900 and out.select("booking_id").distinct().count() == 900
    assert out.filter("subset = '_unmatched' and reservation_half_hour is null").count() == 90


def test_band_without_a_model_keeps_its_rows(features, bundle):
    partial = scoring.Bundle({k: v for k, v in bundle.models.items() if k != "dinner"}, bundle.bands, bundle.manifest)
    out = scoring.score_rows(features, partial, ["booking_id"])
    assert out.count() == 900
    assert out.filter("subset = 'dinner' and reservation_half_hour is not null").count() == 0


def test_absent_feature_is_treated_as_missing(features, bundle):
    out = scoring.score_rows(features.drop("lat", "dining_purpose"), bundle, ["booking_id"])
    assert out.filter("reservation_half_hour is null").count() == 0


def test_boosted_one_vs_rest_has_probabilities(features):
    lunch = features.filter("reservation_hour between 15 and 16")
    columns = training.candidate_features(lunch, TARGET, LEAKAGE, ["booking_id"])
    model = training.fit_classifier(lunch, TARGET, columns, training.boosted_classifier(BoostSettings(rounds=2, depth=2)))
    got = model.predict(lunch).agg(F.min("probability"), F.max("probability"), F.count_if(F.col("prediction_label").isNull())).first()
    assert 0 < got[0] <= got[1] <= 1 and got[2] == 0
    top = training.feature_importance(model, 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"]


def test_temporal_split_in_training(features):
    dated = features.withColumn("booking_time", F.timestamp_seconds("booking_id"))
    columns = training.candidate_features(dated, TARGET, LEAKAGE, ["booking_id"])
    _, predicted = training.train_band(dated, MEAL_BANDS[2], TARGET, "booking_id", columns,
                                       training.forest_classifier(ForestSettings(trees=2, depth=2)), EvaluationSettings(split="temporal"))
    held = dated.filter("reservation_hour between 18 and 23")
    assert predicted.agg(F.min("booking_id")).first()[0] > held.agg(F.expr("percentile(booking_id, 0.78)")).first()[0]


def test_cross_validation_and_search(features):
    rows = features.filter("reservation_hour between 15 and 16")
    columns = ["party_size", "lat", "dining_purpose"]
    score = training.cross_validate(rows, TARGET, "booking_id", columns, lambda: training.forest_classifier(ForestSettings(trees=2, depth=2)), 3).first()
    assert 0 <= score["cv_acc_mean"] <= 1 and score["cv_acc_std"] >= 0
    space = {"trees": Whole(1, 2), "depth": Choice((2,))}
    best, trials = training.search_params(rows, TARGET, "booking_id", columns,
                                          lambda p: training.forest_classifier(ForestSettings(p["trees"], p["depth"])), space, 1)
    assert best["depth"] == 2 and trials.count() == 1


def test_search_ranges():
    import random
    rng = random.Random(1)
    for _ in range(50):
        assert 0.01 <= Real(0.01, 0.3, log=True).draw(rng) <= 0.3 and 3 <= Whole(3, 5).draw(rng) <= 5
        assert Choice(("a", "b")).draw(rng) in ("a", "b") and -1 <= Real(-1, 1).draw(rng) <= 1


def test_linear_model_predicts_every_row(spark):
    df = spark.range(200).selectExpr("id", "CASE WHEN id % 4 <> 1 THEN CAST(id AS DOUBLE) END AS x", "CAST(2 * id AS DOUBLE) AS y")
    got = training.fit_linear(df, "y", ["x"]).predict(df, ["id", "y"])
    assert got.count() == 200 and got.filter("prediction IS NULL").count() == 50
    assert got.filter("abs(prediction - y) > 1e-6").count() == 0


def test_leaking_feature_is_refused(features):
    with pytest.raises(ValueError):
        training.fit_classifier(features, TARGET, ["party_size", "reservation_seconds"], training.forest_classifier())


def test_linear_model_recovers_a_line(spark):
    df = spark.range(400).select(
        F.col("id").cast("double").alias("x"), (F.col("id") % 7 + 1).cast("int").alias("weekday"),
        (3 * F.col("id") + 10 * (F.col("id") % 7)).cast("double").alias("y"))
    model = training.fit_linear(df, "y", ["x", "weekday"])
    got = evaluate.regression_metrics(model.predict(df, ["y"]), "y", "prediction").first()
    assert got["r2"] > 0.999999
    top = evaluate.top_by_magnitude(model.coefficients(), "coefficient", 1).first()
    assert top["feature"] == "x"


def test_geo_variants():
    sets = training.geo_variants(["a", "lat", "lng", "city_code"])
    assert sets == {"all_geo": ["a", "lat", "lng", "city_code"], "codes_only": ["a", "city_code"],
                    "latlng_only": ["a", "lat", "lng"], "no_geo": ["a"]}


def test_stream_scores_arriving_files_once(spark, features, bundle, tmp_path):
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = features.drop("reservation_half_hour")
    rows.filter("booking_id < 500").write.parquet(source)
    score = lambda df: scoring.score_rows(df, bundle, ["booking_id"], stage=False)

    def run():
        stream = scorer.read_stream(spark, source, rows.schema, max_files=1)
        scorer.start_scoring(stream, score, output, checkpoint).awaitTermination()
        return spark.read.parquet(output)

    assert run().count() == 500
    rows.filter("booking_id >= 500").write.mode("append").parquet(source)
    final = run()
    assert final.count() == 900 and final.select("booking_id").distinct().count() == 900
