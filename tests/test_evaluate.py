import pytest
from pyspark.sql import functions as F

from slotlake.operators import evaluate


@pytest.fixture(scope="module")
def predicted(spark):
    lines = [("a", 1, 1, 1), ("a", 1, 2, 1), ("a", 2, 2, 1), ("a", 3, 1, 1), ("b", 5, 5, 5), ("b", 5, 7, 5), ("b", 6, None, 5)]
    return spark.createDataFrame(lines, "subset string, label int, prediction int, baseline int")


def test_classification_report(predicted):
    conf = evaluate.confusion(predicted.filter("subset = 'a'"))
    got = {r["class"]: r for r in evaluate.classification_report(conf).collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["support"]) == (0.5, 0.5, 2)
    assert (got["2"]["precision"], got["2"]["recall"]) == (0.5, 1.0)
    assert (got["3"]["precision"], got["3"]["f1"]) == (0.0, 0.0)
    assert got["accuracy"]["f1"] == 0.5 and got["accuracy"]["support"] == 4
    assert got["macro avg"]["recall"] == pytest.approx(0.5)
    assert got["weighted avg"]["f1"] == pytest.approx((2 * 0.5 + 2 / 3) / 4)
    assert evaluate.weighted_f1(conf).first()["f1_weighted"] == pytest.approx((2 * 0.5 + 2 / 3) / 4)


def test_predicted_but_absent_class_counts(predicted):
    conf = evaluate.confusion(predicted.filter("subset = 'b'"))
    scores = {r["class"]: r for r in evaluate.class_scores(conf).collect()}
    assert scores[7]["support"] == 0 and scores[7]["recall"] == 0.0
    assert sorted(r["class"] for r in evaluate.label_domain(conf).collect()) == [5, 7]


def test_normalised_rows_sum_to_one_or_zero(predicted):
    conf = evaluate.confusion(predicted, by=["subset"])
    sums = evaluate.confusion_normalised(conf, ["subset"]).groupBy("subset", "label").agg(F.sum("share").alias("s")).collect()
    assert {(r["subset"], r["label"]): round(r["s"], 9) for r in sums} == {
        ("a", 1): 1.0, ("a", 2): 1.0, ("a", 3): 1.0, ("b", 5): 1.0, ("b", 7): 0.0}


def test_tolerance(predicted):
    conf = evaluate.confusion(predicted, by=["subset"])
    curve = {(r["subset"], r["tolerance"]): r["accuracy"] for r in evaluate.tolerance_curve(conf, by=["subset"]).collect()}
    assert curve[("a", 0)] == 0.5 and curve[("a", 1)] == 0.75 and curve[("a", 2)] == 1.0
    assert curve[("b", 1)] == 0.5 and curve[("b", 2)] == 1.0


def test_top_confusions_order(predicted):
    conf = evaluate.confusion(predicted, by=["subset"])
    got = [(r["subset"], r["label"], r["prediction"], r["rank"]) for r in evaluate.top_confusions(conf, ["subset"], 1).orderBy("subset").collect()]
    assert got == [("a", 1, 2, 1), ("b", 5, 7, 1)]


def test_model_against_baseline(predicted):
    got = {r["subset"]: r for r in evaluate.model_vs_baseline(predicted, "label", "prediction", "baseline", "subset").collect()}
    assert got["a"]["accuracy_lift"] == 0.0 and got["overall"]["n"] == 6
    assert got["b"]["baseline_accuracy"] == 1.0 and got["b"]["model_accuracy"] == 0.5


def test_regression_metrics_are_true_rmse(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "label double, prediction double")
    got = evaluate.regression_metrics(df).first()
    assert got["rmse"] == pytest.approx((10 / 3) ** 0.5) and got["mae"] == pytest.approx(4 / 3)
    assert got["r2"] == pytest.approx(1 - 10 / 8)


def test_leakage_check():
    evaluate.assert_no_leakage(["a"], ["b"])
    with pytest.raises(ValueError):
        evaluate.assert_no_leakage(["a", "reservation_hour"], ["reservation_hour"])
