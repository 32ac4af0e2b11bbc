import pytest
from pyspark.errors import PySparkException

from slotlake.operators import encode


@pytest.fixture(scope="module")
def parts(spark):
    schema = "id int, dining_purpose string, weekday int, price double"
    train = spark.createDataFrame([(1, "b", 1, 1.0), (2, "a", 2, 3.0), (3, None, 3, 5.0)], schema)
    test = spark.createDataFrame([(4, "a", 1, 3.0), (5, "zzz", 7, None), (6, None, None, 1.0)], schema)
    return train, test


def test_levels_are_fitted_on_train(parts):
    train, test = parts
    coded, tested, levels = encode.encode_native(train, test)
    assert {r["label"]: r["code"] for r in levels.collect()} == {"Unknown": 0, "a": 1, "b": 2}
    assert {r["id"]: r["dining_purpose_code"] for r in tested.collect()} == {4: 1, 5: None, 6: 0}
    _, ordinal, _ = encode.encode_ordinal(train, test)
    assert {r["id"]: r["dining_purpose_code"] for r in ordinal.collect()} == {4: 1, 5: -1, 6: 0}


def test_target_round_trip(spark):
    train = spark.createDataFrame([(39,), (24,), (30,)], "slot int")
    codes = encode.fit_target(train, "slot")
    coded = encode.encode_target(train, codes, "slot")
    assert {r["slot"]: r["target_code"] for r in coded.collect()} == {24: 0, 30: 1, 39: 2}
    assert all(r["slot"] == r["prediction_label"] for r in encode.decode_target(coded, codes, "target_code").collect())
    unseen = spark.createDataFrame([(5,)], "slot int")
    assert encode.encode_target(unseen, codes, "slot").first()["target_code"] is None
    with pytest.raises(PySparkException):
        encode.encode_target(unseen, codes, "slot", strict=True).collect()


def test_one_hot_aligns_test_with_train(parts):
    train, test = parts
    fitted = encode.fit_one_hot(train, ["dining_purpose", "weekday"])
    assert fitted.names() == ["dining_purpose_a", "dining_purpose_b", "weekday_2", "weekday_3"]
    got = {r["id"]: tuple(r[c] for c in fitted.names()) for r in encode.apply_one_hot(test, fitted).collect()}
    assert got == {4: (1, 0, 0, 0), 5: (0, 0, 0, 0), 6: (0, 0, 0, 0)}
    without = encode.apply_one_hot(test.drop("weekday"), fitted)
    assert without.columns == ["id", "price", *fitted.names()]


def test_one_hot_names_stay_usable(spark):
    df = spark.createDataFrame([("a.b", 1.0), ("a_b", 2.5)], "x string, y double")
    fitted = encode.fit_one_hot(df, ["x", "y"])
    assert fitted.names() == ["x_a_b", "x_a_b_", "y_1", "y_2_5"]
    assert sorted(tuple(r) for r in encode.apply_one_hot(df, fitted).select(*fitted.names()).collect()) == [(0, 1, 0, 1), (1, 0, 1, 0)]


def test_scaling_uses_population_deviation(spark, parts):
    train, test = parts
    fitted = encode.fit_scaling(train, ["price"])
    assert fitted["price"][0] == 3.0 and abs(fitted["price"][1] - (8 / 3) ** 0.5) < 1e-12
    got = [r["price"] for r in encode.apply_scaling(test, fitted).orderBy("id").collect()]
    assert got[0] == 0.0 and got[1] is None
    constant = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert encode.fit_scaling(constant, ["x"]) == {"x": (2.0, 1.0)}


def test_one_hot_in_long_form(parts, spark):
    train, test = parts
    columns = ["weekday", "dining_purpose", "absent"]
    levels = encode.one_hot_levels(train, columns)
    assert sorted((r["column"], r["label"], r["position"]) for r in levels.collect()) == [
        ("dining_purpose", "a", 0), ("dining_purpose", "b", 1), ("weekday", "2", 2), ("weekday", "3", 3)]
    got = {(r["id"], r["column"], r["position"]) for r in encode.one_hot_long(train.unionByName(test), "id", levels, columns).collect()}
    assert got == {(1, "dining_purpose", 1), (2, "dining_purpose", 0), (2, "weekday", 2), (3, "weekday", 3), (4, "dining_purpose", 0)}
    assert encode.one_hot_levels(train.limit(0), columns).count() == 0


def test_a_million_levels_stay_off_the_driver(spark):
    rows = spark.range(1_000_000).selectExpr("id", "cast(id as string) as name")
    with pytest.raises(ValueError, match="one_hot_long"):
        encode.fit_one_hot(rows, ["name"])
    levels = encode.one_hot_levels(rows, ["name"])
    found = levels.selectExpr("count(*)", "count(distinct position)", "min(position)", "max(position)").first()
    assert tuple(found) == (1_000_000, 1_000_000, 0, 999_999)
    places = {r.label: r.position for r in levels.filter("label in ('0', '1', '10', '999999')").collect()}
    assert places["0"] == 0 and places["1"] == 1 and places["10"] == 2 and places["999999"] == 999_999
    assert encode.one_hot_long(rows, "id", levels, ["name"]).count() == 1_000_000
