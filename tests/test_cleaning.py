import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.operators import cleaning, profile
from slotlake.schema import BOOKING_RULES, Rule


@pytest.fixture(scope="module")
def raw_bookings(spark):
    t = "7/24/2013,,11:30:00,PM"
    lines = [
        (1, "m1", t, "r1", "7/25/2013,,6:00:00,PM", 2, None, "M", "ok", 0, 0),
        (2, "m2", t, "r1", "bad", 2, " 請選擇\u3000", None, "ok", 0, 0),
        (3, "m3", t, "r2", t, 2, "Please,Select", "F", "ok", 0, 1),
        (4, "m4", t, "r2", t, 2, "Friends", "F", "canceled", 1, 0),
        (5, "m5", t, "r2", t, 2, K.JUNK_PURPOSE, "F", "ok", 0, 0),
        (6, "m6", t, "r3", t, 60, "商務聚餐", "X", "ok", 0, 0),
    ]
    return spark.createDataFrame(lines, "booking_id int, member_id string, cdate string, restaurant_id string, "
                                 "datetime string, people int, purpose string, gender string, status string, "
                                 "is_required_prepay_satisfied int, return90 int")


def test_clean_bookings(raw_bookings):
    got = {r["booking_id"]: r for r in cleaning.clean_bookings(raw_bookings).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert [got[i]["purpose"] for i in (1, 2, 3, 4, 6)] == ["Unknown", "Unknown", "Unknown", "朋友聚餐", "商務聚餐"]
    assert got[1]["cdate"].replace(tzinfo=None) == dt.datetime(2013, 7, 24, 23, 30)
    assert got[2]["datetime"] is None


def test_clean_members_drops_junk_before_mapping(spark):
    raw = spark.createDataFrame([
        ("a", "M", "1980-05-06", "桃園縣", "4/1/2012 0:30"), ("b", None, "0000-00-00", "0", "4/1/2012 0:30"),
        ("c", "F", None, K.JUNK_MEMBER_CITY, "x"), ("d", "F", "1850-01-01", None, None),
    ], "id string, gender string, birthdate string, city string, cdate string")
    got = {r["id"]: r for r in cleaning.clean_members(raw).collect()}
    assert set(got) == {"a", "b", "d"}
    assert [got[i]["city"] for i in "abd"] == ["桃園市", "Unknown", "Unknown"]
    assert got["b"]["gender"] == "Unknown" and got["b"]["birthdate"] is None


def test_clean_restaurants(spark):
    raw = spark.createDataFrame([("a", "桃園縣", "請選擇", "4/1/2012 0:30"), ("b", "%", None, "bad"), ("c", None, "大安區", None)],
                                "id string, city string, cityarea string, cdate string")
    got = {r["id"]: (r["city"], r["cityarea"]) for r in cleaning.clean_restaurants(raw).collect()}
    assert got == {"a": ("桃園市", "Unknown"), "b": ("Unknown", "Unknown"), "c": (None, "大安區")}


def test_remove_value_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r["x"] for r in cleaning.remove_value(df, "x", "a").collect()} == {"b", None}


def test_filter_invalid_dates_drops_missing(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (None, 2), (1, None)], "a int, b int")
    assert sorted(tuple(r) for r in cleaning.filter_invalid_dates(df, "a", "b").collect()) == [(1, 2), (2, 2)]


def test_anomaly_reports(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2030, 1, 1), -5.0), (d(1890, 1, 1), 0.0), (d(1980, 1, 1), None), (None, 3.0)],
                               "birth date, price double")
    as_of = F.lit(d(2014, 1, 1))
    assert [r["birth"] for r in cleaning.invalid_age(df, "birth", as_of).collect()] == [d(1890, 1, 1), d(2030, 1, 1)]
    assert [r["birth"] for r in cleaning.future_dates(df, "birth", as_of).collect()] == [d(2030, 1, 1)]
    assert [r["price"] for r in cleaning.invalid_price(df, "price").collect()] == [-5.0]


def test_fill_strategies(spark, rows):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 4.0, "c"), (None, 10.0, "d")], "i int, x double, s string")
    by = lambda **k: sorted((r["x"] for r in rows(cleaning.fill_numeric(df, **k))), key=lambda v: (v is None, v))
    assert by(strategy="mean") == [1.0, 4.0, 5.0, 10.0]
    assert by(strategy="median") == [1.0, 4.0, 4.0, 10.0]
    assert by(strategy="none") == [1.0, 4.0, 10.0, None]
    assert by(strategy="drop") == [1.0, 4.0]
    fitted_on_part = cleaning.fill_numeric(df, "mean", fit_on=df.filter("x < 5"))
    assert sorted(r["x"] for r in rows(fitted_on_part)) == [1.0, 2.5, 4.0, 10.0]
    with pytest.raises(ValueError):
        cleaning.fill_numeric(df, "mode")


def test_align_and_prune(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("7", "x", 1)], "a string, note string, extra int")
    wanted = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    out = cleaning.align_features(df, wanted)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (7, None)
    assert cleaning.model_inputs(df, "extra", []).columns == []
    assert cleaning.drop_columns(df, ["nope", "a"]).columns == ["note", "extra"]


def test_map_values_from_table_agrees_with_case(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "x string")
    table = spark.createDataFrame([("a", "A"), ("b", None)], "old string, new string")
    got = sorted((r["x"] for r in cleaning.map_values_from(df, "x", table).collect()), key=str)
    assert got == ["A", None, None, "z"]


def test_constraints_and_quarantine(raw_bookings):
    found = {(r["column"], r["rule"]): r["violations"] for r in profile.constraint_report(raw_bookings, BOOKING_RULES).collect()}
    assert found[("people", "range")] == 1 and found[("gender", "allowed")] == 1
    assert found[("booking_id", "unique")] == 0 and found[("purpose", "allowed")] == 5
    rules = [Rule("people", "range", low=1, high=50), Rule("gender", "not_null")]
    good, bad = profile.quarantine(raw_bookings, rules)
    assert good.count() == 4
    assert {r["booking_id"]: r["broken_rules"] for r in bad.collect()} == {2: ["gender:not_null"], 6: ["people:range"]}


def test_declared_report_of_references(spark):
    """Nulls refer to nothing; a frequent unknown value counts with all its rows; equal keys are known once."""
    orders = spark.createDataFrame([("a",), ("a",), ("b",), ("x",), ("x",), ("x",), (None,), (None,)], "who string")
    people = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    rules = {"orders": [Rule("who", "references", target=("people", "id")), Rule("who", "not_null"), Rule("who", "unique")],
             "people": [Rule("id", "unique")]}

    def found(tables):
        return {(r["table"], r["rule"]): r["violations"] for r in profile.declared_report(tables, rules).collect()}

    assert found({"orders": orders, "people": people}) == {
        ("orders", "references"): 3, ("orders", "not_null"): 2, ("orders", "unique"): 7, ("people", "unique"): 2}
    assert found({"orders": orders, "people": people.limit(0)})[("orders", "references")] == 6
    assert set(found({"orders": orders.limit(0), "people": people}).values()) == {0, 2}
    good, bad = profile.quarantine(orders, rules["orders"])
    assert (good.count(), bad.count()) == (6, 2)
