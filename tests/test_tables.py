import datetime as dt

import pytest

from slotlake import constants as K
from slotlake.operators import joins, keys, popularity, profile, routing
from slotlake.config import OVERLAPPING_BANDS


@pytest.fixture(scope="module")
def dup(spark):
    return spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, None, 1), (5, None, 1), (6, "c", 2)],
                                 "n int, x string, y int")


def test_duplicates_treat_missing_as_equal(dup):
    assert sorted(r["n"] for r in keys.duplicates(dup, ["x", "y"]).collect()) == [1, 2, 4, 5]


def test_keep_last(dup):
    assert [r["n"] for r in keys.keep_last(dup, ["x", "y"], ["n"]).collect()] == [2, 3, 6, 5]
    assert keys.keep_last(dup, ["x", "y"], ["n"]).columns == dup.columns


def test_unique_key_guard(spark, dup):
    assert keys.duplicate_key_check(dup, ["n"]).first()["has_duplicates"] is False
    assert keys.duplicate_key_check(dup.limit(0), ["n"]).first()["has_duplicates"] is False
    with pytest.raises(ValueError):
        keys.require_unique(dup, ["x"])


def test_merge_suffixes_and_missing_keys(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l2"), (3, "l3")], "k int, v string")
    right = spark.createDataFrame([(1, "r1"), (None, "r2"), (4, "r4")], "k int, v string")
    plain = {(r["k"], r["v_x"], r["v_y"]) for r in joins.merge(left, right, ["k"], "outer").collect()}
    assert plain == {(1, "l1", "r1"), (None, "l2", None), (None, None, "r2"), (3, "l3", None), (4, None, "r4")}
    safe = {(r["k"], r["v_x"], r["v_y"]) for r in joins.merge(left, right, ["k"], "outer", null_safe=True).collect()}
    assert safe == {(1, "l1", "r1"), (None, "l2", "r2"), (3, "l3", None), (4, None, "r4")}


def test_weather_join_checks_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2014, 1, 1, 19), "Taipei")], "datetime timestamp_ntz, city string")
    weather = spark.createDataFrame([(dt.date(2014, 1, 1), "Taipei", 1)], "date date, city string, is_raining int")
    out = joins.weather_join(df, weather)
    assert out.columns == ["datetime", "city", "is_raining"] and out.first()["is_raining"] == 1
    with pytest.raises(ValueError):
        joins.weather_join(df, weather.drop("date"))
    with pytest.raises(ValueError):
        joins.weather_join(df, weather.drop("city"))


@pytest.fixture(scope="module")
def visits(spark):
    t = lambda h: None if h is None else dt.datetime(2014, 1, 1, h)
    lines = [("a", "x", 19), ("a", "x", 19), ("a", "x", 12), ("a", "x", 12), ("b", "x", None), ("b", "x", None),
             ("c", None, 17), ("c", None, 21), ("c", None, 22), ("c", None, None), (None, "Unknown", 19),
             ("d", "Unknown", 8), ("e", "Unknown", 8), ("f", "Unknown", 7)]
    return spark.createDataFrame([(r, a, t(h)) for r, a, h in lines],
                                 "restaurant_id string, cityarea string, datetime timestamp_ntz")


def test_popularity(visits):
    fitted = popularity.fit_venue_statistics(visits)
    assert fitted.overall_hour == 19
    out = popularity.apply_venue_statistics(visits, fitted)
    got = {r["restaurant_id"]: (r["popular_hour"], r["dinner_ratio"], r["restaurant_density"]) for r in out.collect()}
    assert got["a"] == (12, 0.5, 2)           # tie goes to the smaller hour
    assert got["b"] == (19, 0.0, 2)           # no hours: overall hour
    assert got["c"] == (17, 0.5, 0)           # a missing time lowers the ratio, a missing area has no density
    assert got[None] == (19, 0.0, 3)
    assert out.count() == visits.count()


def test_popularity_from_bare_bookings(spark, visits):
    areas = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "Unknown"), ("e", "Unknown"), ("f", "Unknown"), ("g", "x")],
                                  "id string, cityarea string")
    narrow = popularity.fit_venue_statistics(visits.drop("cityarea"), areas=areas)
    whole = popularity.fit_venue_statistics(visits)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(narrow.popularity, whole.popularity) and same(narrow.density, whole.density)


def test_no_hours_at_all(visits):
    fitted = popularity.fit_venue_statistics(visits.filter("datetime is null"))
    assert fitted.overall_hour == K.DEFAULT_POPULAR_HOUR


def test_statistics_survive_a_round_trip(spark, visits, tmp_path):
    fitted = popularity.fit_venue_statistics(visits)
    fitted.save(str(tmp_path / "venues"))
    loaded = popularity.VenueStatistics.load(spark, str(tmp_path / "venues"))
    assert loaded.overall_hour == 19 and loaded.popularity.count() == fitted.popularity.count()


def test_star_join_keeps_every_booking_and_the_booking_date(spark):
    b = spark.createDataFrame([(1, "m1", "booked", "r1", "d", 2, "p", "M", "ok", 0, 0), (2, "zz", "booked", "zz", "d", 2, "p", "F", "ok", 0, 0)],
                              ", ".join(f"{c} {'int' if c in ('booking_id', 'people', 'is_required_prepay_satisfied', 'return90') else 'string'}" for c in K.BOOKING_COLUMNS))
    r = spark.createDataFrame([("r1", *["v"] * 13, "opened")], ", ".join(f"{c} string" for c in ("id", *K.RESTAURANT_COLUMNS_IN_STAR, "cdate")))
    m = spark.createDataFrame([("m1", "1", "F", "b", "c", "joined")], "id string, is_vip string, gender string, birthdate string, city string, cdate string")
    out = joins.star_join(b, r, m)
    assert len(out.columns) == 28 and out.count() == 2
    got = {x["booking_id"]: x for x in out.collect()}
    assert got[1]["cdate"] == "booked" and got[1]["gender"] == "M" and got[1]["member_gender"] == "F"
    assert got[2]["is_vip"] is None and got[2]["city"] is None


def test_routing(spark):
    df = spark.createDataFrame([("12",), ("16",), ("19",), ("5",), (None,), ("noon",), ("14.5",)], "reservation_hour string")
    got = [r["subset"] for r in routing.route(df).collect()]
    assert got == ["lunch", "afternoon", "dinner", "_unmatched", "_unmatched", "_unmatched", "_unmatched"]
    with pytest.raises(ValueError):
        routing.route(df, OVERLAPPING_BANDS)
    with pytest.raises(ValueError):
        routing.route(df.withColumnRenamed("reservation_hour", "hour"))
    numbers = spark.createDataFrame([(14,), (17,), (3,), (None,)], "reservation_hour int")
    sizes = {r["subset"]: r["n"] for r in routing.band_sizes(numbers, OVERLAPPING_BANDS).collect()}
    assert sizes == {"lunch": 1, "afternoon": 2, "dinner": 1, "_unmatched": 2}


def test_most_frequent_tie(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 2), ("a", 2), ("b", 9), ("b", None)], "subset string, slot int")
    assert {r["subset"]: r["baseline"] for r in routing.fit_most_frequent(df, "slot").collect()} == {"a": 2, "b": 9}


def test_rare_categories(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "x string")
    got = sorted((r["x"] for r in profile.merge_rare_categories(df, "x", 2).collect()), key=str)
    assert got == [None, "Unknown", "a", "a", "a"]


def test_holiday_table(spark):
    holidays = spark.createDataFrame([(dt.date(2014, 1, 1),), (dt.date(2014, 1, 3),), (None,)], "date date")
    df = spark.createDataFrame([(dt.datetime(2014, 1, 10, 9),), (dt.datetime(2014, 1, 11, 9),), (None,)], "t timestamp_ntz")
    assert [r["is_holiday_vicinity"] for r in joins.near_holiday_table(df, "t", holidays).collect()] == [1, 0, 0]


def test_unmatched_is_an_anti_join(spark):
    a, b = spark.range(5), spark.range(3)
    assert sorted(r["id"] for r in joins.unmatched(a, b, ["id"]).collect()) == [3, 4]
