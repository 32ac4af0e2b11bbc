import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotlake.constants import DATETIME_FORMATS, HOLIDAYS_2014
from slotlake.functions import temporal, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("time, slot", [
    ("19:30:00", 39), ("23:59:59", 47), ("00:29:59", 0), ("00:30:00", 1), ("12:00:00", 24)])
def test_half_hour_slot(spark, time, slot):
    assert one(spark, temporal.half_hour_slot(ts(f"2014-01-01 {time}"))) == slot


def test_seconds_of_day_cuts_fractions(spark):
    assert one(spark, temporal.seconds_of_day(ts("2014-01-01 23:59:59.9"))) == 86399


@pytest.mark.parametrize("day, number", [("2024-01-01", 1), ("2024-01-07", 7)])
def test_weekday_starts_on_monday(spark, day, number):
    assert one(spark, temporal.iso_weekday(ts(day + " 10:00:00"))) == number


def test_lead_time_in_hours(spark):
    a, b = ts("2014-01-01 10:00:00"), ts("2014-01-01 11:30:00")
    assert one(spark, temporal.lead_time_hours(a, b)) == 1.5
    assert one(spark, temporal.lead_time_hours(b, a)) == -1.5
    assert one(spark, temporal.lead_time_hours(F.lit(None).cast("timestamp_ntz"), b)) is None


def test_two_kinds_of_age(spark):
    birth, ref = F.lit(dt.date(2000, 12, 31)), F.lit(dt.date(2014, 1, 1))
    assert one(spark, temporal.age_years(birth, ref)) == 14
    assert one(spark, temporal.age_on(birth, ref)) == 13
    assert one(spark, temporal.age_on(birth, F.lit(dt.date(2014, 12, 31)))) == 14


@pytest.mark.parametrize("day, payday, distance", [
    ("2014-03-05", 5, 0.0), ("2014-01-20", 5, 15.0), ("2014-01-21", 5, 15.0),
    ("2014-02-28", 31, 0.0), ("2014-02-14", 31, 14.0), ("2013-12-31", 5, 5.0), ("2014-01-01", 31, 1.0)])
def test_payday_distance(spark, day, payday, distance):
    assert one(spark, temporal.payday_distance(ts(day + " 18:00:00"), payday)) == distance


def test_payday_distance_against_brute_force(spark):
    def payday_of(year, month, payday):
        try:
            return dt.date(year, month, payday)
        except ValueError:
            return dt.date(year, month, 28)

    def expected(day, payday):
        months = [(day.year + (day.month + k - 1) // 12, (day.month + k - 1) % 12 + 1) for k in (-1, 0, 1)]
        return float(min(abs((day - payday_of(y, m, payday)).days) for y, m in months))

    days = [dt.date(2012, 1, 1) + dt.timedelta(i) for i in range(800)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    for payday in (0, 1, 5, 28, 29, 30, 31):
        got = {r["d"]: r["x"] for r in frame.select("d", temporal.payday_distance(F.col("d"), payday).alias("x")).collect()}
        assert got == {d: expected(d, payday) for d in days}, payday


def test_payday_of_missing_date_is_missing(spark):
    assert one(spark, temporal.payday_distance(F.lit(None).cast("timestamp"))) is None


@pytest.mark.parametrize("day, near", [
    ("2014-06-09", 1), ("2014-06-10", 0), ("2014-05-26", 1), ("2014-05-25", 0), ("2014-10-17", 1)])
def test_near_holiday(spark, day, near):
    assert one(spark, temporal.near_holiday(ts(day + " 12:00:00"), HOLIDAYS_2014)) == near


def test_near_holiday_against_brute_force(spark):
    holidays = [dt.date.fromisoformat(h) for h in HOLIDAYS_2014]
    days = [dt.date(2013, 12, 1) + dt.timedelta(i) for i in range(400)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"]: r["x"] for r in frame.select("d", temporal.near_holiday(F.col("d"), HOLIDAYS_2014).alias("x")).collect()}
    assert got == {d: int(any(abs((d - h).days) <= 7 for h in holidays)) for d in days}


def test_missing_date_is_not_near_a_holiday(spark):
    assert one(spark, temporal.near_holiday(F.lit(None).cast("date"), HOLIDAYS_2014)) == 0
    assert one(spark, temporal.near_holiday(F.lit(dt.date(2014, 1, 1)), [])) == 0


def test_slot_texts(spark):
    assert one(spark, temporal.slot_time_range(F.lit(39))) == "19:30-19:59"
    assert one(spark, temporal.slot_time_range(F.lit(4))) == "02:00-02:29"
    assert one(spark, temporal.slot_label(F.lit(23))) == "11:30"
    assert one(spark, temporal.slot_label(F.lit(22.5))) == "11:00"
    assert one(spark, temporal.slot_label(F.lit(23.5))) == "12:00"
    assert one(spark, temporal.slot_label(F.lit(None).cast("int"))) is None


@pytest.mark.parametrize("value, slot", [(2.5, 2), (3.5, 4), (49.7, 47), (-1.2, 0), (21.4, 21)])
def test_round_to_slot(spark, value, slot):
    assert one(spark, temporal.round_to_slot(F.lit(value))) == slot


@pytest.mark.parametrize("low, high, price", [("100", "200", 150.0), ("100", None, None), ("x", "200", None)])
def test_average_price(spark, low, high, price):
    assert one(spark, values.average_price(F.lit(low).cast("string"), F.lit(high).cast("string"))) == price


def test_strip_takes_unicode_spaces(spark):
    assert one(spark, values.strip(F.lit("\u3000 \t朋友 聚餐\u00a0\n"))) == "朋友 聚餐"


def test_hash_fraction_is_uniform(spark):
    share = spark.range(20000).select(values.hash_fraction(F.col("id")).alias("x")).agg(
        F.avg((F.col("x") < 0.2).cast("double")), F.min("x"), F.max("x")).first()
    assert abs(share[0] - 0.2) < 0.01 and share[1] >= 0 and share[2] < 1


@pytest.mark.parametrize("text, parsed", [
    ("7/24/2013,,11:30:00,PM", dt.datetime(2013, 7, 24, 23, 30)), ("12/01/2013,,12:05:09,am", dt.datetime(2013, 12, 1, 0, 5, 9)),
    ("4/1/2012 0:30", dt.datetime(2012, 4, 1, 0, 30)), ("2014-01-31", dt.datetime(2014, 1, 31)),
    ("2014-01-31 08:09:10", dt.datetime(2014, 1, 31, 8, 9, 10)), ("0000-00-00", None), ("13/45/2012 0:30", None),
    ("2014-01-01T10:00:00", dt.datetime(2014, 1, 1, 10)), ("2014-01-01 10:00:00.5", dt.datetime(2014, 1, 1, 10, 0, 0, 500000)),
    ("2014/1/2 10:00", dt.datetime(2014, 1, 2, 10)), ("2014-1-2", dt.datetime(2014, 1, 2)), ("1/2/2014 10:00:05", dt.datetime(2014, 1, 2, 10, 0, 5)),
    ("3 Feb 2014", dt.datetime(2014, 2, 3)), ("soon", None), (None, None)])
def test_parse_timestamp(spark, text, parsed):
    got = one(spark, values.parse_timestamp(F.lit(text).cast("string"), DATETIME_FORMATS).cast("timestamp_ntz"))
    assert got == parsed
