"""Calendar and clock features as column expressions.

Each function takes columns and returns a column, so a chain of them stays inside one
projection and one code-generated stage.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotlake.constants import PAYDAY


def lead_time_hours(booked: Column, reserved: Column) -> Column:
    """Hours from booking to reservation, with fraction; negative if booked later."""
    return F.timestamp_diff("MICROSECOND", booked, reserved) / F.lit(3.6e9)


def age_years(birth: Column, reference: Column) -> Column:
    """Difference of the calendar years, whether or not the birthday has passed."""
    return F.year(reference) - F.year(birth)


def age_on(birth: Column, as_of: Column) -> Column:
    """Completed years of age on a day."""
    birthday_ahead = (F.month(as_of) * 100 + F.day(as_of)) < (F.month(birth) * 100 + F.day(birth))
    return F.year(as_of) - F.year(birth) - birthday_ahead.cast("int")


def half_hour_slot(ts: Column) -> Column:
    """0 for 00:00-00:29 up to 47 for 23:30-23:59."""
    return F.hour(ts) * 2 + (F.minute(ts) >= 30).cast("int")


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def iso_weekday(ts: Column) -> Column:
    """1 for Monday up to 7 for Sunday."""
    return F.weekday(ts) + 1


def near_holiday(ts: Column, holidays: Sequence[str], days: int = 7) -> Column:
    """1 if a holiday lies within ``days`` calendar days, else 0; a missing date gives 0.

    The list is merged into date ranges on the driver, so each row is compared with a few
    constants. For a holiday table use ``operators.joins.near_holiday_table``.
    """
    date = F.to_date(ts)
    ranges: list[list[dt.date]] = []
    for day in sorted(dt.date.fromisoformat(h) for h in holidays):
        first, last = day - dt.timedelta(days), day + dt.timedelta(days)
        if ranges and first <= ranges[-1][1] + dt.timedelta(1):
            ranges[-1][1] = last
        else:
            ranges.append([first, last])
    hit = F.lit(False)
    for first, last in ranges:
        hit = hit | date.between(F.lit(first), F.lit(last))
    return F.coalesce(hit, F.lit(False)).cast("int")


def payday_distance(ts: Column, payday: int = PAYDAY) -> Column:
    """Days to the nearest payday of the previous, same or next month.

    In a month without that day, payday falls on the 28th.
    """
    date = F.to_date(ts)
    month = F.trunc(date, "MM")

    def payday_of(first_day: Column) -> Column:
        if not 1 <= payday <= 31:
            day = F.lit(28)
        elif payday <= 28:
            day = F.lit(payday)
        else:
            day = F.when(F.day(F.last_day(first_day)) >= payday, payday).otherwise(28)
        return F.date_add(first_day, day - 1)

    distances = [F.abs(F.datediff(date, payday_of(F.add_months(month, k)))) for k in (-1, 0, 1)]
    return F.least(*distances).cast("double")


def slot_time_range(slot: Column) -> Column:
    """39 becomes ``19:30-19:59``."""
    hour, minute = F.floor(slot / 2).cast("int"), F.pmod(slot, F.lit(2)).cast("int") * 30
    text = F.format_string("%02d:%02d-%02d:%02d", hour, minute, hour, minute + 29)
    return F.when(slot.isNotNull(), text)


def slot_label(slot: Column) -> Column:
    """23 becomes ``11:30``; a fraction is first rounded half to even."""
    whole = F.rint(slot.cast("double")).cast("int")
    text = F.format_string("%02d:%02d", F.floor(whole / 2).cast("int"), F.pmod(whole, F.lit(2)) * 30)
    return F.when(slot.isNotNull(), text)


def round_to_slot(value: Column, low: int = 0, high: int = 47) -> Column:
    """Nearest slot, half to even, kept within ``low`` and ``high``."""
    rounded = F.rint(value)
    return (
        F.when(rounded < low, low).when(rounded > high, high).otherwise(rounded).cast("int")
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
