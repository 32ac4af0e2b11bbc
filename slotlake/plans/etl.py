"""From raw bookings to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.functions import temporal, values
from slotlake.operators import cleaning
from slotlake.operators.joins import star_join
from slotlake.operators.popularity import (
    VENUE_COLUMNS, VenueStatistics, apply_venue_statistics, fill_statistics, fit_venue_statistics, venues_with_statistics,
)
from slotlake.session import freeze


def scalar_features(df: DataFrame, holidays: Sequence[str] = K.HOLIDAYS_2014,
                    payday: int = K.PAYDAY) -> DataFrame:
    """All features that need only the row itself, in one projection."""
    booked, reserved = F.col("cdate"), F.col("datetime")
    return df.withColumns({
        "lead_time": temporal.lead_time_hours(booked, reserved),
        "age": temporal.age_years(F.col("birthdate"), reserved),
        "booking_hour": F.hour(booked),
        "reservation_hour": F.hour(reserved),
        "reservation_seconds": temporal.seconds_of_day(reserved),
        "reservation_half_hour": temporal.half_hour_slot(reserved),
        "weekday": temporal.iso_weekday(reserved),
        "avg_price": values.average_price(F.col("price1"), F.col("price2")),
        "is_holiday_vicinity": temporal.near_holiday(reserved, holidays),
        "days_from_payday": temporal.payday_distance(reserved, payday),
    })


def _finish(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    dropped = [c for c in K.DROPPED_AFTER_FEATURES if c not in keep]
    return df.transform(cleaning.rename_columns, K.FEATURE_NAMES).transform(cleaning.drop_columns, dropped)


def transform_features(df: DataFrame, holidays: Sequence[str] = K.HOLIDAYS_2014, payday: int = K.PAYDAY,
                       fitted: VenueStatistics | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The feature table of bookings that are already joined.

    Venue statistics are fitted on the rows at hand unless ``fitted`` brings those of the
    training rows. ``keep`` names id columns to retain, for splits and for scoring.
    """
    statistics = fitted if fitted is not None else fit_venue_statistics(df)
    return df.transform(scalar_features, holidays, payday).transform(apply_venue_statistics, statistics).transform(_finish, keep)


def build_features(bookings: DataFrame, restaurants: DataFrame, members: DataFrame,
                   fitted: VenueStatistics | None = None, keep: Sequence[str] = (),
                   holidays: Sequence[str] = K.HOLIDAYS_2014, payday: int = K.PAYDAY) -> DataFrame:
    """Star join and feature table of clean bookings: two joins of the bookings.

    Without ``fitted`` statistics they come from a scan of two booking columns, before the join;
    that scan runs at once, the feature table when it is used.
    """
    if fitted is None:
        fitted = fit_venue_statistics(bookings, areas=restaurants)
    venues = venues_with_statistics(restaurants, fitted)
    joined = star_join(bookings, venues, members, VENUE_COLUMNS)
    return joined.transform(scalar_features, holidays, payday).transform(fill_statistics, fitted).transform(_finish, keep)


def features_from_raw(bookings: DataFrame, restaurants: DataFrame, members: DataFrame,
                      **options) -> DataFrame:
    """Clean unseen bookings, join the cleaned dimensions, derive the features.

    The clean bookings are written once: statistics and features read parsed times.
    """
    return build_features(freeze(cleaning.clean_bookings(bookings), "clean-bookings"), restaurants, members, **options)
