"""Joins of bookings with restaurants, members, weather and holidays.

No join carries a broadcast hint: Catalyst broadcasts a side whose known size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, where adaptive
execution splits the partitions of a frequent key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.operators.keys import require_unique


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
          null_safe: bool = False, unique_right: bool = False) -> DataFrame:
    """Equi-join on same-named keys; other names that collide get ``_x`` and ``_y``.

    Missing keys match nothing, or each other with ``null_safe``. ``unique_right`` first checks
    that the right side cannot multiply rows.
    """
    if unique_right:
        require_unique(right, on, "right side")
    how = {"full": "outer"}.get(how, how)
    shared = (set(left.columns) & set(right.columns)) - set(on)
    left = left.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in shared})
    if not null_safe:
        return left.join(right, list(on), how)
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    joined = left.join(right, condition, how)
    keys = [F.coalesce(F.col(c), F.col(f"_right_{c}")).alias(c) for c in on]
    rest = [c for c in left.columns if c not in on] + [c for c in right.columns if not c.startswith("_right_")]
    return joined.select(*keys, *rest)


def star_join(bookings: DataFrame, restaurants: DataFrame, members: DataFrame,
              venue_columns: Sequence[str] = ()) -> DataFrame:
    """Bookings with restaurant and member columns; every booking is kept.

    The 28 columns are named one by one, so the creation time is that of the booking and the
    gender and city of the member keep their own names. ``venue_columns`` names further columns
    of the restaurants to bring along.
    """
    r = restaurants.select(F.col("id").alias("_rid"), *K.RESTAURANT_COLUMNS_IN_STAR, *venue_columns)
    m = members.select(
        F.col("id").alias("_mid"),
        *[F.col(old).alias(new) for old, new in K.MEMBER_COLUMNS_IN_STAR.items()],
    )
    return (
        bookings.select(*K.BOOKING_COLUMNS)
        .join(r, F.col("restaurant_id") == F.col("_rid"), "left")
        .join(m, F.col("member_id") == F.col("_mid"), "left")
        .drop("_rid", "_mid")
    )


def weather_join(df: DataFrame, weather: DataFrame, datetime: str = "datetime",
                 city: str = "city") -> DataFrame:
    """Weather of the day and city of each row."""
    if "date" not in weather.columns:
        raise ValueError("the weather table needs a 'date' column")
    if city not in weather.columns:
        raise ValueError(f"the weather table needs a {city!r} column")
    keyed = weather.withColumnsRenamed({"date": "_date", city: "_city"}).withColumn(
        "_date", F.to_date("_date"))
    matches = (F.to_date(F.col(datetime)) == F.col("_date")) & (F.col(city) == F.col("_city"))
    return df.join(keyed, matches, "left").drop("_date", "_city")


def near_holiday_table(df: DataFrame, datetime: str, holidays: DataFrame, days: int = 7,
                       output: str = "is_holiday_vicinity") -> DataFrame:
    """Holiday vicinity for a holiday table of any length.

    Each holiday is expanded to the days it covers, which turns the range join into an
    equi-join on the date.
    """
    first, last = F.date_sub("date", days), F.date_add("date", days)
    covered = (
        holidays.filter("date is not null")
        .select(F.explode(F.sequence(first, last)).alias("_covered")).distinct()
    )
    return (
        df.join(covered, F.to_date(F.col(datetime)) == F.col("_covered"), "left")
        .withColumn(output, F.col("_covered").isNotNull().cast("int"))
        .drop("_covered")
    )


def unmatched(df: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``matched``."""
    return df.join(matched.select(*keys).distinct(), list(keys), "left_anti")
