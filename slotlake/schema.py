"""Declared table schemas and the constraints that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}


def columns(declaration: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; unlike ``StructType.fromDDL`` it needs no session."""
    pairs = [part.split() for part in declaration.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# --- fixed values: column types of the raw tables and of a scoring record ------------

BOOKINGS = columns(
    "booking_id INT, member_id STRING, cdate STRING, restaurant_id STRING, datetime STRING, "
    "people INT, purpose STRING, gender STRING, status STRING, "
    "is_required_prepay_satisfied INT, return90 INT"
)
MEMBERS = columns(
    "id STRING, is_vip INT, gender STRING, birthdate STRING, city STRING, has_google INT, "
    "has_yahoo INT, has_weibo INT, cdate STRING"
)
RESTAURANTS = columns(
    "id STRING, is_hotel INT, country STRING, currency STRING, city STRING, cityarea STRING, "
    "name STRING, abbr STRING, tel STRING, opening_hours STRING, good_for_family INT, "
    "accept_credit_card INT, parking INT, outdoor_seating INT, wifi INT, "
    "wheelchair_accessible INT, price1 DOUBLE, price2 DOUBLE, lat DOUBLE, lng DOUBLE, "
    "timezone STRING, locale STRING, cdate STRING"
)
BOOKING_RECORD = columns(
    "reservation_hour INT, party_size INT, dining_purpose STRING, booked_by_gender STRING, "
    "prepay_satisfied INT, hotel_restaurant DOUBLE, family_friendly DOUBLE, "
    "accepts_credit_card DOUBLE, has_parking DOUBLE, outdoor_seating DOUBLE, has_wifi DOUBLE, "
    "wheelchair_accessible DOUBLE, lat DOUBLE, lng DOUBLE, is_vip_member DOUBLE, "
    "account_gender STRING, lead_time DOUBLE, age DOUBLE, booking_hour DOUBLE, weekday INT, "
    "avg_price DOUBLE, is_holiday_vicinity INT, days_from_payday DOUBLE, popular_hour INT, "
    "dinner_ratio DOUBLE, restaurant_density INT"
)
FEATURE_COLUMNS = tuple(f.name for f in BOOKING_RECORD if f.name != "reservation_hour")


@dataclass(frozen=True)
class Rule:
    """One constraint on one column."""

    column: str
    kind: str  # not_null | unique | allowed | range | references
    allowed: tuple = ()
    low: float | None = None
    high: float | None = None
    #: ``(table, column)`` that holds every value but null
    target: tuple[str, str] | None = None


def _flags(*columns: str) -> list[Rule]:
    return [Rule(c, "allowed", allowed=(0, 1)) for c in columns]


def _required(*columns: str) -> list[Rule]:
    return [Rule(c, "not_null") for c in columns]


# --- fixed values: constraints of the raw tables --------------------------------------

BOOKING_RULES = [
    Rule("booking_id", "unique"),
    *_required("booking_id", "member_id", "cdate", "restaurant_id", "datetime", "people",
               "status", "is_required_prepay_satisfied", "return90"),
    Rule("people", "range", low=1, high=50),
    Rule("purpose", "allowed", allowed=("家人用餐", "朋友聚餐", "甜蜜紀念日", "生日慶祝")),
    Rule("gender", "allowed", allowed=("M", "F")),
    Rule("status", "allowed", allowed=("ok", "canceled")),
    *_flags("is_required_prepay_satisfied", "return90"),
]
MEMBER_RULES = [
    Rule("id", "unique"),
    *_required("id", "is_vip", "has_google", "has_yahoo", "has_weibo", "cdate"),
    Rule("gender", "allowed", allowed=("M", "F")),
    *_flags("is_vip", "has_google", "has_yahoo", "has_weibo"),
]
RESTAURANT_RULES = [
    Rule("id", "unique"),
    *_required("id", "is_hotel", "name", "cdate"),
    *_flags("is_hotel", "good_for_family", "accept_credit_card", "parking", "outdoor_seating",
            "wifi", "wheelchair_accessible"),
    Rule("lat", "range", low=-90.0, high=90.0),
    Rule("lng", "range", low=-180.0, high=180.0),
]
BOOKING_REFERENCES = [
    Rule("member_id", "references", target=("members", "id")),
    Rule("restaurant_id", "references", target=("restaurants", "id")),
]
RAW_RULES = {"bookings": BOOKING_RULES + BOOKING_REFERENCES, "members": MEMBER_RULES, "restaurants": RESTAURANT_RULES}
