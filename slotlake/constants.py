"""Values that results depend on and that therefore must stay exactly as they are."""

# --- fixed values: dirty-to-clean replacements of the raw tables -------------------

PURPOSE_VALUES = {
    "請選擇": "Unknown",
    "Please,Select": "Unknown",
    "Friends,Reunion": "朋友聚餐",
    "Family,Gathering": "家人用餐",
    "Birthday": "生日慶祝",
    "Friends": "朋友聚餐",
    "家人用餐,盡量靠W": "朋友聚餐",
    "Business,meeting": "商務聚餐",
    "家人&#65533;": "家人用餐",
    "家人用餐-生日": "生日慶祝",
    "慶生": "生日慶祝",
    "Birthday,Celebration": "生日慶祝",
    "甜蜜紀念日": "紀念日慶祝",
}
JUNK_PURPOSE = "&#65533;&#40115;&#65533;&#65533;&#26813;&#65533;"
CITY_VALUES = {"桃園縣": "桃園市", "%": "Unknown"}
CITYAREA_VALUES = {"請選擇": "Unknown"}
MEMBER_CITY_VALUES = {"桃園縣": "桃園市", "0": "Unknown"}
JUNK_MEMBER_CITY = "??蝮?>??蝮?/option><option value"
UNKNOWN = "Unknown"

# --- fixed values: text formats of the raw date columns ----------------------------

BOOKING_TIME_FORMAT = "M/d/yyyy,,h:mm:ss,a"
PROFILE_TIME_FORMAT = "M/d/yyyy H:mm"
DATETIME_FORMATS = (
    BOOKING_TIME_FORMAT,
    PROFILE_TIME_FORMAT,
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.S",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-M-d[ H:mm[:ss]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "M/d/yyyy[ H:mm:ss]",
    "d MMM yyyy",
)

# --- fixed values: public holidays in Taiwan, 2014 ----------------------------------

HOLIDAYS_2014 = (
    "2014-01-01", "2014-01-30", "2014-01-31", "2014-02-03", "2014-02-28",
    "2014-04-04", "2014-06-02", "2014-09-08", "2014-10-10",
)
PAYDAY = 5
DINNER_HOURS = (17, 21)
DEFAULT_POPULAR_HOUR = 18

# --- fixed values: column names of the feature table --------------------------------

FEATURE_NAMES = {
    "cdate": "booking_time",
    "datetime": "reservation_time",
    "people": "party_size",
    "purpose": "dining_purpose",
    "gender": "booked_by_gender",
    "status": "booking_status",
    "is_required_prepay_satisfied": "prepay_satisfied",
    "is_hotel": "hotel_restaurant",
    "city": "city_code",
    "cityarea": "city_area_code",
    "good_for_family": "family_friendly",
    "accept_credit_card": "accepts_credit_card",
    "parking": "has_parking",
    "outdoor_seating": "outdoor_seating",
    "wifi": "has_wifi",
    "wheelchair_accessible": "wheelchair_accessible",
    "price1": "min_price",
    "price2": "max_price",
    "is_vip": "is_vip_member",
    "member_gender": "account_gender",
    "birthdate": "member_birthdate",
    "member_city": "member_city_code",
}
DROPPED_AFTER_FEATURES = (
    "booking_id", "member_id", "restaurant_id", "booking_status", "return90",
    "min_price", "max_price",
)
BOOKING_COLUMNS = (
    "booking_id", "member_id", "cdate", "restaurant_id", "datetime", "people", "purpose",
    "gender", "status", "is_required_prepay_satisfied", "return90",
)
RESTAURANT_COLUMNS_IN_STAR = (
    "is_hotel", "city", "cityarea", "good_for_family", "accept_credit_card", "parking",
    "outdoor_seating", "wifi", "wheelchair_accessible", "price1", "price2", "lat", "lng",
)
MEMBER_COLUMNS_IN_STAR = {
    "is_vip": "is_vip", "gender": "member_gender", "birthdate": "birthdate", "city": "member_city",
}
# integer column positions in a payload point into this list
PAYLOAD_COLUMNS = (
    "party_size", "dining_purpose", "booked_by_gender", "prepay_satisfied",
    "hotel_restaurant", "family_friendly", "accepts_credit_card", "has_parking",
    "outdoor_seating", "has_wifi", "wheelchair_accessible", "lat", "lng", "is_vip_member",
    "account_gender", "lead_time", "age", "booking_hour", "reservation_hour",
    "reservation_seconds", "reservation_half_hour", "weekday", "avg_price",
    "is_holiday_vicinity", "days_from_payday", "popular_hour", "dinner_ratio",
    "restaurant_density",
)
NON_FEATURE_COLUMNS = (
    "booking_time", "reservation_time", "member_birthdate",
    "city_area_code", "city_code", "member_city_code",
)
TIME_SIBLINGS = ("reservation_hour", "reservation_seconds", "reservation_half_hour")
CATEGORICAL_COLUMNS = ("dining_purpose", "booked_by_gender", "account_gender")
GEO_CATEGORICAL_COLUMNS = ("city_code", "city_area_code", "member_city_code")
INTEGER_CATEGORICAL_COLUMNS = ("booking_hour", "weekday", "popular_hour")
ONE_HOT_BASELINES = {"weekday": "1", "booking_hour": "0"}
PREDICTION_COLUMNS = ("reservation_half_hour", "time_range", "subset", "probability")
UNMATCHED = "_unmatched"
