"""Queries on rows and columns: features, projections, cleaning, filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotlake import constants as K
from slotlake.catalog import roles
from slotlake.catalog.registry import comparable, query, r6, table
from slotlake.catalog.roles import band_sql, slot_sql, stamp_sql, star_sql
from slotlake.config import resolve_granularity
from slotlake.functions import temporal, values
from slotlake.operators import cleaning, joins, profile
from slotlake.operators.routing import route
from slotlake.schema import BOOKING_RECORD, RAW_RULES, RESTAURANT_RULES, Rule

# --- calendar and clock features ---------------------------------------------------------------


@query("lead_time", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round((epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0, 6) AS lead_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def lead_time(spark, sf):
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r6(temporal.lead_time_hours(F.col("o_orderdate"), F.col("l_shipdate"))).alias("lead_time"))


@query("age_years", f"""
SELECT o_orderkey, CAST(year(o_orderdate) - year(birthdate) AS INT) AS age
FROM orders LEFT JOIN ({roles.MEMBERS_SQL}) ON o_custkey = id""")
def age_years(spark, sf):
    return table(spark, sf, "orders").join(
        roles.members(spark, sf), F.col("o_custkey") == F.col("id"), "left"
    ).select("o_orderkey", temporal.age_years(F.col("birthdate"), F.col("o_orderdate")).alias("age"))


def _events_with(name, sql_type, sql, expression):
    """A query that adds one expression to every event."""
    @query(name, f"SELECT event_id, CAST({sql} AS {sql_type}) AS {name} FROM events")
    def run(spark, sf):
        return table(spark, sf, "events").select("event_id", expression().alias(name))
    return run


_events_with("hour_of_day", "INT", "hour(ts)", lambda: F.hour("ts"))
_events_with("half_hour_slot", "INT", slot_sql("ts"), lambda: temporal.half_hour_slot(F.col("ts")))
_events_with("seconds_of_day", "INT", "hour(ts) * 3600 + minute(ts) * 60 + second(ts)",
             lambda: temporal.seconds_of_day(F.col("ts")))
_events_with("weekday_iso", "INT", "isodow(ts)", lambda: temporal.iso_weekday(F.col("ts")))
_events_with("slot_label", "VARCHAR", f"""
    CASE WHEN {slot_sql('ts')} < 20 THEN '0' ELSE '' END || CAST({slot_sql('ts')} // 2 AS VARCHAR)
    || CASE WHEN minute(ts) >= 30 THEN ':30' ELSE ':00' END""",
             lambda: temporal.slot_label(temporal.half_hour_slot(F.col("ts"))))
_events_with("slot_time_range", "VARCHAR", """
    strftime(ts, '%H') || CASE WHEN minute(ts) >= 30 THEN ':30-' ELSE ':00-' END
    || strftime(ts, '%H') || CASE WHEN minute(ts) >= 30 THEN ':59' ELSE ':29' END""",
             lambda: temporal.slot_time_range(temporal.half_hour_slot(F.col("ts"))))
_events_with("round_clip_slot", "INT", "greatest(0, least(47, round_even(value - 5, 0)))",
             lambda: temporal.round_to_slot(F.col("value") - 5))
_events_with("holiday_vicinity", "INT", """
    CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2023-12-25' AND DATE '2024-01-08'
           OR CAST(ts AS DATE) BETWEEN DATE '2024-02-03' AND DATE '2024-02-17' THEN 1 ELSE 0 END""",
             lambda: temporal.near_holiday(F.col("ts"), roles.HOLIDAYS_2024))


@query("avg_price", """
SELECT s_suppkey, round((CASE WHEN s_acctbal >= 0 THEN s_acctbal END + abs(s_acctbal) + 100) / 2, 6) AS avg_price
FROM supplier""")
def avg_price(spark, sf):
    low = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).cast("string")
    return table(spark, sf, "supplier").select(
        "s_suppkey", r6(values.average_price(low, F.abs("s_acctbal") + 100)).alias("avg_price"))


def _payday_sql(payday: int) -> str:
    # payday of a month, or its 28th where the month is too short
    def day_of(month):
        return (f"CASE WHEN day(last_day({month})) >= {payday} THEN {month} + INTERVAL {payday - 1} DAY "
                f"ELSE {month} + INTERVAL 27 DAY END")
    terms = [f"abs(date_diff('day', CAST({day_of(m)} AS DATE), d))" for m in (
        "(date_trunc('month', d) - INTERVAL 1 MONTH)", "date_trunc('month', d)",
        "(date_trunc('month', d) + INTERVAL 1 MONTH)")]
    return f"""
SELECT o_orderkey, CAST(least({', '.join(terms)}) AS DOUBLE) AS days_from_payday
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def _payday(spark, sf, payday):
    return table(spark, sf, "orders").select(
        "o_orderkey", temporal.payday_distance(F.to_date("o_orderdate"), payday).alias("days_from_payday"))


@query("payday_distance", _payday_sql(5))
def payday_distance(spark, sf):
    return _payday(spark, sf, 5)


@query("payday_distance_31", _payday_sql(31))
def payday_distance_31(spark, sf):
    return _payday(spark, sf, 31)


@query("numeric_coerce", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number
FROM events""")
def numeric_coerce(spark, sf):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", values.to_number(text).alias("number"))


# --- projections ----------------------------------------------------------------------------------


@query("drop_columns", "SELECT event_id, user_id, event_type, value FROM events")
def drop_columns(spark, sf):
    return cleaning.drop_columns(table(spark, sf, "events"), ["props", "ts", "no_such_column"])


@query("rename_columns", f"""
SELECT booking_id, people AS party_size, purpose AS dining_purpose, gender AS booked_by_gender,
       status AS booking_status, is_required_prepay_satisfied AS prepay_satisfied
FROM ({roles.EVENT_BOOKINGS_SQL})""")
def rename_columns(spark, sf):
    picked = roles.event_bookings(spark, sf).select(
        "booking_id", "people", "purpose", "gender", "status", "is_required_prepay_satisfied")
    return cleaning.rename_columns(picked, K.FEATURE_NAMES)


@query("select_columns", f"""
SELECT {stamp_sql('cdate')} AS cdate, {stamp_sql('datetime')} AS datetime, people, purpose, gender, status
FROM ({roles.EVENT_BOOKINGS_SQL})""")
def select_columns(spark, sf):
    rows = roles.event_bookings(spark, sf)
    return comparable(rows.select("cdate", "datetime", "people", "purpose", "gender", "status"))


def _slotted_features(spark, sf):
    """Star rows with the time siblings of the target and the names of the feature table."""
    return roles.event_star(spark, sf).withColumns({
        "reservation_hour": F.hour("datetime"),
        "reservation_seconds": temporal.seconds_of_day(F.col("datetime")),
        "reservation_half_hour": temporal.half_hour_slot(F.col("datetime")),
    }).transform(cleaning.rename_columns, K.FEATURE_NAMES)


@query("feature_projection", f"""
WITH {star_sql(roles.EVENT_BOOKINGS_SQL)}
SELECT booking_id, people AS party_size, purpose AS dining_purpose, is_hotel AS hotel_restaurant, lat, lng,
       {slot_sql('datetime')} AS reservation_half_hour
FROM star""")
def feature_projection(spark, sf):
    target, leakage = resolve_granularity("half_hour")
    wide = _slotted_features(spark, sf).select(
        "booking_id", "booking_time", "reservation_time", "party_size", "dining_purpose", "hotel_restaurant",
        "city_code", "city_area_code", "lat", "lng", "member_birthdate", "member_city_code",
        "reservation_hour", "reservation_seconds", "reservation_half_hour")
    return cleaning.feature_projection(wide, target, leakage)


@query("prepare_x", f"""
WITH {star_sql(roles.EVENT_BOOKINGS_SQL)}
SELECT booking_id, people AS party_size, purpose AS dining_purpose, member_gender AS account_gender,
       is_vip AS is_vip_member, lat
FROM star""")
def prepare_x(spark, sf):
    target, leakage = resolve_granularity("half_hour")
    wide = _slotted_features(spark, sf).select(
        "booking_id", "booking_time", "party_size", "dining_purpose", "booking_status", "account_gender",
        "is_vip_member", "city_code", "lat", "reservation_hour", "reservation_half_hour")
    return cleaning.model_inputs(wide, target, leakage)


@query("feature_align", f"""
SELECT booking_id, CAST(hour(datetime) AS INT) AS reservation_hour, people AS party_size,
       purpose AS dining_purpose, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS INT) AS restaurant_density
FROM ({roles.EVENT_BOOKINGS_SQL})""")
def feature_align(spark, sf):
    rows = roles.event_bookings(spark, sf).select(
        "booking_id", F.col("purpose").alias("dining_purpose"), F.col("people").alias("party_size"),
        F.hour("datetime").alias("reservation_hour"), "status")
    wanted = T.StructType([T.StructField("booking_id", T.LongType())] + [
        f for f in BOOKING_RECORD
        if f.name in ("reservation_hour", "party_size", "dining_purpose", "lat", "restaurant_density")])
    return cleaning.align_features(rows, wanted)


@query("sample_rows", """
SELECT event_id, user_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100""")
def sample_rows(spark, sf):
    return cleaning.sample_rows(table(spark, sf, "events"), "event_id", 100).select(
        "event_id", "user_id", "event_type")


@query("load_features", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {stamp_sql('l_shipdate')} AS l_shipdate, round(l_extendedprice, 6) AS l_extendedprice
FROM lineitem""")
def load_features(spark, sf):
    schema = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_shipdate TIMESTAMP_NTZ, l_extendedprice DOUBLE"
    return comparable(spark.read.schema(schema).parquet(f"{sf}/lineitem.parquet"))


# --- cleaning -----------------------------------------------------------------------------------------

_LABELLED_SQL = "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _labelled(spark, sf):
    """Documents with their labels; most have none."""
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, sf, "labels"), "doc_id", "left")


@query("fill_constant", f"""
SELECT booking_id, coalesce(gender, 'Unknown') AS gender FROM ({roles.EVENT_BOOKINGS_SQL})""")
def fill_constant(spark, sf):
    return cleaning.fill_constant(roles.event_bookings(spark, sf), "gender").select("booking_id", "gender")


def _dirty_dates(spark, sf):
    """Times as text in two formats, some unreadable."""
    ts, v = F.col("ts"), F.col("value")
    text = (F.when(v > 30, "0000-00-00").when(F.col("event_type") == "click", F.date_format(ts, K.PROFILE_TIME_FORMAT))
            .otherwise(F.date_format(ts, K.BOOKING_TIME_FORMAT)))
    return table(spark, sf, "events").select("event_id", text.alias("datetime"))


@query("parse_datetime", f"""
SELECT event_id, CASE WHEN value > 30 THEN NULL
                      WHEN event_type = 'click' THEN {stamp_sql("date_trunc('minute', ts)")}
                      ELSE {stamp_sql('ts')} END AS datetime
FROM events""")
def parse_datetime(spark, sf):
    return comparable(cleaning.parse_datetime(_dirty_dates(spark, sf), "datetime"))


@query("trim_ws", "SELECT event_id, event_type AS label FROM events")
def trim_ws(spark, sf):
    padded = F.concat(F.lit(" \t　"), F.col("event_type"), F.lit("　 \n"))
    return cleaning.trim_whitespace(
        table(spark, sf, "events").select("event_id", padded.alias("label")), "label")


@query("map_values", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'view' WHEN 'error' THEN 'Unknown' ELSE event_type END AS event_type
FROM events""")
def map_values(spark, sf):
    return cleaning.map_values(table(spark, sf, "events"), "event_type",
                               {"click": "view", "error": "Unknown"}).select("event_id", "event_type")


@query("map_values_table", """
SELECT o_orderkey, coalesce(c_mktsegment, CAST(o_custkey AS VARCHAR)) AS customer
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def map_values_table(spark, sf):
    mapping = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("old"), F.col("c_mktsegment").alias("new"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return cleaning.map_values_from(rows, "customer", mapping)


@query("remove_value", f"""
SELECT booking_id, gender FROM ({roles.EVENT_BOOKINGS_SQL}) WHERE gender IS DISTINCT FROM 'M'""")
def remove_value(spark, sf):
    return cleaning.remove_value(roles.event_bookings(spark, sf), "gender", "M").select("booking_id", "gender")


@query("filter_invalid_dates", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate <= l_shipdate""")
def filter_invalid_dates(spark, sf):
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return cleaning.filter_invalid_dates(joined, "o_orderdate", "l_shipdate").select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("invalid_age", f"""
SELECT id, CAST(birthdate AS VARCHAR) AS birthdate FROM ({roles.MEMBERS_SQL})
WHERE date_diff('year', birthdate, DATE '2024-01-31')
      - CASE WHEN strftime(birthdate, '%m%d') > '0131' THEN 1 ELSE 0 END NOT BETWEEN 0 AND 60""")
def invalid_age(spark, sf):
    found = cleaning.invalid_age(roles.members(spark, sf), "birthdate", F.lit("2024-01-31").cast("date"), 60)
    return comparable(found.select("id", "birthdate"))


@query("future_dates", f"SELECT event_id, {stamp_sql('ts')} AS ts FROM events WHERE ts > TIMESTAMP '2024-01-28 12:00:00'")
def future_dates(spark, sf):
    as_of = F.lit("2024-01-28 12:00:00").cast("timestamp_ntz")
    return comparable(cleaning.future_dates(table(spark, sf, "events"), "ts", as_of).select("event_id", "ts"))


@query("invalid_price", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
def invalid_price(spark, sf):
    return cleaning.invalid_price(table(spark, sf, "supplier"), "s_acctbal").select("s_suppkey", "s_acctbal")


@query("dropna_any", f"SELECT * FROM ({_LABELLED_SQL}) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def dropna_any(spark, sf):
    return cleaning.fill_numeric(_labelled(spark, sf), "drop")


@query("fill_numeric_mean", f"""
WITH t AS ({_LABELLED_SQL})
SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM t)), 6) AS quality,
       round(coalesce(toxic, (SELECT avg(toxic) FROM t)), 6) AS toxic FROM t""")
def fill_numeric_mean(spark, sf):
    filled = cleaning.fill_numeric(_labelled(spark, sf), "mean", columns=["quality", "toxic"])
    return comparable(filled.select("doc_id", "quality", "toxic"))


@query("fill_numeric_median", f"""
WITH {star_sql(roles.EVENT_BOOKINGS_SQL)}
SELECT booking_id, round(coalesce(price1, (SELECT quantile_cont(price1, 0.5) FROM star)), 6) AS price1,
       round(coalesce(lat, (SELECT quantile_cont(lat, 0.5) FROM star)), 6) AS lat FROM star""")
def fill_numeric_median(spark, sf):
    filled = cleaning.fill_numeric(roles.event_star(spark, sf), "median", columns=["price1", "lat"])
    return comparable(filled.select("booking_id", "price1", "lat"))


_DIRTY_PURPOSE_SQL = """CASE event_type WHEN 'click' THEN 'Friends' WHEN 'view' THEN '請選擇'
    WHEN 'error' THEN '&#65533;&#40115;&#65533;&#65533;&#26813;&#65533;' WHEN 'signup' THEN NULL ELSE 'Birthday' END"""


def _dirty_bookings(spark, sf):
    """Bookings as they arrive: text times, padded and mixed-language purposes."""
    b = roles.event_bookings(spark, sf)
    kind = F.col("purpose")
    dirty = (F.when(kind == "click", " 　Friends ").when(kind == "view", "請選擇")
             .when(kind == "error", K.JUNK_PURPOSE).when(kind == "signup", None).otherwise("Birthday\t"))
    return b.withColumns({
        "purpose": dirty,
        "cdate": F.date_format("cdate", K.BOOKING_TIME_FORMAT),
        "datetime": F.date_format("datetime", K.BOOKING_TIME_FORMAT)})


@query("clean_orders", f"""
SELECT booking_id, {stamp_sql('cdate')} AS cdate, {stamp_sql('datetime')} AS datetime,
       CASE purpose WHEN 'click' THEN '朋友聚餐' WHEN 'view' THEN 'Unknown' WHEN 'signup' THEN 'Unknown'
                    ELSE '生日慶祝' END AS purpose
FROM ({roles.EVENT_BOOKINGS_SQL}) WHERE purpose <> 'error'""")
def clean_orders(spark, sf):
    cleaned = cleaning.clean_bookings(_dirty_bookings(spark, sf))
    return comparable(cleaned.select("booking_id", "cdate", "datetime", "purpose"))


@query("clean_restaurants", """
SELECT s_suppkey AS id, CASE s_nationkey % 3 WHEN 0 THEN '桃園市' WHEN 1 THEN 'Unknown' ELSE '台北市' END AS city,
       CASE WHEN s_nationkey % 4 IN (0, 1) THEN 'Unknown' ELSE n_name END AS cityarea,
       '2012-04-01 00:30:00' AS cdate
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def clean_restaurants(spark, sf):
    key = F.col("s_nationkey")
    raw = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("s_suppkey").alias("id"),
        F.when(key % 3 == 0, "桃園縣").when(key % 3 == 1, "%").otherwise("台北市").alias("city"),
        F.when(key % 4 == 0, "請選擇").when(key % 4 == 1, None).otherwise(F.col("n_name")).alias("cityarea"),
        F.lit("4/1/2012 0:30").alias("cdate"))
    return comparable(cleaning.clean_restaurants(raw))


@query("clean_members", f"""
SELECT id, coalesce(gender, 'Unknown') AS gender,
       CASE city WHEN 'BUILDING' THEN '桃園市' WHEN 'MACHINERY' THEN 'Unknown' WHEN 'HOUSEHOLD' THEN 'Unknown' ELSE city END AS city,
       CASE WHEN is_vip = 1 THEN NULL ELSE {stamp_sql('birthdate')} END AS birthdate
FROM ({roles.MEMBERS_SQL}) WHERE city <> 'FURNITURE'""")
def clean_members(spark, sf):
    city = F.col("city")
    raw = roles.members(spark, sf).withColumns({
        "city": F.when(city == "BUILDING", "桃園縣").when(city == "MACHINERY", "0").when(city == "HOUSEHOLD", None)
        .when(city == "FURNITURE", K.JUNK_MEMBER_CITY).otherwise(city),
        "birthdate": F.when(F.col("is_vip") == 1, "0000-00-00").otherwise(F.col("birthdate").cast("string")),
        "cdate": F.lit("4/1/2012 0:30")})
    return comparable(cleaning.clean_members(raw).select("id", "gender", "city", "birthdate"))


@query("meal_subset_filter", f"""
SELECT event_id, {slot_sql('ts')} AS slot FROM events WHERE hour(ts) BETWEEN 18 AND 23""")
def meal_subset_filter(spark, sf):
    rows = table(spark, sf, "events").withColumn("hour", F.hour("ts"))
    return cleaning.band_filter(rows, "hour", 18, 23).select(
        "event_id", temporal.half_hour_slot(F.col("ts")).alias("slot"))


@query("constraint_report", f"""
WITH b AS ({roles.EVENT_BOOKINGS_SQL})
SELECT 'booking_id' AS "column", 'not_null' AS rule, CAST(sum(CASE WHEN booking_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM b
UNION ALL SELECT 'gender', 'not_null', CAST(sum(CASE WHEN gender IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM b
UNION ALL SELECT 'people', 'range', CAST(sum(CASE WHEN people < 2 OR people > 8 THEN 1 ELSE 0 END) AS BIGINT) FROM b
UNION ALL SELECT 'status', 'allowed', CAST(sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) FROM b
UNION ALL SELECT 'return90', 'allowed', CAST(sum(CASE WHEN return90 NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) FROM b
UNION ALL SELECT 'member_id', 'unique', CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM b GROUP BY member_id)""")
def constraint_report(spark, sf):
    rules = [Rule("booking_id", "not_null"), Rule("gender", "not_null"), Rule("people", "range", low=2, high=8),
             Rule("status", "allowed", allowed=("ok",)), Rule("return90", "allowed", allowed=(0, 1)),
             Rule("member_id", "unique")]
    return profile.constraint_report(roles.event_bookings(spark, sf), rules)


@query("schema_conformance", f"""
WITH r AS ({roles.RESTAURANTS_SQL})
SELECT 'id' AS "column", 'not_null' AS rule, CAST(sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM r
UNION ALL SELECT 'is_hotel', 'allowed', CAST(sum(CASE WHEN is_hotel NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) FROM r
UNION ALL SELECT 'wifi', 'allowed', CAST(sum(CASE WHEN wifi NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) FROM r
UNION ALL SELECT 'price1', 'not_null', CAST(sum(CASE WHEN price1 IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM r
UNION ALL SELECT 'lat', 'range', CAST(sum(CASE WHEN lat < -90 OR lat > 90 THEN 1 ELSE 0 END) AS BIGINT) FROM r
UNION ALL SELECT 'lng', 'range', CAST(sum(CASE WHEN lng < -180 OR lng > 180 THEN 1 ELSE 0 END) AS BIGINT) FROM r
UNION ALL SELECT 'id', 'unique', CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY id)""")
def schema_conformance(spark, sf):
    wanted = {("id", "not_null"), ("id", "unique"), ("is_hotel", "allowed"), ("wifi", "allowed"),
              ("lat", "range"), ("lng", "range")}
    rules = [r for r in RESTAURANT_RULES if (r.column, r.kind) in wanted] + [Rule("price1", "not_null")]
    return profile.constraint_report(roles.restaurants(spark, sf), rules)


def _rule_sql(name: str, rule: Rule) -> str:
    """A row of the report: the rule said in SQL."""
    c, head = rule.column, f"SELECT '{name}' AS \"table\", '{rule.column}' AS \"column\", '{rule.kind}' AS rule, "
    listed = ", ".join(repr(v) for v in rule.allowed)
    if rule.kind == "unique":
        return f"{head}CAST(coalesce(sum(n), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM {name} GROUP BY {c} HAVING count(*) > 1)"
    if rule.kind == "references":
        other, key = rule.target
        return f"{head}count(*) AS violations FROM {name} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {other} o WHERE o.{key} = x.{c})"
    broken = {"not_null": f"{c} IS NULL", "allowed": f"{c} NOT IN ({listed})", "range": f"{c} NOT BETWEEN {rule.low} AND {rule.high}"}[rule.kind]
    return f"{head}count(*) AS violations FROM {name} WHERE {broken}"


@query("declared_rules", f"""
WITH bookings AS ({roles.RAW_BOOKINGS_SQL}), members AS ({roles.RAW_MEMBERS_SQL}), restaurants AS ({roles.RAW_RESTAURANTS_SQL})
""" + "\nUNION ALL ".join(_rule_sql(name, r) for name, rules in RAW_RULES.items() for r in rules))
def declared_rules(spark, sf):
    """Every declared rule of bookings, members and restaurants, references between them included."""
    return profile.declared_report(roles.raw_tables(spark, sf), RAW_RULES)


@query("category_levels", """
SELECT DISTINCT 'event_type' AS "column", event_type AS label FROM events
UNION ALL SELECT DISTINCT 'user_id', CAST(user_id AS VARCHAR) FROM events""")
def category_levels(spark, sf):
    return profile.category_levels(table(spark, sf, "events"), ["event_type", "user_id"])


# --- routing ------------------------------------------------------------------------------------------


@query("route_to_subsets", f"SELECT event_id, {band_sql('hour(ts)')} AS subset FROM events")
def route_to_subsets(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.hour("ts").alias("reservation_hour"))
    return route(rows).select("event_id", "subset")


@query("route_unmatched", "SELECT event_id, CAST(hour(ts) AS INT) AS reservation_hour FROM events WHERE hour(ts) < 11")
def route_unmatched(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.hour("ts").alias("reservation_hour"))
    return route(rows).filter(F.col("subset") == K.UNMATCHED).select("event_id", "reservation_hour")


@query("holiday_range_join", """
SELECT o_orderkey, CASE WHEN EXISTS (
    SELECT 1 FROM (VALUES (DATE '1998-01-01'), (DATE '1998-02-28'), (DATE '1998-10-10')) h(d)
    WHERE abs(date_diff('day', h.d, CAST(o_orderdate AS DATE))) <= 7) THEN 1 ELSE 0 END AS is_holiday_vicinity
FROM orders""")
def holiday_range_join(spark, sf):
    holidays = spark.createDataFrame([(d,) for d in roles.HOLIDAYS_1998], "date STRING").select(
        F.to_date("date").alias("date"))
    return joins.near_holiday_table(table(spark, sf, "orders"), "o_orderdate", holidays).select(
        "o_orderkey", "is_holiday_vicinity")
