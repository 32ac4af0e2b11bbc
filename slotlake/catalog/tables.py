"""Queries on whole tables: keys, joins, feature tables, splits, encoders, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.catalog import roles
from slotlake.catalog.registry import comparable, query, table
from slotlake.catalog.roles import band_sql, is_test_sql, slot_sql, stamp_sql, star_sql
from slotlake.functions import temporal
from slotlake.operators import cleaning, encode, joins, keys, profile, routing, split
from slotlake.plans import etl, scoring
from slotlake.schema import BOOKING_RECORD, BOOKINGS
from slotlake.session import freeze, new_path
from slotlake.sources import delimited, payload

# --- keys ------------------------------------------------------------------------------------------

_DAILY_SQL = "SELECT event_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts FROM events"


def _daily(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "ts")


@query("get_duplicates", f"""
SELECT event_id, user_id, event_type, day FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id, event_type, day) AS n FROM ({_DAILY_SQL})) WHERE n > 1""")
def get_duplicates(spark, sf):
    return keys.duplicates(_daily(spark, sf), ["user_id", "event_type", "day"]).drop("ts")


@query("dedupe_keep_last", f"""
SELECT event_id, user_id, event_type, day FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts DESC, event_id DESC) AS rn
    FROM ({_DAILY_SQL})) WHERE rn = 1""")
def dedupe_keep_last(spark, sf):
    return keys.keep_last(_daily(spark, sf), ["user_id", "event_type", "day"], ["ts", "event_id"]).drop("ts")


@query("duplicate_key_check", """
SELECT 'events.event_id' AS key_name, count(*) > count(DISTINCT event_id) AS has_duplicates FROM events
UNION ALL SELECT 'events.user_id', count(*) > count(DISTINCT user_id) FROM events
UNION ALL SELECT 'orders.o_orderkey', count(*) > count(DISTINCT o_orderkey) FROM orders""")
def duplicate_key_check(spark, sf):
    events, orders = table(spark, sf, "events"), table(spark, sf, "orders")
    checks = [(events, "events", "event_id"), (events, "events", "user_id"), (orders, "orders", "o_orderkey")]
    parts = [keys.duplicate_key_check(df, [k]).select(F.lit(f"{t}.{k}").alias("key_name"), "has_duplicates")
             for df, t, k in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- joins -----------------------------------------------------------------------------------------------


def _merge(name, how, sql_join, key):
    sql = f"""
SELECT {key} AS id, u.n, s.s_name, s.s_acctbal
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u
{sql_join} JOIN (SELECT * FROM supplier) s ON u.user_id = s.s_suppkey"""

    @query(name, sql)
    def run(spark, sf):
        left = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
        right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", "s_acctbal")
        return joins.merge(left, right, ["id"], how, unique_right=True).select("id", "n", "s_name", "s_acctbal")
    return run


_merge("merge_left", "left", "LEFT", "u.user_id")
_merge("merge_inner", "inner", "INNER", "u.user_id")
_merge("merge_right", "right", "RIGHT", "s.s_suppkey")
_merge("merge_outer", "outer", "FULL OUTER", "coalesce(u.user_id, s.s_suppkey)")


@query("merge_null_safe", f"""
SELECT b.booking_id, g.n FROM ({roles.EVENT_BOOKINGS_SQL}) b
LEFT JOIN (SELECT gender, count(*) AS n FROM ({roles.EVENT_BOOKINGS_SQL}) GROUP BY gender) g
ON b.gender IS NOT DISTINCT FROM g.gender""")
def merge_null_safe(spark, sf):
    bookings = roles.event_bookings(spark, sf).select("booking_id", "gender")
    sizes = bookings.groupBy("gender").agg(F.count("*").alias("n"))
    return joins.merge(bookings, sizes, ["gender"], "left", null_safe=True).select("booking_id", "n")


_STAR_OUT = """booking_id, member_id, {cdate} AS cdate, restaurant_id, {datetime} AS datetime, people, purpose, gender,
       status, is_required_prepay_satisfied, return90, is_hotel, city, cityarea, good_for_family, accept_credit_card,
       parking, outdoor_seating, wifi, wheelchair_accessible, round(price1, 6) AS price1, round(price2, 6) AS price2,
       round(lat, 6) AS lat, round(lng, 6) AS lng, is_vip, member_gender, CAST(birthdate AS VARCHAR) AS birthdate,
       member_city""".format(cdate=stamp_sql("cdate"), datetime=stamp_sql("datetime"))


@query("star_join", f"WITH {star_sql(roles.EVENT_BOOKINGS_SQL)} SELECT {_STAR_OUT} FROM star")
def star_join(spark, sf):
    return comparable(roles.event_star(spark, sf))


@query("weather_join", """
WITH w AS (SELECT CAST(ts AS DATE) AS date, event_type AS city, round(avg(value), 6) AS avg_temperature,
                  CAST(max(value) > 50 AS INT) AS is_raining
           FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)
SELECT e.event_id, e.event_type AS city, w.avg_temperature, w.is_raining
FROM events e LEFT JOIN w ON CAST(e.ts AS DATE) = w.date AND e.event_type = w.city""")
def weather_join(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("city"), "value")
    weather = events.filter("city <> 'signup'").groupBy(F.to_date("ts").alias("date"), "city").agg(
        F.round(F.avg("value"), 6).alias("avg_temperature"), (F.max("value") > 50).cast("int").alias("is_raining"))
    return joins.weather_join(events, weather, "ts").select("event_id", "city", "avg_temperature", "is_raining")


# --- feature tables --------------------------------------------------------------------------------------------


def _venue_sql(stars: str = "star") -> str:
    """Popularity and density of the rows in ``star``."""
    return f"""
hc AS (SELECT restaurant_id, CAST(hour(datetime) AS INT) AS h, count(*) AS c FROM {stars} GROUP BY 1, 2),
pop AS (SELECT restaurant_id, h FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY c DESC, h) AS rn
        FROM hc WHERE h IS NOT NULL) WHERE rn = 1),
ratio AS (SELECT restaurant_id, avg(CASE WHEN hour(datetime) BETWEEN 17 AND 21 THEN 1.0 ELSE 0.0 END) AS r FROM {stars} GROUP BY 1),
ov AS (SELECT h FROM (SELECT h, sum(c) AS c FROM hc GROUP BY h) ORDER BY c DESC, h LIMIT 1),
den AS (SELECT cityarea, count(DISTINCT restaurant_id) AS n FROM {stars} WHERE cityarea IS NOT NULL GROUP BY 1)"""


def _features_sql(holidays: tuple[str, ...]) -> str:
    near = " OR ".join(f"abs(date_diff('day', DATE '{h}', CAST(datetime AS DATE))) <= 7" for h in holidays)

    def payday(month):
        return f"abs(date_diff('day', CAST({month} + INTERVAL 4 DAY AS DATE), CAST(datetime AS DATE)))"
    month = "date_trunc('month', datetime)"
    days = f"least({payday(month)}, {payday(f'({month} - INTERVAL 1 MONTH)')}, {payday(f'({month} + INTERVAL 1 MONTH)')})"
    return f"""
feat AS (SELECT s.booking_id, {stamp_sql('cdate')} AS booking_time, {stamp_sql('datetime')} AS reservation_time,
    people AS party_size, purpose AS dining_purpose, gender AS booked_by_gender,
    is_required_prepay_satisfied AS prepay_satisfied, is_hotel AS hotel_restaurant, city AS city_code,
    s.cityarea AS city_area_code, good_for_family AS family_friendly, accept_credit_card AS accepts_credit_card,
    parking AS has_parking, outdoor_seating, wifi AS has_wifi, wheelchair_accessible, round(lat, 6) AS lat,
    round(lng, 6) AS lng, is_vip AS is_vip_member, member_gender AS account_gender,
    CAST(birthdate AS VARCHAR) AS member_birthdate, member_city AS member_city_code,
    round((epoch_us(datetime) - epoch_us(cdate)) / 3.6e9, 6) AS lead_time,
    CAST(year(datetime) - year(birthdate) AS INT) AS age, CAST(hour(cdate) AS INT) AS booking_hour,
    CAST(hour(datetime) AS INT) AS reservation_hour,
    CAST(hour(datetime) * 3600 + minute(datetime) * 60 + second(datetime) AS INT) AS reservation_seconds,
    {slot_sql('datetime')} AS reservation_half_hour, CAST(isodow(datetime) AS INT) AS weekday,
    round((price1 + price2) / 2, 6) AS avg_price, CASE WHEN {near} THEN 1 ELSE 0 END AS is_holiday_vicinity,
    CAST({days} AS DOUBLE) AS days_from_payday, coalesce(p.h, (SELECT h FROM ov)) AS popular_hour,
    round(coalesce(r.r, 0), 6) AS dinner_ratio, CAST(coalesce(d.n, 0) AS INT) AS restaurant_density
  FROM star s LEFT JOIN pop p ON s.restaurant_id = p.restaurant_id
  LEFT JOIN ratio r ON s.restaurant_id = r.restaurant_id LEFT JOIN den d ON s.cityarea = d.cityarea)"""


@query("features_ready", f"""
WITH {star_sql(roles.ORDER_BOOKINGS_SQL)}, {_venue_sql()}, {_features_sql(roles.HOLIDAYS_1998)}
SELECT * EXCLUDE (booking_id) FROM feat""")
def features_ready(spark, sf):
    return comparable(etl.build_features(
        roles.order_bookings(spark, sf), roles.restaurants(spark, sf), roles.members(spark, sf),
        holidays=roles.HOLIDAYS_1998))


EVENT_FEATURES_SQL = f"{star_sql(roles.EVENT_BOOKINGS_SQL)}, {_venue_sql()}, {_features_sql(roles.HOLIDAYS_2024)}"


@query("features_ready_events", f"""
WITH {EVENT_FEATURES_SQL}
SELECT * EXCLUDE (booking_id) FROM feat""")
def features_ready_events(spark, sf):
    return comparable(etl.transform_features(roles.event_star(spark, sf), roles.HOLIDAYS_2024))


def _raw_event_bookings(spark, sf):
    """Bookings as text, the way they arrive; canceled ones carry the value that is dropped."""
    return roles.event_bookings(spark, sf).withColumns({
        "purpose": F.when(F.col("purpose") == "error", K.JUNK_PURPOSE).otherwise(F.col("purpose")),
        "cdate": F.date_format("cdate", K.BOOKING_TIME_FORMAT),
        "datetime": F.date_format("datetime", K.BOOKING_TIME_FORMAT)})


_ETL_SQL = f"""
WITH {star_sql(f'''SELECT * REPLACE (date_trunc('second', cdate) AS cdate, date_trunc('second', datetime) AS datetime)
FROM ({roles.EVENT_BOOKINGS_SQL}) WHERE purpose <> 'error' ''')}, {_venue_sql()}, {_features_sql(roles.HOLIDAYS_2024)}"""


@query("etl_from_raw", f"{_ETL_SQL} SELECT * FROM feat")
def etl_from_raw(spark, sf):
    return comparable(etl.features_from_raw(
        _raw_event_bookings(spark, sf), roles.restaurants(spark, sf), roles.members(spark, sf),
        keep=["booking_id"], holidays=roles.HOLIDAYS_2024))


# --- splits and folds --------------------------------------------------------------------------------------------


@query("split_random", f"""
SELECT event_id, CASE WHEN {is_test_sql('event_id')} THEN 'test' ELSE 'train' END AS part FROM events""")
def split_random(spark, sf):
    train, test = split.split_random(table(spark, sf, "events").select("event_id"), "event_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("split_temporal", """
SELECT event_id, CASE WHEN rn > n - ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)""")
def split_temporal(spark, sf):
    train, test = split.split_temporal(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part")))


@query("stratified_folds", f"""
SELECT event_id, slot, CAST((row_number() OVER (PARTITION BY slot ORDER BY md5(CAST(event_id AS VARCHAR))) - 1) % 5 AS INT) AS fold
FROM (SELECT event_id, {slot_sql('ts')} AS slot FROM events)""")
def stratified_folds(spark, sf):
    rows = table(spark, sf, "events").select("event_id", temporal.half_hour_slot(F.col("ts")).alias("slot"))
    return split.stratified_folds(rows, "slot", "event_id")


# --- encoders ---------------------------------------------------------------------------------------------------

# test rows call "view" by another name, so that they hold a level unseen in training
_RENAMED_SQL = "CASE WHEN is_test AND purpose = 'view' THEN 'late view' ELSE purpose END"
_ENCODE_SQL = f"""
t AS (SELECT booking_id, {_RENAMED_SQL} AS dining_purpose, gender AS booked_by_gender, is_test
      FROM (SELECT *, {is_test_sql('booking_id')} AS is_test FROM ({roles.EVENT_BOOKINGS_SQL}))),
lp AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS code FROM
       (SELECT DISTINCT dining_purpose AS label FROM t WHERE NOT is_test)),
lg AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS code FROM
       (SELECT DISTINCT coalesce(booked_by_gender, 'Unknown') AS label FROM t WHERE NOT is_test)),
enc AS (SELECT t.booking_id, t.is_test, t.dining_purpose, lp.code AS dining_purpose_code, lg.code AS booked_by_gender_code
        FROM t LEFT JOIN lp ON t.dining_purpose = lp.label LEFT JOIN lg ON coalesce(t.booked_by_gender, 'Unknown') = lg.label)"""


def _renamed():
    late = split.is_test_row(F.col("booking_id")) & (F.col("purpose") == "view")
    return F.when(late, "late view").otherwise(F.col("purpose"))


def _encoder_rows(spark, sf):
    rows = roles.event_bookings(spark, sf).select("booking_id", _renamed().alias("dining_purpose"), F.col("gender").alias("booked_by_gender"))
    return split.split_random(rows, "booking_id")


_CODES = ["booking_id", "dining_purpose_code", "booked_by_gender_code"]


@query("encode_native", f"""
WITH {_ENCODE_SQL} SELECT booking_id, dining_purpose_code, booked_by_gender_code FROM enc""")
def encode_native(spark, sf):
    train, test, _ = encode.encode_native(*_encoder_rows(spark, sf))
    return train.select(_CODES).unionByName(test.select(_CODES))


@query("encode_ordinal", f"""
WITH {_ENCODE_SQL} SELECT booking_id, coalesce(dining_purpose_code, -1) AS dining_purpose_code,
       coalesce(booked_by_gender_code, -1) AS booked_by_gender_code FROM enc""")
def encode_ordinal(spark, sf):
    train, test, _ = encode.encode_ordinal(*_encoder_rows(spark, sf))
    return train.select(_CODES).unionByName(test.select(_CODES))


@query("encode_apply_unseen", f"""
WITH {_ENCODE_SQL} SELECT dining_purpose, dining_purpose_code, count(*) AS n FROM enc WHERE is_test GROUP BY 1, 2""")
def encode_apply_unseen(spark, sf):
    train, test = _encoder_rows(spark, sf)
    levels = encode.fit_levels(train)
    return encode.apply_levels(test, levels).groupBy("dining_purpose", "dining_purpose_code").agg(
        F.count("*").alias("n"))


@query("target_encode_roundtrip", f"""
WITH s AS ({roles.SLOTTED_SQL}),
codes AS (SELECT slot, CAST(row_number() OVER (ORDER BY slot) - 1 AS INT) AS target_code
          FROM (SELECT DISTINCT slot FROM s WHERE NOT is_test))
SELECT s.event_id, s.slot, c.target_code, c.slot AS decoded FROM s LEFT JOIN codes c ON s.slot = c.slot WHERE s.is_test""")
def target_encode_roundtrip(spark, sf):
    rows = roles.slotted_events(spark, sf)
    codes = encode.fit_target(rows.filter("not is_test"), "slot")
    coded = encode.encode_target(rows.filter("is_test").select("event_id", "slot"), codes, "slot")
    return encode.decode_target(coded, codes, "target_code", "decoded")


_ONE_HOT_SQL = f"""
SELECT booking_id, is_test, CAST(purpose = 'click' AS INT) AS purpose_click, CAST(purpose = 'error' AS INT) AS purpose_error,
       CAST(purpose = 'purchase' AS INT) AS purpose_purchase, CAST(purpose = 'signup' AS INT) AS purpose_signup,
       CAST(purpose = 'view' AS INT) AS purpose_view,
       CAST(coalesce(gender = 'F', false) AS INT) AS "gender_F", CAST(coalesce(gender = 'M', false) AS INT) AS "gender_M",
       {', '.join(f'CAST(isodow(datetime) = {d} AS INT) AS weekday_{d}' for d in range(2, 8))}
FROM (SELECT * REPLACE ({_RENAMED_SQL} AS purpose) FROM (SELECT *, {is_test_sql('booking_id')} AS is_test FROM ({roles.EVENT_BOOKINGS_SQL})))"""


def _one_hot_rows(spark, sf):
    rows = roles.event_bookings(spark, sf).select(
        "booking_id", _renamed().alias("purpose"), "gender", temporal.iso_weekday(F.col("datetime")).alias("weekday"))
    train, test = split.split_random(rows, "booking_id")
    return train, test, encode.fit_one_hot(train, ["purpose", "gender", "weekday"])


@query("one_hot", f"SELECT * EXCLUDE (is_test) FROM ({_ONE_HOT_SQL}) WHERE NOT is_test")
def one_hot(spark, sf):
    train, _, fitted = _one_hot_rows(spark, sf)
    return encode.apply_one_hot(train, fitted)


@query("one_hot_align", f"SELECT * EXCLUDE (is_test) FROM ({_ONE_HOT_SQL}) WHERE is_test")
def one_hot_align(spark, sf):
    _, test, fitted = _one_hot_rows(spark, sf)
    return encode.apply_one_hot(test, fitted)


@query("one_hot_long", f"""
WITH b AS (SELECT booking_id, {_RENAMED_SQL} AS purpose, gender, isodow(datetime) AS weekday, member_id
      FROM (SELECT *, {is_test_sql('booking_id')} AS is_test FROM ({roles.EVENT_BOOKINGS_SQL}))),
entries AS (SELECT booking_id, 'purpose' AS "column", purpose AS label FROM b UNION ALL SELECT booking_id, 'gender', gender FROM b
            UNION ALL SELECT booking_id, 'weekday', CAST(weekday AS VARCHAR) FROM b UNION ALL SELECT booking_id, 'member_id', CAST(member_id AS VARCHAR) FROM b),
kept AS (SELECT * FROM entries WHERE label IS NOT NULL AND NOT ("column" = 'weekday' AND label = '1')),
levels AS (SELECT "column", label, row_number() OVER (ORDER BY "column", label) - 1 AS position
           FROM (SELECT DISTINCT "column", label FROM kept WHERE NOT {is_test_sql('booking_id')}))
SELECT booking_id, "column", position FROM kept JOIN levels USING ("column", label)""")
def one_hot_long(spark, sf):
    """The ones of all bookings by levels of the training rows, members included."""
    rows = roles.event_bookings(spark, sf).select(
        "booking_id", _renamed().alias("purpose"), "gender", temporal.iso_weekday(F.col("datetime")).alias("weekday"), "member_id")
    columns = ["purpose", "gender", "weekday", "member_id"]
    levels = encode.one_hot_levels(split.split_random(rows, "booking_id")[0], columns)
    return encode.one_hot_long(rows, "booking_id", levels, columns)


@query("scale_numeric", f"""
WITH t AS (SELECT event_id, value, user_id, {is_test_sql('event_id')} AS is_test FROM events),
f AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su FROM t WHERE NOT is_test)
SELECT event_id, round((value - mv) / sv, 6) AS value, round((user_id - mu) / su, 6) AS user_id FROM t, f""")
def scale_numeric(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value", "user_id")
    train, _ = split.split_random(rows, "event_id")
    return comparable(encode.apply_scaling(rows, encode.fit_scaling(train, ["value", "user_id"])))


@query("rare_category_merge", """
SELECT c.c_custkey, CASE WHEN n.n < (SELECT count(*) / 25.0 FROM customer) THEN 'Unknown' ELSE CAST(c.c_nationkey AS VARCHAR) END AS nation
FROM customer c JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) n ON c.c_nationkey = n.c_nationkey""")
def rare_category_merge(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    # below the average size of a category; a whole number of rows decides the same way
    minimum = -(-rows.count() // 25)
    return profile.merge_rare_categories(rows, "nation", minimum)


# --- most-frequent-slot scoring ---------------------------------------------------------------------------------------


@query("baseline_mode", f"""
WITH ev AS ({roles.SLOTTED_SQL}), sc AS (SELECT subset, slot, count(*) AS c FROM ev WHERE NOT is_test GROUP BY 1, 2)
SELECT subset, slot AS baseline FROM
    (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY c DESC, slot) AS rn FROM sc) WHERE rn = 1""")
def baseline_mode(spark, sf):
    return routing.fit_most_frequent(roles.slotted_events(spark, sf).filter("not is_test"), "slot")


_RANGE_SQL = """CASE WHEN baseline IS NOT NULL THEN
    lpad(CAST(baseline // 2 AS VARCHAR), 2, '0') || CASE WHEN baseline % 2 = 1 THEN ':30-' ELSE ':00-' END
    || lpad(CAST(baseline // 2 AS VARCHAR), 2, '0') || CASE WHEN baseline % 2 = 1 THEN ':59' ELSE ':29' END END"""


@query("run_inference_baseline", f"""
WITH ev AS ({roles.SLOTTED_SQL}),
sc AS (SELECT subset, slot, count(*) AS c FROM ev WHERE NOT is_test AND subset <> '_unmatched' GROUP BY 1, 2),
base AS (SELECT subset, slot AS baseline FROM
    (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY c DESC, slot) AS rn FROM sc) WHERE rn = 1)
SELECT e.event_id, b.baseline AS reservation_half_hour, {_RANGE_SQL} AS time_range, e.subset
FROM ev e LEFT JOIN base b ON e.subset = b.subset WHERE e.is_test""")
def run_inference_baseline(spark, sf):
    rows = roles.slotted_events(spark, sf)
    fitted = routing.fit_most_frequent(rows.filter("not is_test and subset <> '_unmatched'"), "slot")
    return scoring.score_most_frequent(rows.filter("is_test").drop("subset"), fitted, ["event_id"])


@query("raw_to_prediction", f"""
{_ETL_SQL},
r AS (SELECT booking_id, reservation_half_hour AS slot, {band_sql('reservation_hour')} AS subset, {is_test_sql('booking_id')} AS is_test FROM feat),
sc AS (SELECT subset, slot, count(*) AS c FROM r WHERE NOT is_test AND subset <> '_unmatched' GROUP BY 1, 2),
base AS (SELECT subset, slot AS baseline FROM
    (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY c DESC, slot) AS rn FROM sc) WHERE rn = 1)
SELECT r.booking_id, b.baseline AS reservation_half_hour, {_RANGE_SQL} AS time_range, r.subset
FROM r LEFT JOIN base b ON r.subset = b.subset WHERE r.is_test""")
def raw_to_prediction(spark, sf):
    features = freeze(etl.features_from_raw(
        _raw_event_bookings(spark, sf), roles.restaurants(spark, sf), roles.members(spark, sf),
        keep=["booking_id"], holidays=roles.HOLIDAYS_2024).select("booking_id", "reservation_half_hour", "reservation_hour"), "slots")
    train, test = split.split_random(features, "booking_id")
    fitted = routing.fit_most_frequent(
        routing.route(train).filter(F.col("subset") != K.UNMATCHED), "reservation_half_hour")
    return scoring.score_most_frequent(test, fitted, ["booking_id"])


@query("merge_predictions", f"""
SELECT event_id, CASE subset WHEN 'lunch' THEN 'model a' WHEN 'afternoon' THEN 'model b' WHEN 'dinner' THEN 'model c' END AS model,
       CASE WHEN subset <> '_unmatched' THEN slot END AS slot FROM ({roles.SLOTTED_SQL})""")
def merge_predictions(spark, sf):
    rows = roles.slotted_events(spark, sf)
    parts = [
        rows.filter(F.col("subset") == name).select("event_id", F.lit(model).alias("model"), "slot")
        for name, model in (("lunch", "model a"), ("afternoon", "model b"), ("dinner", "model c"))
    ]
    rest = rows.filter(F.col("subset") == K.UNMATCHED).select("event_id")
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(rest, allowMissingColumns=True)
    return merged.orderBy("event_id")


# --- payloads and raw files -------------------------------------------------------------------------------------------


def payload_requests(spark, sf):
    """A scoring request per eight consecutive events; the row of a rare long value is cut short."""
    cell = lambda c: F.to_json(F.array(c))
    e = table(spark, sf, "events")
    cells = [F.hour("ts"), F.round("value").cast("int"), F.col("event_type"), F.col("value")]
    names = '["reservation_hour","party_size","dining_purpose","avg_price"]'
    texts = [F.substr(cell(c), F.lit(2), F.length(cell(c)) - 2) for c in cells]
    short = F.concat(F.lit("["), F.concat_ws(",", *texts[:3]), F.lit("]"))
    whole = F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))
    entry = F.struct(F.col("event_id"), F.when(F.col("value") > 250, short).otherwise(whole).alias("row"))
    grouped = e.groupBy(F.floor(F.col("event_id") / 8).cast("bigint").alias("request_id")).agg(
        F.sort_array(F.collect_list(entry)).alias("rows"))
    index = F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",")
    data = F.array_join(F.transform("rows", lambda r: r["row"]), ",")
    document = F.concat(F.lit(f'{{"input_data":{{"columns":{names},"index":['), index,
                        F.lit('],"data":['), data, F.lit("]}}"))
    return grouped.select("request_id", document.alias("payload"))


_BAD_REQUESTS_SQL = "SELECT DISTINCT event_id // 8 FROM events WHERE value > 250"


@query("json_payload_rows", f"""
SELECT event_id // 8 AS request_id, event_id AS row_label, CAST(hour(ts) AS INT) AS reservation_hour,
       CAST(round(value) AS INT) AS party_size, event_type AS dining_purpose, value AS avg_price, CAST(NULL AS DOUBLE) AS lat
FROM events WHERE event_id // 8 NOT IN ({_BAD_REQUESTS_SQL})""")
def json_payload_rows(spark, sf):
    valid, _ = payload.split_payloads(payload_requests(spark, sf))
    return payload.payload_rows(valid, BOOKING_RECORD).select(
        "request_id", "row_label", "reservation_hour", "party_size", "dining_purpose", "avg_price", "lat")


@query("payload_validate", f"""
SELECT request_id, CASE WHEN request_id IN ({_BAD_REQUESTS_SQL}) THEN 'row width' END AS problem
FROM (SELECT DISTINCT event_id // 8 AS request_id FROM events)""")
def payload_validate(spark, sf):
    return payload.parse_payloads(payload_requests(spark, sf)).select("request_id", "problem")


@query("json_payload_emit", f"""
SELECT request_id,
       '{{"predictions":{{"columns":["reservation_half_hour","subset"],"index":[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)
       || '],"data":[' || string_agg('[' || coalesce(CAST(s AS VARCHAR), 'null') || ',"' || subset || '"]', ',' ORDER BY event_id) || ']}}}}' AS document
FROM (SELECT event_id // 8 AS request_id, event_id, subset, CASE WHEN subset <> '_unmatched' THEN slot END AS s FROM ({roles.SLOTTED_SQL}))
GROUP BY request_id""")
def json_payload_emit(spark, sf):
    rows = roles.slotted_events(spark, sf).select(
        F.floor(F.col("event_id") / 8).cast("bigint").alias("request_id"),
        (F.col("event_id") % 8).alias("position"), F.col("event_id").alias("row_label"),
        F.when(F.col("subset") != K.UNMATCHED, F.col("slot")).alias("reservation_half_hour"), "subset")
    return payload.emit_payloads(rows, ["reservation_half_hour", "subset"])


@query("record_validate", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(hour(ts) AS INT) END AS reservation_hour,
       CAST(value AS DOUBLE) AS avg_price, event_type AS dining_purpose,
       CASE WHEN event_type = 'error' THEN 'reservation_hour' END AS problem FROM events""")
def record_validate(spark, sf):
    wanted = [f for f in BOOKING_RECORD if f.name in ("reservation_hour", "avg_price", "dining_purpose")]
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "late").otherwise(F.hour("ts").cast("string")).alias("reservation_hour"),
        F.col("value").cast("string").alias("avg_price"), F.col("event_type").alias("dining_purpose"))
    return payload.validate_records(rows, type(BOOKING_RECORD)(wanted))


@query("read_tsv_utf16", f"""
SELECT CAST(booking_id AS INT) AS booking_id, CAST(member_id AS VARCHAR) AS member_id, people, purpose, gender, status,
       {stamp_sql('datetime')} AS datetime
FROM ({roles.EVENT_BOOKINGS_SQL}) b WHERE NOT (purpose = 'click' AND return90 = 1)""")
def read_tsv_utf16(spark, sf):
    """Write the bookings as UTF-16 text with some malformed lines, and read them back."""
    b = roles.event_bookings(spark, sf).withColumns({
        "cdate": F.date_format("cdate", K.BOOKING_TIME_FORMAT),
        "datetime": F.date_format("datetime", K.BOOKING_TIME_FORMAT)})
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BOOKINGS.names])
    bad = (F.col("purpose") == "click") & (F.col("return90") == 1)
    text = F.concat(line, F.when(bad, "\tone field too many").otherwise("")).alias("\t".join(BOOKINGS.names))
    path = new_path(spark, "bookings-utf16")
    (b.select(text).write.option("header", True).option("encoding", "UTF-16").option("sep", "\u0001")
     .option("quote", "\u0000").option("escapeQuotes", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    raw = delimited.read_raw(spark, path, BOOKINGS)
    return comparable(cleaning.parse_datetime(raw, "datetime").select(
        "booking_id", "member_id", "people", "purpose", "gender", "status", "datetime"))
