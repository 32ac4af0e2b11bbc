"""The driver tables in the roles of bookings, restaurants and members.

Each role exists twice, as a DataFrame and as SQL, so that queries and their SQL start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.catalog.registry import table
from slotlake.config import MEAL_BANDS
from slotlake.functions import temporal
from slotlake.operators.joins import star_join
from slotlake.operators.popularity import apply_popularity, hour_counts, overall_popular_hour, popularity_by_restaurant
from slotlake.operators.routing import apply_most_frequent, band_of, fit_most_frequent
from slotlake.operators.split import is_test_row
from slotlake.session import freeze

HOLIDAYS_2024 = ("2024-01-01", "2024-02-10")
HOLIDAYS_1998 = ("1998-01-01", "1998-02-28", "1998-10-10")


# --- bookings with a time of day: events --------------------------------------------------------

EVENT_BOOKINGS_SQL = """
SELECT event_id AS booking_id, user_id AS member_id,
       ts - to_microseconds(CAST(round(value * 3600) AS BIGINT) * 1000000) AS cdate,
       user_id AS restaurant_id, ts AS datetime,
       CAST(1 + k % 10 AS INT) AS people, event_type AS purpose,
       CASE WHEN k % 3 = 0 THEN 'F' WHEN k % 3 = 1 THEN 'M' END AS gender,
       CASE WHEN event_type = 'error' THEN 'canceled' ELSE 'ok' END AS status,
       CAST(k % 2 AS INT) AS is_required_prepay_satisfied,
       CAST(value > 20 AS INT) AS return90
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
"""


def event_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return bookings_from_events(e)


def bookings_from_events(e: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    ahead = F.round(F.col("value") * 3600).cast("bigint")
    return e.select(
        F.col("event_id").alias("booking_id"), F.col("user_id").alias("member_id"),
        F.timestamp_add("SECOND", -ahead, F.col("ts")).alias("cdate"),
        F.col("user_id").alias("restaurant_id"), F.col("ts").alias("datetime"),
        (1 + k % 10).alias("people"), F.col("event_type").alias("purpose"),
        F.when(k % 3 == 0, "F").when(k % 3 == 1, "M").alias("gender"),
        F.when(F.col("event_type") == "error", "canceled").otherwise("ok").alias("status"),
        (k % 2).alias("is_required_prepay_satisfied"),
        (F.col("value") > 20).cast("int").alias("return90"),
    )


# --- bookings with two dates: lineitem and orders ---------------------------------------------------

ORDER_BOOKINGS_SQL = """
SELECT l_orderkey AS booking_id, o_custkey AS member_id, o_orderdate AS cdate,
       l_suppkey AS restaurant_id, l_shipdate AS datetime, CAST(l_quantity AS INT) AS people,
       l_returnflag AS purpose, CASE WHEN l_linestatus = 'O' THEN 'F' ELSE 'M' END AS gender,
       CASE WHEN o_orderstatus = 'P' THEN 'canceled' ELSE 'ok' END AS status,
       CAST(l_tax > 0.03 AS INT) AS is_required_prepay_satisfied,
       CAST(l_discount > 0.05 AS INT) AS return90
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def order_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("booking_id"), F.col("o_custkey").alias("member_id"),
        F.col("o_orderdate").alias("cdate"), F.col("l_suppkey").alias("restaurant_id"),
        F.col("l_shipdate").alias("datetime"), F.col("l_quantity").cast("int").alias("people"),
        F.col("l_returnflag").alias("purpose"),
        F.when(F.col("l_linestatus") == "O", "F").otherwise("M").alias("gender"),
        F.when(F.col("o_orderstatus") == "P", "canceled").otherwise("ok").alias("status"),
        (F.col("l_tax") > 0.03).cast("int").alias("is_required_prepay_satisfied"),
        (F.col("l_discount") > 0.05).cast("int").alias("return90"),
    )


# --- dimensions ----------------------------------------------------------------------------------------

RESTAURANTS_SQL = """
SELECT s_suppkey AS id, CAST(s_acctbal > 5000 AS INT) AS is_hotel, r_name AS city, n_name AS cityarea,
       CAST(s_nationkey % 2 AS INT) AS good_for_family, CAST(s_nationkey % 3 = 0 AS INT) AS accept_credit_card,
       CAST(s_nationkey % 5 = 0 AS INT) AS parking, CAST(s_acctbal > 2000 AS INT) AS outdoor_seating,
       CAST(s_acctbal > 0 AS INT) AS wifi, CAST(s_nationkey % 7 = 0 AS INT) AS wheelchair_accessible,
       CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS price1, abs(s_acctbal) + 100 AS price2,
       s_nationkey * 1.5e0 AS lat, 100 + s_nationkey * 0.5e0 AS lng
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
MEMBERS_SQL = """
SELECT c_custkey AS id, CAST(c_acctbal > 8000 AS INT) AS is_vip,
       CASE WHEN c_nationkey % 3 = 0 THEN 'F' WHEN c_nationkey % 3 = 1 THEN 'M' END AS gender,
       make_date(1940 + c_custkey % 70, 1 + c_custkey % 12, 1 + c_custkey % 28) AS birthdate,
       c_mktsegment AS city
FROM customer
"""


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    nation_key, balance = F.col("s_nationkey"), F.col("s_acctbal")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("id"), flag(balance > 5000).alias("is_hotel"),
            F.col("r_name").alias("city"), F.col("n_name").alias("cityarea"),
            flag(nation_key % 2).alias("good_for_family"), flag(nation_key % 3 == 0).alias("accept_credit_card"),
            flag(nation_key % 5 == 0).alias("parking"), flag(balance > 2000).alias("outdoor_seating"),
            flag(balance > 0).alias("wifi"), flag(nation_key % 7 == 0).alias("wheelchair_accessible"),
            F.when(balance >= 0, balance).alias("price1"), (F.abs(balance) + 100).alias("price2"),
            (nation_key * 1.5).alias("lat"), (100 + nation_key * 0.5).alias("lng"),
        )
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation_key = F.col("c_custkey"), F.col("c_nationkey")
    part = lambda n: (key % n).cast("int")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), (F.col("c_acctbal") > 8000).cast("int").alias("is_vip"),
        F.when(nation_key % 3 == 0, "F").when(nation_key % 3 == 1, "M").alias("gender"),
        F.make_date(1940 + part(70), 1 + part(12), 1 + part(28)).alias("birthdate"),
        F.col("c_mktsegment").alias("city"),
    )


# --- the three tables as they arrive: declared columns that the roles above leave out, and broken values ----

RAW_BOOKINGS_SQL = f"""
SELECT * REPLACE (
    CASE purpose WHEN 'view' THEN '家人用餐' WHEN 'click' THEN '朋友聚餐' WHEN 'signup' THEN '生日慶祝' WHEN 'purchase' THEN purpose END AS purpose,
    CASE WHEN booking_id % 50 <> 0 THEN status END AS status,
    CASE WHEN booking_id % 40 = 0 THEN 0 ELSE people END AS people,
    CASE WHEN booking_id % 30 <> 0 THEN member_id END AS member_id)
FROM ({EVENT_BOOKINGS_SQL})
"""
RAW_MEMBERS_SQL = """
SELECT c_custkey AS id, CAST(c_nationkey % 4 AS INT) AS is_vip, CASE WHEN c_nationkey % 5 = 0 THEN 'X' WHEN c_nationkey % 2 = 0 THEN 'F' END AS gender,
       CAST(c_acctbal > 0 AS INT) AS has_google, CASE WHEN c_acctbal > 500 THEN 1 END AS has_yahoo, CAST(c_nationkey % 2 AS INT) AS has_weibo,
       CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS cdate
FROM customer WHERE c_custkey % 10 <> 3
"""
RAW_RESTAURANTS_SQL = f"""
SELECT r.* REPLACE (CASE WHEN s_nationkey = 4 THEN 95 ELSE lat END AS lat), CASE WHEN s_nationkey % 8 <> 0 THEN s_name END AS name, s_name AS cdate
FROM ({RESTAURANTS_SQL}) r JOIN supplier ON id = s_suppkey
"""


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Bookings, members and restaurants with every declared column; values break rules of each kind."""
    bookings, key = event_bookings(spark, sf_dir), F.col("booking_id")
    purpose = F.create_map(*[F.lit(v) for v in ("view", "家人用餐", "click", "朋友聚餐", "signup", "生日慶祝", "purchase", "purchase")])
    bookings = bookings.withColumns({
        "purpose": purpose[F.col("purpose")], "status": F.when(key % 50 != 0, F.col("status")),
        "people": F.when(key % 40 == 0, 0).otherwise(F.col("people")), "member_id": F.when(key % 30 != 0, F.col("member_id"))})
    nation_key, balance = F.col("c_nationkey"), F.col("c_acctbal")
    members = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 3").select(
        F.col("c_custkey").alias("id"), (nation_key % 4).alias("is_vip"),
        F.when(nation_key % 5 == 0, "X").when(nation_key % 2 == 0, "F").alias("gender"), (balance > 0).cast("int").alias("has_google"),
        F.when(balance > 500, 1).alias("has_yahoo"), (nation_key % 2).alias("has_weibo"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("cdate"))
    names = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 8 != 0, F.col("s_name")).alias("name"), F.col("s_name").alias("cdate"), "s_nationkey")
    places = restaurants(spark, sf_dir).join(names, "id").withColumn("lat", F.when(F.col("s_nationkey") == 4, 95.0).otherwise(F.col("lat")))
    return {"bookings": bookings, "members": members, "restaurants": places.drop("s_nationkey")}


STAR_COLUMNS_SQL = """
SELECT b.*, r.is_hotel, r.city, r.cityarea, r.good_for_family, r.accept_credit_card, r.parking,
       r.outdoor_seating, r.wifi, r.wheelchair_accessible, r.price1, r.price2, r.lat, r.lng,
       m.is_vip, m.gender AS member_gender, m.birthdate, m.city AS member_city
FROM bookings b LEFT JOIN restaurants r ON b.restaurant_id = r.id LEFT JOIN members m ON b.member_id = m.id
"""


def star_sql(bookings: str) -> str:
    return (f"bookings AS ({bookings}), restaurants AS ({RESTAURANTS_SQL}), members AS ({MEMBERS_SQL}), "
            f"star AS ({STAR_COLUMNS_SQL})")


def event_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_join(event_bookings(spark, sf_dir), restaurants(spark, sf_dir), members(spark, sf_dir))


def order_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_join(order_bookings(spark, sf_dir), restaurants(spark, sf_dir), members(spark, sf_dir))


# --- SQL of shared expressions ------------------------------------------------------------------------------

def slot_sql(ts: str) -> str:
    return f"CAST(hour({ts}) * 2 + CASE WHEN minute({ts}) >= 30 THEN 1 ELSE 0 END AS INT)"


def band_sql(hour: str) -> str:
    cases = " ".join(f"WHEN {hour} BETWEEN {b.first} AND {b.last} THEN '{b.name}'" for b in MEAL_BANDS)
    return f"CASE {cases} ELSE '_unmatched' END"


def is_test_sql(key: str, size: float = 0.2) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0) < {size}"


def stamp_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


# --- predictions of two simple models, for the metrics ---------------------------------------------------------

SLOTTED_SQL = f"""
SELECT event_id, user_id, event_type, ts, value, CAST(hour(ts) AS INT) AS h, {slot_sql('ts')} AS slot,
       {band_sql('hour(ts)')} AS subset, {is_test_sql('event_id')} AS is_test
FROM events
"""
PREDICTIONS_SQL = f"""
ev AS ({SLOTTED_SQL}),
hc AS (SELECT user_id, h, count(*) AS c FROM ev WHERE NOT is_test GROUP BY user_id, h),
pop AS (SELECT user_id, h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, h) AS rn FROM hc)
        WHERE rn = 1),
ov AS (SELECT h FROM (SELECT h, sum(c) AS c FROM hc GROUP BY h) ORDER BY c DESC, h LIMIT 1),
sc AS (SELECT subset, slot, count(*) AS c FROM ev WHERE NOT is_test GROUP BY subset, slot),
base AS (SELECT subset, slot AS baseline FROM
         (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY c DESC, slot) AS rn FROM sc) WHERE rn = 1),
pred AS (SELECT e.event_id, e.subset, e.slot AS label,
                CAST(coalesce(p.h, (SELECT h FROM ov)) * 2 AS INT) AS prediction, b.baseline
         FROM ev e LEFT JOIN pop p ON e.user_id = p.user_id LEFT JOIN base b ON e.subset = b.subset
         WHERE e.is_test AND e.subset <> '_unmatched')
"""


def slotted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "ts", "value",
        F.hour("ts").alias("reservation_hour"), temporal.half_hour_slot(F.col("ts")).alias("slot"),
        band_of(F.hour("ts")).alias("subset"), is_test_row(F.col("event_id")).alias("is_test"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows inside the bands: actual slot, popular hour as the model, most frequent slot of
    the band as the baseline. Both are fitted on the training rows."""
    rows = slotted_events(spark, sf_dir)
    train = rows.filter("not is_test")
    counts = freeze(hour_counts(train, "user_id", "ts"), "hour-counts")
    baseline = fit_most_frequent(train, "slot")
    test = rows.filter("is_test and subset <> '_unmatched'")
    modelled = apply_popularity(test, popularity_by_restaurant(counts),
                                overall_popular_hour(counts).first()["popular_hour"], "user_id")
    return apply_most_frequent(modelled, baseline).select(
        "event_id", "subset", F.col("slot").alias("label"),
        (F.col("popular_hour") * 2).alias("prediction"), "baseline")
