"""Queries that profile a table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from slotlake.catalog import roles
from slotlake.catalog.registry import comparable, query, r6, table
from slotlake.catalog.roles import slot_sql, star_sql
from slotlake.functions import temporal
from slotlake.operators import associations, popularity, profile
from slotlake.session import freeze

STAR_CATEGORIES = ("purpose", "gender", "status", "city", "cityarea", "member_gender", "member_city")
STAR_MEASURES = ("people", "price1", "price2", "lat", "lng")
_EVENT_STAR = f"WITH {star_sql(roles.EVENT_BOOKINGS_SQL)}"
_LABELLED_SQL = "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, sf, "labels"), "doc_id", "left")


# --- venue statistics ------------------------------------------------------------------------------


@query("popular_hour", """
WITH hc AS (SELECT user_id, CAST(hour(ts) AS INT) AS h, count(*) AS c FROM events GROUP BY 1, 2)
SELECT user_id, h AS popular_hour FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, h) AS rn FROM hc) WHERE rn = 1""")
def popular_hour(spark, sf):
    counts = popularity.hour_counts(table(spark, sf, "events"), "user_id", "ts")
    return popularity.popularity_by_restaurant(counts).select(F.col("restaurant").alias("user_id"), "popular_hour")


@query("dinner_ratio", """
SELECT e.event_id, round(r.ratio, 6) AS dinner_ratio FROM events e JOIN (
    SELECT user_id, avg(CASE WHEN hour(ts) BETWEEN 17 AND 21 THEN 1.0 ELSE 0.0 END) AS ratio FROM events GROUP BY 1) r
ON e.user_id = r.user_id""")
def dinner_ratio(spark, sf):
    events = table(spark, sf, "events")
    counts = freeze(popularity.hour_counts(events, "user_id", "ts"), "hour-counts")
    overall = popularity.overall_popular_hour(counts).first()["popular_hour"]
    attached = popularity.apply_popularity(
        events, popularity.popularity_by_restaurant(counts), overall, "user_id")
    return attached.select("event_id", r6("dinner_ratio").alias("dinner_ratio"))


@query("area_density", f"""
WITH {star_sql(roles.ORDER_BOOKINGS_SQL)}
SELECT cityarea, CAST(count(DISTINCT restaurant_id) AS INT) AS restaurant_density FROM star WHERE cityarea IS NOT NULL GROUP BY 1""")
def area_density(spark, sf):
    counts = popularity.hour_counts(roles.order_star(spark, sf), "restaurant_id", "datetime", "cityarea")
    return popularity.density_by_area(counts).withColumnRenamed("area", "cityarea")


# --- missing values, categories -----------------------------------------------------------------------


@query("missing_report", f"""
WITH t AS ({_LABELLED_SQL}), m AS (
SELECT 'quality' AS "column", count(*) - count(quality) AS missing, round((count(*) - count(quality)) * 100.0 / count(*), 6) AS percent FROM t
UNION ALL SELECT 'toxic', count(*) - count(toxic), round((count(*) - count(toxic)) * 100.0 / count(*), 6) FROM t
UNION ALL SELECT 'lang', count(*) - count(lang), round((count(*) - count(lang)) * 100.0 / count(*), 6) FROM t)
SELECT * FROM m WHERE missing > 0""")
def missing_report(spark, sf):
    return comparable(profile.missing_report(_labelled(spark, sf)))


@query("missing_segment_compare", f"""
SELECT CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS is_missing, count(*) AS n, round(avg(n_chars), 6) AS mean_chars,
       max(n_chars) AS max_chars, count(DISTINCT lang) AS languages FROM ({_LABELLED_SQL}) GROUP BY 1""")
def missing_segment_compare(spark, sf):
    return comparable(profile.missing_segments(_labelled(spark, sf), "quality", {
        "mean_chars": F.avg("n_chars"), "max_chars": F.max("n_chars"), "languages": F.countDistinct("lang")}))


@query("value_counts", """
SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""")
def value_counts(spark, sf):
    return comparable(profile.value_counts(table(spark, sf, "events"), "event_type", share=True))


@query("profile_categorical", f"{_EVENT_STAR} " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), 'Unknown') AS category, count(*) AS n,
       round(count(*) * 100.0 / (SELECT count(*) FROM star), 6) AS percent FROM star GROUP BY 2""" for c in STAR_CATEGORIES))
def profile_categorical(spark, sf):
    star = freeze(roles.event_star(spark, sf).select(*STAR_CATEGORIES), "categories")
    return comparable(profile.profile_categorical(star, STAR_CATEGORIES))


@query("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf):
    return profile.distinct_values(table(spark, sf, "events"), "event_type")


@query("distinct_counts", """
SELECT 'user_id' AS "column", count(DISTINCT user_id) AS n_distinct FROM events
UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events
UNION ALL SELECT 'value', count(DISTINCT value) FROM events""")
def distinct_counts(spark, sf):
    return profile.distinct_counts(table(spark, sf, "events"), ["user_id", "event_type", "value"])


@query("freq_of_freq", """
SELECT occurrences, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS occurrences FROM orders GROUP BY 1) GROUP BY 1""")
def freq_of_freq(spark, sf):
    return profile.frequency_of_frequencies(table(spark, sf, "orders"), "o_custkey")


# --- numbers -------------------------------------------------------------------------------------------


@query("date_range", """
SELECT CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last FROM lineitem""")
def date_range(spark, sf):
    found = profile.date_range(table(spark, sf, "lineitem"), "l_shipdate")
    return found.select(*[F.to_date(c).cast("string").alias(c) for c in ("first", "last")])


def _describe_sql(column: str, source: str) -> str:
    return f"""
SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
       CAST(min({column}) AS DOUBLE) AS min, round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS q50,
       round(quantile_cont({column}, 0.75), 6) AS q75, CAST(max({column}) AS DOUBLE) AS max FROM {source}"""


#: All columns of the line items that are neither keys nor text.
MEASURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", " UNION ALL ".join(
    _describe_sql(c, "lineitem") for c in MEASURES))
def describe_numeric(spark, sf):
    return comparable(profile.describe_numeric(table(spark, sf, "lineitem"), MEASURES))


#: The numbers of the star that are neither keys nor flags.
STAR_NUMBERS = ["people", "price1", "price2", "lat", "lng"]


def _profile_sql(column: str) -> str:
    return f"""
SELECT '{column}' AS "column", count({column}) AS count, count(*) - count({column}) AS missing, CAST(min({column}) AS DOUBLE) AS min,
       CAST(max({column}) AS DOUBLE) AS max, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
       round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS median,
       round(quantile_cont({column}, 0.75), 6) AS q75, round(skewness({column}), 6) AS skewness,
       round(kurtosis({column}), 6) AS kurtosis FROM star"""


@query("profile_numeric", f"WITH {star_sql(roles.EVENT_BOOKINGS_SQL)} "
       + " UNION ALL ".join(_profile_sql(c) for c in STAR_NUMBERS))
def profile_numeric(spark, sf):
    return comparable(profile.profile_numeric(roles.event_star(spark, sf), STAR_NUMBERS))


@query("outlier_iqr", f"{_EVENT_STAR} " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(any_value(lo), 6) AS fence_low, round(any_value(hi), 6) AS fence_high, count_if({c} < lo)::BIGINT AS n_low, count_if({c} > hi)::BIGINT AS n_high
FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}))"""
    for c, source in (("value", "events"), *((c, "star") for c in STAR_MEASURES))))
def outlier_iqr(spark, sf):
    return comparable(profile.outliers_iqr(table(spark, sf, "events"), ["value"]).unionByName(
        profile.outliers_iqr(roles.event_star(spark, sf), STAR_MEASURES)))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in combinations(MEASURES, 2)))
def correlation_matrix(spark, sf):
    return comparable(profile.correlation_matrix(table(spark, sf, "lineitem"), MEASURES))


@query("histogram_slots", f"SELECT CAST({slot_sql('ts')} AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram_slots(spark, sf):
    return profile.slot_histogram(table(spark, sf, "events"), "ts")


@query("histogram_seconds", """
SELECT CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 1800 AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1""")
def histogram_seconds(spark, sf):
    return profile.histogram(table(spark, sf, "events"), temporal.seconds_of_day(F.col("ts")), 1800)


@query("histogram_by_spread", " UNION ALL ".join(f"""
SELECT "column", bin, round(lo + bin * width, 6) AS low, round(CASE WHEN width > 0 THEN lo + bin * width + width ELSE hi END, 6) AS high, n FROM (
    SELECT '{c}' AS "column", CAST(CASE WHEN width > 0 THEN floor((v - lo) / width) ELSE 0 END AS BIGINT) AS bin, lo, hi, width, count(*) AS n
    FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL), (
        SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi, 2 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25))
               / pow(count({c}), 1.0::DOUBLE / 3) AS width FROM lineitem) GROUP BY ALL)""" for c in MEASURES))
def histogram_by_spread(spark, sf):
    return comparable(profile.histogram_by_spread(table(spark, sf, "lineitem"), MEASURES))


@query("histogram_by_depth", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", bin, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS n FROM (
    SELECT v, CAST(((rank() OVER (ORDER BY v) - 1) * 10) // count(*) OVER () + 1 AS BIGINT) AS bin
    FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL)) GROUP BY bin""" for c in MEASURES))
def histogram_by_depth(spark, sf):
    return comparable(profile.histogram_by_depth(table(spark, sf, "lineitem"), MEASURES))


# --- associations --------------------------------------------------------------------------------------

_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS u, CAST({b} AS VARCHAR) AS v, count(*) AS n FROM star "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL" for a, b in combinations(STAR_CATEGORIES, 2))


@query("category_associations", f"""
{_EVENT_STAR}, cells AS ({_PAIRS_SQL}),
shares AS (SELECT *, sum(n) OVER (PARTITION BY a, b, u) AS n_u, sum(n) OVER (PARTITION BY a, b, v) AS n_v FROM cells),
sums AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT u) AS r, count(DISTINCT v) AS k,
                sum(CAST(n AS DOUBLE) / n_u * (CAST(n AS DOUBLE) / n_v)) - 1 AS phi FROM shares GROUP BY a, b)
SELECT a, b, n, r AS levels_a, k AS levels_b, CASE WHEN r > 1 AND k > 1 THEN
       round(sqrt(greatest(0, phi - (r - 1) * (k - 1) / (n - 1)) / (least(r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)) - 1)), 6) END AS v
FROM sums""")
def category_associations(spark, sf):
    return comparable(associations.cramers_v(roles.event_star(spark, sf), STAR_CATEGORIES))


@query("correlation_ratios", f"{_EVENT_STAR} " + " UNION ALL ".join(f"""
SELECT '{c}' AS category, '{x}' AS number, count(*) AS n, round(sqrt(sum((m - t) ** 2) / nullif(sum((y - t) ** 2), 0)), 6) AS ratio
FROM (SELECT CAST({x} AS DOUBLE) AS y, avg(CAST({x} AS DOUBLE)) OVER (PARTITION BY {c}) AS m, avg(CAST({x} AS DOUBLE)) OVER () AS t
      FROM star WHERE {c} IS NOT NULL AND {x} IS NOT NULL)""" for c in STAR_CATEGORIES for x in STAR_MEASURES))
def correlation_ratios(spark, sf):
    return comparable(associations.correlation_ratios(roles.event_star(spark, sf), STAR_CATEGORIES, STAR_MEASURES))


_RANKED_SQL = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in MEASURES)


@query("rank_correlation", f"WITH r AS (SELECT {_RANKED_SQL} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM r" for a, b in combinations(MEASURES, 2)))
def rank_correlation(spark, sf):
    return comparable(associations.rank_correlations(table(spark, sf, "lineitem"), MEASURES))


STAR_COLUMNS = (*STAR_CATEGORIES, *STAR_MEASURES, "member_id", "restaurant_id", "cdate", "datetime", "birthdate", "is_vip", "parking", "wifi")


@query("missing_patterns", f"{_EVENT_STAR} SELECT " + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in STAR_COLUMNS)
       + " AS pattern, CAST(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in STAR_COLUMNS)
       + " AS INT) AS n_missing, count(*) AS n FROM star GROUP BY ALL")
def missing_patterns(spark, sf):
    return associations.missing_patterns(roles.event_star(spark, sf), STAR_COLUMNS)


@query("missing_correlations", f"{_EVENT_STAR} " + " UNION ALL ".join(f"""
SELECT '{a}' AS a, '{b}' AS b, count_if({a} IS NULL AND {b} IS NULL)::BIGINT AS n_both, round(
    (CAST(count(*) AS DOUBLE) * count_if({a} IS NULL AND {b} IS NULL) - CAST(count_if({a} IS NULL) AS DOUBLE) * count_if({b} IS NULL))
    / nullif(sqrt(CAST(count_if({a} IS NULL) AS DOUBLE) * count({a})) * sqrt(CAST(count_if({b} IS NULL) AS DOUBLE) * count({b})), 0), 6) AS correlation
FROM star""" for a, b in combinations(STAR_COLUMNS, 2)))
def missing_correlations(spark, sf):
    return comparable(associations.missing_correlations(roles.event_star(spark, sf), STAR_COLUMNS))


# --- segments ------------------------------------------------------------------------------------------


@query("segment_summary", f"""
SELECT gender, status, count(*) AS n, round(avg(people), 6) AS mean_people,
       round(avg((epoch_us(datetime) - epoch_us(cdate)) / 3.6e9), 6) AS mean_lead_time,
       round(avg({slot_sql('datetime')}), 6) AS mean_slot
FROM ({roles.EVENT_BOOKINGS_SQL}) GROUP BY gender, status""")
def segment_summary(spark, sf):
    lead = temporal.lead_time_hours(F.col("cdate"), F.col("datetime"))
    return comparable(profile.segment_summary(roles.event_bookings(spark, sf), ["gender", "status"], {
        "mean_people": F.avg("people"), "mean_lead_time": F.avg(lead),
        "mean_slot": F.avg(temporal.half_hour_slot(F.col("datetime")))}))


@query("rfm_features", f"""
SELECT member_id, CAST(date_diff('day', CAST(max(datetime) AS DATE), DATE '2024-02-01') AS INT) AS recency_days, count(*) AS frequency,
       round(avg(CASE WHEN status = 'canceled' THEN 1.0 ELSE 0.0 END), 6) AS cancellation_rate,
       round(stddev_samp((epoch_us(datetime) - epoch_us(cdate)) / 3.6e9), 6) AS lead_time_spread,
       round(avg(CASE WHEN hour(datetime) BETWEEN 14 AND 16 THEN 1.0 ELSE 0.0 END), 6) AS off_peak_share
FROM ({roles.EVENT_BOOKINGS_SQL}) GROUP BY member_id""")
def rfm_features(spark, sf):
    return comparable(profile.rfm_features(
        roles.event_bookings(spark, sf), "member_id", "datetime", F.lit("2024-02-01").cast("date"),
        F.col("status") == "canceled", temporal.lead_time_hours(F.col("cdate"), F.col("datetime")),
        F.hour("datetime").between(14, 16)))
