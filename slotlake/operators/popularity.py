"""Popular hour, dinner share and restaurant density.

All three come from one small table, the number of bookings per restaurant, area and hour. It
is pre-aggregated in one pass over the bookings, whatever share of them one restaurant holds,
and written out, so that applying the statistics does not read the bookings a third time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.session import freeze


def _mode_of_hours(hour: Column, n: Column) -> Column:
    """Most frequent hour, the smallest on a tie, as the maximum of one number per hour."""
    best = F.max(F.when(hour.isNotNull(), n * 24 + (23 - hour)))
    return (23 - F.pmod(best, F.lit(24))).cast("int")


def hour_counts(df: DataFrame, restaurant: str, datetime: str, area: str | None = None) -> DataFrame:
    columns = [F.col(restaurant).alias("restaurant"), F.hour(datetime).alias("hour")]
    if area is not None:
        columns.append(F.col(area).alias("area"))
    picked = df.select(*columns)
    return picked.groupBy(*picked.columns).agg(F.count("*").alias("n"))


def popularity_by_restaurant(counts: DataFrame, dinner: tuple[int, int] = K.DINNER_HOURS) -> DataFrame:
    """``restaurant, popular_hour, dinner_ratio``; a booking without time counts as no dinner."""
    at_dinner = F.col("hour").between(*dinner)
    per_hour = counts.filter("restaurant is not null").groupBy("restaurant", "hour").agg(
        F.sum("n").alias("n"))
    return per_hour.groupBy("restaurant").agg(
        _mode_of_hours(F.col("hour"), F.col("n")).alias("popular_hour"),
        (F.coalesce(F.sum(F.when(at_dinner, F.col("n"))), F.lit(0)) / F.sum("n")).alias("dinner_ratio"),
    )


def overall_popular_hour(counts: DataFrame) -> DataFrame:
    """One row with the most frequent hour of all bookings."""
    per_hour = counts.groupBy("hour").agg(F.sum("n").alias("n"))
    return per_hour.agg(F.coalesce(_mode_of_hours(F.col("hour"), F.col("n")),
                                   F.lit(K.DEFAULT_POPULAR_HOUR)).alias("popular_hour"))


def density_by_area(counts: DataFrame) -> DataFrame:
    """``area, restaurant_density``: how many restaurants an area has; "Unknown" is an area."""
    pairs = counts.filter("area is not null and restaurant is not null").select("area", "restaurant").distinct()
    return pairs.groupBy("area").agg(F.count("*").cast("int").alias("restaurant_density"))


@dataclass(frozen=True)
class VenueStatistics:
    """Fitted statistics; fit them on training rows and apply them to any batch."""

    popularity: DataFrame
    overall_hour: int
    density: DataFrame

    def save(self, path: str) -> None:
        self.popularity.write.parquet(f"{path}/popularity")
        self.density.write.parquet(f"{path}/density")
        spark = self.popularity.sparkSession
        spark.createDataFrame([(self.overall_hour,)], "popular_hour INT").write.parquet(f"{path}/overall")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "VenueStatistics":
        return VenueStatistics(
            spark.read.parquet(f"{path}/popularity"),
            spark.read.parquet(f"{path}/overall").first()["popular_hour"],
            spark.read.parquet(f"{path}/density"),
        )


def fit_venue_statistics(df: DataFrame, restaurant: str = "restaurant_id", datetime: str = "datetime",
                         area: str = "cityarea", dinner: tuple[int, int] = K.DINNER_HOURS,
                         areas: DataFrame | None = None) -> VenueStatistics:
    """Fit on joined bookings, or on bare bookings with ``areas``, a table ``id, area`` with
    one row per restaurant. The latter reads two columns of the bookings and joins counts."""
    if areas is None:
        counts = hour_counts(df, restaurant, datetime, area)
    else:
        known = areas.select(F.col("id").alias("_id"), F.col(area).alias("area"))
        bare = hour_counts(df, restaurant, datetime)
        counts = bare.join(known, bare["restaurant"] == known["_id"], "left").drop("_id")
    counts = freeze(counts, "hour-counts")
    return VenueStatistics(
        freeze(popularity_by_restaurant(counts, dinner), "popularity"),
        overall_popular_hour(counts).first()["popular_hour"],
        freeze(density_by_area(counts), "density"),
    )


def apply_popularity(df: DataFrame, popularity: DataFrame, overall_hour: int,
                     restaurant: str = "restaurant_id") -> DataFrame:
    """Attach both numbers; a restaurant without hours gets the overall hour and ratio 0."""
    found = popularity.select(
        F.col("restaurant").alias("_restaurant"), F.col("popular_hour").alias("_hour"),
        F.col("dinner_ratio").alias("_ratio"))
    return (
        df.join(found, F.col(restaurant) == F.col("_restaurant"), "left")
        .withColumns({
            "popular_hour": F.coalesce(F.col("_hour"), F.lit(overall_hour)),
            "dinner_ratio": F.coalesce(F.col("_ratio"), F.lit(0.0)),
        })
        .drop("_restaurant", "_hour", "_ratio")
    )


def apply_density(df: DataFrame, density: DataFrame, area: str = "cityarea") -> DataFrame:
    found = density.select(F.col("area").alias("_area"), F.col("restaurant_density").alias("_density"))
    return (
        df.join(found, F.col(area) == F.col("_area"), "left")
        .withColumn("restaurant_density", F.coalesce(F.col("_density"), F.lit(0)))
        .drop("_area", "_density")
    )


def apply_venue_statistics(df: DataFrame, fitted: VenueStatistics, restaurant: str = "restaurant_id",
                           area: str = "cityarea") -> DataFrame:
    return apply_density(
        apply_popularity(df, fitted.popularity, fitted.overall_hour, restaurant), fitted.density, area)


VENUE_COLUMNS = ("popular_hour", "dinner_ratio", "restaurant_density")


def venues_with_statistics(restaurants: DataFrame, fitted: VenueStatistics, area: str = "cityarea") -> DataFrame:
    """Restaurants with their statistics, and the venues that only bookings name with theirs.

    Joined here, the statistics reach the bookings with the restaurant's own join; the bookings
    are never shuffled by area, where one value holds most rows.
    """
    known = fitted.popularity.select(F.col("restaurant").alias("_restaurant"), "popular_hour", "dinner_ratio")
    venues = restaurants.join(known, F.col("id") == F.col("_restaurant"), "full")
    venues = venues.withColumn("id", F.coalesce("id", "_restaurant")).drop("_restaurant")
    found = fitted.density.select(F.col("area").alias("_area"), "restaurant_density")
    return venues.join(found, F.col(area) == F.col("_area"), "left").drop("_area")


def fill_statistics(df: DataFrame, fitted: VenueStatistics) -> DataFrame:
    """What a booking without venue statistics gets: the overall hour, no dinners, no density."""
    return df.withColumns({
        "popular_hour": F.coalesce("popular_hour", F.lit(fitted.overall_hour)),
        "dinner_ratio": F.coalesce("dinner_ratio", F.lit(0.0)),
        "restaurant_density": F.coalesce("restaurant_density", F.lit(0)),
    })
