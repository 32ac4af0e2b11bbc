"""Routing of rows to meal bands, and the most-frequent-slot model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.config import MEAL_BANDS, ROUTING_COLUMN, Band, check_routable
from slotlake.functions.values import to_number


def band_of(hour: Column, bands: Sequence[Band] = MEAL_BANDS) -> Column:
    """Name of the band an hour falls in; missing, unreadable and other hours are unmatched."""
    check_routable(bands)
    number = to_number(hour)
    chain = None
    for b in bands:
        inside = number.between(b.first, b.last)
        chain = F.when(inside, b.name) if chain is None else chain.when(inside, b.name)
    return chain.otherwise(F.lit(K.UNMATCHED))


def route(df: DataFrame, bands: Sequence[Band] = MEAL_BANDS, column: str = ROUTING_COLUMN) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"rows need {column!r} to be routed to a meal band")
    return df.withColumn("subset", band_of(F.col(column), bands))


def band_sizes(df: DataFrame, bands: Sequence[Band], column: str = ROUTING_COLUMN) -> DataFrame:
    """Rows per band; bands may overlap here, and rows outside every band are counted too."""
    hour = F.col(column)
    inside = [hour.between(b.first, b.last) for b in bands]
    none = ~F.coalesce(F.greatest(*inside) if len(inside) > 1 else inside[0], F.lit(False))
    one = df.agg(*[F.count_if(c).alias(b.name) for b, c in zip(bands, inside)],
                 F.count_if(none).alias(K.UNMATCHED))
    names = [b.name for b in bands] + [K.UNMATCHED]
    entries = [F.struct(F.lit(n).alias("subset"), F.col(f"`{n}`").alias("n")) for n in names]
    return one.select(F.inline(F.array(*entries)))


def fit_most_frequent(train: DataFrame, label: str, group: str = "subset") -> DataFrame:
    """Most frequent label per group, the smallest on a tie: ``group, baseline``."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("_n"))
    best = F.max_by(F.col(label), F.struct(F.col("_n"), -F.col(label)))
    return counts.groupBy(group).agg(best.alias("baseline"))


def apply_most_frequent(df: DataFrame, fitted: DataFrame, group: str = "subset") -> DataFrame:
    return df.join(fitted, group, "left")
