"""Train/test splits and folds that do not depend on how rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.functions.values import hash_fraction
from slotlake.functions.temporal import epoch_micros
from slotlake.operators.ranking import order_statistics, rank_in_group


def is_test_row(key: Column, test_size: float = 0.2) -> Column:
    """True for the test share of the keys, by a hash of the key alone."""
    return hash_fraction(key) < test_size


def split_random(df: DataFrame, key: str, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    test = is_test_row(F.col(key), test_size)
    return df.filter(~test), df.filter(test)


def temporal_cut(df: DataFrame, datetime: str, key: str, test_size: float = 0.2) -> Column | None:
    """Condition that is true for the last ``ceil(test_size * n)`` rows by time; rows without a
    time come last. ``key`` is numeric and orders rows of the same time. The cut is one time and, among the
    rows of that very time, one key, both found without sorting the table.
    """
    given = epoch_micros(F.col(datetime))
    n, latest = df.agg(F.count("*"), F.max(given)).first()
    time = F.coalesce(given, F.lit((latest or 0) + 1))
    n_test = math.ceil(test_size * n)
    if n_test == 0:
        return None
    first = n - n_test
    cut = order_statistics(df, {"t": time}, {"t": [(first, first)]})["t"][0][0]
    earlier = df.filter(time < F.lit(cut)).count()
    ties = df.filter(time == F.lit(cut))
    place = first - earlier
    if place == 0:
        return time >= F.lit(cut)
    key_cut = order_statistics(ties, {"k": F.col(key)}, {"k": [(place, place)]})["k"][0][0]
    return (time > F.lit(cut)) | ((time == F.lit(cut)) & (F.col(key) >= F.lit(key_cut)))


def split_temporal(df: DataFrame, datetime: str, key: str,
                   test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The last share of the rows by time is the test set; rows without a time count as the latest."""
    condition = temporal_cut(df, datetime, key, test_size)
    if condition is None:
        return df, df.limit(0)
    return df.filter(~condition), df.filter(condition)


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """Add ``fold``: 0 to ``folds - 1``, balanced within each label to one row."""
    ranked = rank_in_group(df, [label], key, "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")
