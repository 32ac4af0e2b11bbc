"""Keys and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same_key(columns: Sequence[str]):
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return condition


def duplicates(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once, sorted by key; missing values are equal.

    Repeated keys are found by a pre-aggregated count and matched by a semi join, whose
    skewed partitions can be split; a window would hold a frequent key in one task.
    """
    repeated = df.groupBy(*subset).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # sorting by the other columns too lets the rows of one frequent key spread over tasks
    others = [c for c in df.columns if c not in subset]
    return (
        df.alias("l").join(repeated.alias("r"), _same_key(subset), "left_semi")
        .orderBy(*[F.col(c).asc_nulls_last() for c in subset], *others)
    )


def keep_last(df: DataFrame, subset: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order_by``, sorted by key.

    The maximum is pre-aggregated before the shuffle, so a frequent key costs one row per task.
    """
    others = [c for c in df.columns if c not in subset]
    last = F.max_by(F.struct(*others), F.struct(*order_by)).alias("_last")
    return (
        df.groupBy(*subset).agg(last)
        .select(*[c if c in subset else F.col(f"_last.{c}").alias(c) for c in df.columns])
        .orderBy(*[F.col(c).asc_nulls_last() for c in subset])
    )


def duplicate_key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row with ``has_duplicates``."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.max("_n") > 1, F.lit(False)).alias("has_duplicates"))


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    if duplicate_key_check(df, keys).first()["has_duplicates"]:
        raise ValueError(f"{name}: key {list(keys)} is not unique")
    return df
