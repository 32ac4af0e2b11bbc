"""Encoders: fitted on training rows, applied to any rows, kept as small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.functions.values import category_text
from slotlake.operators.ranking import sorted_codes
from slotlake.session import freeze


#: Levels that may become columns of a frame.
WIDE_LEVELS = 4096


# --- labels -----------------------------------------------------------------------------------

def fit_levels(train: DataFrame, columns: Sequence[str] = K.CATEGORICAL_COLUMNS) -> DataFrame:
    """``column, label, code`` with codes by sorted label; missing counts as "Unknown"."""
    present = [c for c in columns if c in train.columns]
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), category_text(F.col(c)).alias("label")) for c in present])
    return sorted_codes(freeze(train.select(F.inline(entries)).distinct(), "labels"))


def apply_levels(df: DataFrame, levels: DataFrame, columns: Sequence[str] = K.CATEGORICAL_COLUMNS,
                 unseen: int | None = None, suffix: str = "_code") -> DataFrame:
    """Add the code of each column that is present; a label never seen in training is ``unseen``."""
    for c in columns:
        if c not in df.columns:
            continue
        mine = levels.filter(F.col("column") == c).select(
            F.col("label").alias("_label"), F.col("code").alias(f"{c}{suffix}"))
        df = df.join(mine, category_text(F.col(c)) == F.col("_label"), "left").drop("_label")
        if unseen is not None:
            df = df.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(unseen)))
    return df


def encode_native(train: DataFrame, test: DataFrame,
                  columns: Sequence[str] = K.CATEGORICAL_COLUMNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Category codes; unseen labels are null."""
    levels = fit_levels(train, columns)
    return apply_levels(train, levels, columns), apply_levels(test, levels, columns), levels


def encode_ordinal(train: DataFrame, test: DataFrame,
                   columns: Sequence[str] = K.CATEGORICAL_COLUMNS + K.GEO_CATEGORICAL_COLUMNS,
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Category codes; unseen labels are -1."""
    levels = fit_levels(train, columns)
    return apply_levels(train, levels, columns, -1), apply_levels(test, levels, columns, -1), levels


# --- target ------------------------------------------------------------------------------------

def fit_target(train: DataFrame, target: str) -> DataFrame:
    """``label, code`` of a numeric target, codes 0 to n - 1 by value."""
    labels = train.filter(F.col(target).isNotNull()).select(
        F.lit(target).alias("column"), F.col(target).alias("label")).distinct()
    return sorted_codes(freeze(labels, "targets")).select("label", "code")


def encode_target(df: DataFrame, codes: DataFrame, target: str, output: str = "target_code",
                  strict: bool = False) -> DataFrame:
    """Code of the target; a label outside the training set is null, or an error if ``strict``."""
    mine = codes.select(F.col("label").alias("_label"), F.col("code").alias(output))
    out = df.join(mine, F.col(target) == F.col("_label"), "left").drop("_label")
    if strict:
        message = F.concat(F.lit(f"{target} unseen in training: "), F.col(target).cast("string"))
        out = out.withColumn(output, F.coalesce(F.col(output), F.raise_error(message).cast("int")))
    return out


def decode_target(df: DataFrame, codes: DataFrame, column: str, output: str = "prediction_label") -> DataFrame:
    mine = codes.select(F.col("code").alias("_code"), F.col("label").alias(output))
    return df.join(mine, F.col(column) == F.col("_code"), "left").drop("_code")


# --- one-hot and scaling -----------------------------------------------------------------------------

@dataclass(frozen=True)
class OneHot:
    """Levels per column, in the order of the output columns."""

    levels: dict[str, list[str]]
    baselines: dict[str, str]

    def outputs(self) -> list[tuple[str, str, str]]:
        """``(column, level, output name)``; dots and backticks cannot stand in a plain name."""
        found, taken = [], set()
        for c, levels in self.levels.items():
            for v in levels:
                if self.baselines.get(c) == v:
                    continue
                name = f"{c}_{v}".replace(".", "_").replace("`", "_")
                while name in taken:
                    name += "_"
                taken.add(name)
                found.append((c, v, name))
        return found

    def names(self) -> list[str]:
        return [name for _, _, name in self.outputs()]


def level_text(df: DataFrame, column: str) -> Column:
    """Text of a level; a whole number has no decimals even in a DOUBLE column."""
    c = F.col(column)
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _level_entries(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("column"), level_text(df, c).alias("label")) for c in columns])


def fit_one_hot(train: DataFrame, columns: Sequence[str],
                baselines: Mapping[str, str] = K.ONE_HOT_BASELINES, limit: int = WIDE_LEVELS) -> OneHot:
    """Levels of the training rows. They become column names, so the driver has to know them; beyond ``limit`` levels
    in all it refuses, and ``one_hot_levels`` with ``one_hot_long`` is the way."""
    present = [c for c in columns if c in train.columns]
    rows = train.select(F.inline(_level_entries(train, present))).filter("label is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} levels in {present}: use one_hot_levels and one_hot_long")
    numeric = {c for c in present if dict(train.dtypes)[c] != "string"}
    levels: dict[str, list[str]] = {}
    for c in present:
        mine = [r["label"] for r in rows if r["column"] == c]
        levels[c] = sorted(mine, key=(lambda v: float(v)) if c in numeric else (lambda v: v))
    return OneHot(levels, dict(baselines))


def apply_one_hot(df: DataFrame, fitted: OneHot) -> DataFrame:
    """0/1 columns ``column_level``; missing and unseen values give zeros everywhere.

    A frame without one of the columns gets zeros, so test rows always align with training rows.
    """
    dummies = {}
    for c, v, name in fitted.outputs():
        hit = (level_text(df, c) == v) if c in df.columns else F.lit(False)
        dummies[name] = F.coalesce(hit.cast("int"), F.lit(0))
    return df.withColumns(dummies).drop(*fitted.levels)


def one_hot_levels(train: DataFrame, columns: Sequence[str], baselines: Mapping[str, str] = K.ONE_HOT_BASELINES) -> DataFrame:
    """``column, label, position``: a written table of the training levels without baselines, numbered from 0 by column
    and label as text. However many there are, none reaches the driver."""
    present = [c for c in columns if c in train.columns]
    base = F.create_map(*[F.lit(v) for kv in baselines.items() for v in kv])[F.col("column")] if baselines else F.lit(None)
    found = train.select(F.inline(_level_entries(train, present))).filter(F.col("label").isNotNull() & ~F.col("label").eqNullSafe(base))
    coded = freeze(sorted_codes(found.distinct()), "one-hot-levels")
    before = Window.orderBy("column").rowsBetween(Window.unboundedPreceding, -1)
    starts = coded.groupBy("column").agg(F.count("*").alias("_n")).select(  # one row a column
        "column", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return freeze(coded.join(starts, "column").select("column", "label", (F.col("_start") + F.col("code")).alias("position")), "one-hot-positions")


def one_hot_long(df: DataFrame, key: str, levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``key, column, position`` of every one in the one-hot matrix. Missing, unseen and baseline values have no row, as a
    wide row has zeros for them; a column that ``df`` lacks has none."""
    present = [c for c in columns if c in df.columns]
    rows = df.select(F.col(key).alias("_key"), F.inline(_level_entries(df, present)))
    return rows.join(levels, ["column", "label"]).select(F.col("_key").alias(key), "column", "position")


def fit_scaling(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column is divided by 1."""
    row = train.agg(*[F.avg(c).alias(f"m:{c}") for c in columns],
                    *[F.stddev_pop(c).alias(f"s:{c}") for c in columns]).first()
    return {c: (row[f"m:{c}"], row[f"s:{c}"] or 1.0) for c in columns if row[f"m:{c}"] is not None}


def apply_scaling(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(c) - F.lit(mean)) / F.lit(deviation)
        for c, (mean, deviation) in fitted.items() if c in df.columns
    })
