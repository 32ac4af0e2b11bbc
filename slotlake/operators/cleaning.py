"""Cleaning, filtering and projection of booking tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotlake import constants as K
from slotlake.functions import temporal, values
from slotlake.operators.ranking import quantiles


# --- projections -------------------------------------------------------------------------

def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def feature_projection(df: DataFrame, target: str, leakage: Sequence[str]) -> DataFrame:
    """Columns a model may see, with the target last."""
    banned = {*K.NON_FEATURE_COLUMNS, *leakage, target}
    return df.select(*[c for c in df.columns if c not in banned], target)


def model_inputs(df: DataFrame, target: str, leakage: Sequence[str],
                 categorical: Sequence[str] = K.CATEGORICAL_COLUMNS) -> DataFrame:
    """Keep numbers and known categories; drop dates, other text, leaks and the target."""
    banned = {*K.NON_FEATURE_COLUMNS, *leakage, target}
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    keep = [
        f.name for f in df.schema
        if f.name not in banned
        and not isinstance(f.dataType, dates)
        and (not isinstance(f.dataType, T.StringType) or f.name in categorical)
    ]
    return df.select(*keep)


def align_features(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its order; an absent one is null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in schema
    ])


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows that look random but are the same on every run."""
    order = F.md5(F.col(key).cast("string"))
    return df.orderBy(order, key).limit(n)


# --- single-column cleaning ------------------------------------------------------------------

def fill_constant(df: DataFrame, column: str, value=K.UNKNOWN) -> DataFrame:
    return df.fillna({column: value})


def parse_datetime(df: DataFrame, column: str,
                   formats: Sequence[str] = K.DATETIME_FORMATS) -> DataFrame:
    """Text to timestamp, null if no format fits; a column that is no text is left alone."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, values.parse_timestamp(F.col(column), formats))


def trim_whitespace(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, values.strip(F.col(column)))


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumn(column, values.replace_values(F.col(column), mapping))


def map_values_from(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Replacement by a two-column table ``(old, new)``, for mappings too long for a CASE."""
    found = table.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = df.join(found, df[column] == F.col("_old"), "left")
    mapped = F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col(column))
    return out.withColumn(column, mapped).drop("_old", "_new")


def remove_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop the rows that hold ``value``; rows without a value stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


# --- row filters and anomaly reports -------------------------------------------------------------

def _sorted(df: DataFrame, first: str) -> DataFrame:
    """Sort by one column, then by the others, so that equal values still spread over tasks."""
    return df.orderBy(F.col(first).asc_nulls_last(), *[c for c in df.columns if c != first])


def filter_invalid_dates(df: DataFrame, created: str, reserved: str) -> DataFrame:
    """Rows created no later than the time they reserve; a missing time drops the row."""
    return df.filter(F.col(created) <= F.col(reserved))


def invalid_age(df: DataFrame, birth: str, as_of: Column, max_age: int = 120) -> DataFrame:
    age = temporal.age_on(F.col(birth), as_of)
    return _sorted(df.filter((age < 0) | (age > max_age)), birth)


def future_dates(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    return _sorted(df.filter(F.col(column) > as_of), column)


def invalid_price(df: DataFrame, column: str, minimum: float = 0) -> DataFrame:
    return _sorted(df.filter(F.col(column) < minimum), column)


def band_filter(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    return df.filter(F.col(column).between(first, last))


# --- filling numbers ---------------------------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def fit_fill_values(df: DataFrame, strategy: str = "median",
                    columns: Sequence[str] | None = None) -> dict[str, float]:
    """Fill value per numeric column: a few numbers that scoring keeps for later batches."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if strategy == "none" or not columns:
        return {}
    if strategy == "median":
        found = quantiles(df, columns, [0.5])
        return {c: v[0] for c, v in found.items() if v[0] is not None}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns if row[c] is not None}
    raise ValueError(f"no fill strategy {strategy!r}")


def apply_fill_values(df: DataFrame, fitted: Mapping[str, float]) -> DataFrame:
    """Fill nulls; a filled column becomes DOUBLE, so that a mean is not cut to an integer."""
    present = [c for c in fitted if c in df.columns]
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(fitted[c]))) for c in present
    })


def fill_numeric(df: DataFrame, strategy: str = "median", fit_on: DataFrame | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Fill by ``mean`` or ``median``, drop incomplete rows (``drop``) or leave as is (``none``).

    The published models were trained with ``mean``. Values are fitted on the whole frame
    unless ``fit_on`` names the training rows.
    """
    if strategy == "drop":
        return df.na.drop("any", subset=list(columns) if columns is not None else None)
    source = df if fit_on is None else fit_on
    return apply_fill_values(df, fit_fill_values(source, strategy, columns))


# --- the three raw tables ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """How one raw column becomes a clean one: absent values, white space, times, spellings, junk."""

    absent: str | None = None
    strip: bool = False
    time: bool = False
    spelling: Mapping[str, str] = field(default_factory=dict)
    #: A row whose value, filled but not yet respelled, is this one goes.
    junk: str | None = None


BOOKING_RULES = {
    "cdate": Rule(time=True), "datetime": Rule(time=True),
    "purpose": Rule(K.UNKNOWN, strip=True, spelling=K.PURPOSE_VALUES),
}
RESTAURANT_RULES = {
    "cdate": Rule(time=True), "city": Rule(spelling=K.CITY_VALUES), "cityarea": Rule(K.UNKNOWN, spelling=K.CITYAREA_VALUES),
}
MEMBER_RULES = {
    "birthdate": Rule(time=True), "cdate": Rule(time=True), "gender": Rule(K.UNKNOWN),
    "city": Rule(K.UNKNOWN, spelling=K.MEMBER_CITY_VALUES, junk=K.JUNK_MEMBER_CITY),
}


def apply_rules(df: DataFrame, rules: Mapping[str, Rule], formats: Sequence[str] = K.DATETIME_FORMATS) -> DataFrame:
    """One filter and one projection; every text is read once, and a column that is no text keeps its values."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    for name, rule in rules.items():
        if rule.junk is not None:
            df = df.filter(~F.col(name).eqNullSafe(F.lit(rule.junk)))

    def clean(name: str) -> Column:
        column, rule = F.col(name), rules.get(name, Rule())
        if name not in text:
            return column
        if rule.absent is not None:
            column = F.coalesce(column, F.lit(rule.absent))
        if rule.strip:
            column = values.strip(column)
        if rule.time:
            column = values.parse_timestamp(column, formats)
        return values.replace_values(column, rule.spelling)

    return df.select(*[clean(c).alias(c) for c in df.columns])


def clean_bookings(df: DataFrame, formats: Sequence[str] = K.DATETIME_FORMATS) -> DataFrame:
    return remove_value(apply_rules(df, BOOKING_RULES, formats), "purpose", K.JUNK_PURPOSE)


def clean_restaurants(df: DataFrame, formats: Sequence[str] = K.DATETIME_FORMATS) -> DataFrame:
    return apply_rules(df, RESTAURANT_RULES, formats)


def clean_members(df: DataFrame, formats: Sequence[str] = K.DATETIME_FORMATS) -> DataFrame:
    """The junk city is dropped before city names are mapped."""
    return apply_rules(df, MEMBER_RULES, formats)
