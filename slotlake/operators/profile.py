"""Profiles, distributions and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.functions import temporal
from slotlake.functions.values import category_text
from slotlake.operators.ranking import order_statistics, quantiles
from slotlake.schema import Rule
from slotlake.session import freeze


def _unpivot_row(one: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide row with columns ``field:name`` to a row per name."""
    entries = [
        F.struct(F.lit(n).alias("column"), *[F.col(f"`{f}:{n}`").alias(f) for f in fields])
        for n in names
    ]
    return one.select(F.inline(F.array(*entries)))


# --- missing values --------------------------------------------------------------------------

def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: how many and what percentage, most first."""
    columns = df.columns
    one = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing:{c}") for c in columns],
        *[(F.count_if(F.col(c).isNull()) * 100.0 / F.count("*")).alias(f"percent:{c}") for c in columns],
    )
    return (
        _unpivot_row(one, columns, ["missing", "percent"])
        .filter("missing > 0").orderBy(F.desc("missing"), "column")
    )


def missing_segments(df: DataFrame, column: str, metrics: dict[str, Column]) -> DataFrame:
    """The rows without a value in ``column`` compared with the others."""
    return df.groupBy(F.col(column).isNull().cast("int").alias("is_missing")).agg(
        F.count("*").alias("n"), *[m.alias(name) for name, m in metrics.items()])


# --- categories ---------------------------------------------------------------------------------

def value_counts(df: DataFrame, column: str, share: bool = False) -> DataFrame:
    """How often each value occurs, most frequent first, missing left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n"))
    if share:
        counts = counts.withColumn("share", F.col("n") / df.agg(F.count(column)).scalar())
    return counts.orderBy(F.desc("n"), "value")


def category_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct labels of each column, missing left out."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns])
    return (
        df.select(F.inline(entries)).filter("label is not null").distinct().orderBy("column", "label")
    )


def profile_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percentage of every category; the categories of a column sum to 100."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), category_text(F.col(c)).alias("category")) for c in columns])
    counts = df.select(F.inline(entries)).groupBy("column", "category").agg(F.count("*").alias("n"))
    # every column contributes each row once
    return counts.withColumn("percent", F.col("n") * 100.0 / df.agg(F.count("*")).scalar())


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct values per column.

    Exact counts pre-aggregate ``(column, value)`` pairs, so that no task holds a whole column;
    ``approximate`` keeps one sketch per column.
    """
    if approximate:
        one = df.agg(*[F.approx_count_distinct(c).alias(f"n_distinct:{c}") for c in columns])
        return _unpivot_row(one, columns, ["n_distinct"])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    pairs = df.select(F.inline(entries)).distinct()
    return pairs.groupBy("column").agg(F.count("value").alias("n_distinct"))


def frequency_of_frequencies(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, and so on."""
    per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("occurrences"))
    return per_key.groupBy("occurrences").agg(F.count("*").alias("n_keys")).orderBy("occurrences")


def merge_rare_categories(df: DataFrame, column: str, minimum: int, other: str = "Unknown") -> DataFrame:
    """Categories with fewer than ``minimum`` rows become ``other``."""
    counts = df.groupBy(F.col(column).alias("_level")).agg(F.count("*").alias("_n"))
    rare = counts.filter(F.col("_n") < minimum).select("_level")
    return (
        df.join(rare, F.col(column) == F.col("_level"), "left")
        .withColumn(column, F.when(F.col("_level").isNotNull(), F.lit(other)).otherwise(F.col(column)))
        .drop("_level")
    )


# --- numbers -------------------------------------------------------------------------------------

def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def _quantile_columns(found: dict[str, list], names: Sequence[str], fields: Sequence[str]) -> list[Column]:
    return [F.lit(v).cast("double").alias(f"{f}:{n}") for n in names for f, v in zip(fields, found[n])]


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    df = freeze(df.select(*columns), "profiled")  # read several times
    found = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates = []
    for c in columns:
        aggregates += [
            F.count(c).alias(f"count:{c}"), F.avg(c).alias(f"mean:{c}"),
            F.stddev_samp(c).alias(f"std:{c}"), F.min(F.col(c).cast("double")).alias(f"min:{c}"),
            F.max(F.col(c).cast("double")).alias(f"max:{c}"),
        ]
    one = df.agg(*aggregates).select("*", *_quantile_columns(found, columns, ["q25", "q50", "q75"]))
    return _unpivot_row(one, columns, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def _bias_corrected(c: str) -> tuple[Column, Column]:
    """Sample skewness and excess kurtosis from the population ones."""
    n = F.count(c).cast("double")
    skew = F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
    kurtosis = F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return skew, kurtosis


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe_numeric`` plus missing values, skewness and kurtosis."""
    df = freeze(df.select(*columns), "profiled")  # read several times
    found = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates = []
    for c in columns:
        skew, kurtosis = _bias_corrected(c)
        aggregates += [
            F.count(c).alias(f"count:{c}"), F.count_if(F.col(c).isNull()).alias(f"missing:{c}"),
            F.min(F.col(c).cast("double")).alias(f"min:{c}"),
            F.max(F.col(c).cast("double")).alias(f"max:{c}"),
            F.avg(c).alias(f"mean:{c}"), F.stddev_samp(c).alias(f"std:{c}"),
            skew.alias(f"skewness:{c}"), kurtosis.alias(f"kurtosis:{c}"),
        ]
    one = df.agg(*aggregates).select("*", *_quantile_columns(found, columns, ["q25", "median", "q75"]))
    return _unpivot_row(one, columns, ["count", "missing", "min", "max", "mean", "std", "q25",
                                       "median", "q75", "skewness", "kurtosis"])


def outliers_iqr(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Quartile fences of each column and how many values lie outside."""
    df = freeze(df.select(*columns), "profiled")  # read several times
    found = quantiles(df, columns, [0.25, 0.75])
    aggregates, fences = [], []
    for c in columns:
        q1, q3 = found[c]
        low = None if q1 is None else q1 - factor * (q3 - q1)
        high = None if q1 is None else q3 + factor * (q3 - q1)
        aggregates += [F.count_if(F.col(c) < F.lit(low)).alias(f"n_low:{c}"),
                       F.count_if(F.col(c) > F.lit(high)).alias(f"n_high:{c}")]
        fences += [F.lit(low).cast("double").alias(f"fence_low:{c}"),
                   F.lit(high).cast("double").alias(f"fence_high:{c}")]
    one = df.agg(*aggregates).select("*", *fences)
    return _unpivot_row(one, columns, ["fence_low", "fence_high", "n_low", "n_high"])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}:{b}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}:{b}`").alias("correlation"))
               for a, b in pairs]
    return one.select(F.inline(F.array(*entries)))


def histogram(df: DataFrame, value: Column, width: float, start: float = 0.0) -> DataFrame:
    """Rows per bin ``[start + bin * width, start + (bin + 1) * width)``."""
    number = F.floor((value - start) / width).cast("bigint").alias("bin")
    return df.filter(value.isNotNull()).groupBy(number).agg(F.count("*").alias("n")).orderBy("bin")


def histogram_by_spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``bin``, ``low``, ``high``, ``n``: bins from the minimum on, of Freedman-Diaconis width, which is twice the
    distance of the quartiles over the cube root of the count. Nulls are left out, empty bins too; a column whose
    quartiles are equal has one bin from minimum to maximum, one without values has no rows."""
    df = freeze(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "profiled")  # read several times
    found = quantiles(df, columns, [0.25, 0.75])
    ends = df.agg(*[f(c).alias(f"{name}:{c}") for c in columns for name, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    cells = []
    for c in columns:
        n, start, stop = (ends[f"{name}:{c}"] for name in ("n", "low", "high"))
        width = 2 * (found[c][1] - found[c][0]) / n ** (1 / 3) if n else 0.0
        at = F.floor((F.col(c) - F.lit(start)) / F.lit(width)).cast("bigint") if width else F.lit(0).cast("bigint")
        low = F.lit(start) + at * F.lit(width)
        cells.append(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), at).alias("bin"), low.cast("double").alias("low"),
                              ((low + F.lit(width)) if width else F.lit(stop)).cast("double").alias("high")))
    rows = df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
    return rows.groupBy("column", "bin", "low", "high").agg(F.count("*").alias("n"))


def histogram_by_depth(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``column``, ``bin`` from 1, ``low``, ``high``, ``n``: bins that hold like numbers of rows, cut at exact ranks. Equal
    values share the first bin that reaches them, so a frequent value may leave bins out. Nulls are left out."""
    df = freeze(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "profiled")  # read several times
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    ranks = {c: [-(-i * sizes[c] // bins) - 1 for i in range(1, bins + 1)] for c in columns if sizes[c]}
    edges = order_statistics(df, {c: F.col(c) for c in ranks}, {c: [(r, r) for r in found] for c, found in ranks.items()}) if ranks else {}
    cells = []
    for c in columns:
        at = F.lit(None).cast("bigint")
        for i, (edge, _) in reversed(list(enumerate(edges.get(c, ()), 1))):
            at = F.when(F.col(c) <= F.lit(edge), F.lit(i).cast("bigint")).otherwise(at)
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin"), F.col(c).alias("value")))
    rows = df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
    return rows.groupBy("column", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def segment_summary(df: DataFrame, segments: Sequence[str], metrics: dict[str, Column],
                    totals: str = "none") -> DataFrame:
    """Metrics per segment, on request with subtotals (``rollup``) or all combinations (``cube``)."""
    grouped = {"none": df.groupBy, "rollup": df.rollup, "cube": df.cube}[totals](*segments)
    return grouped.agg(F.count("*").alias("n"), *[m.alias(name) for name, m in metrics.items()])


def rfm_features(df: DataFrame, customer: str, datetime: str, as_of: Column, canceled: Column,
                 lead_time: Column, off_peak: Column) -> DataFrame:
    """Recency, frequency, cancellation share, lead-time spread and off-peak share per customer."""
    return df.groupBy(customer).agg(
        F.datediff(as_of, F.max(datetime)).alias("recency_days"),
        F.count("*").alias("frequency"),
        F.avg(canceled.cast("double")).alias("cancellation_rate"),
        F.stddev_samp(lead_time).alias("lead_time_spread"),
        F.avg(off_peak.cast("double")).alias("off_peak_share"),
    )


# --- declared constraints ----------------------------------------------------------------------------

def _breaks(rule: Rule) -> Column:
    c = F.col(rule.column)
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "allowed":
        return c.isNotNull() & ~c.isin(*rule.allowed)
    if rule.kind == "range":
        broken = F.lit(False)
        if rule.low is not None:
            broken = broken | (c < rule.low)
        if rule.high is not None:
            broken = broken | (c > rule.high)
        return F.coalesce(broken, F.lit(False))
    raise ValueError(f"no row-wise rule {rule.kind!r}")


def _key_report(df: DataFrame, column: str, rules: Sequence[Rule], tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Rules on the values of one key column, from one count per value; a frequent value is one row of it."""
    counts = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("n"))
    if len(rules) > 1:
        counts = freeze(counts, "key-counts")
    parts = []
    for r in rules:
        if r.kind == "unique":
            broken = counts.filter("n > 1")
        else:
            table, key = r.target
            known = tables[table].select(F.col(key).alias("_value"))
            broken = counts.filter("_value IS NOT NULL").join(known, "_value", "left_anti")
        parts.append(broken.agg(F.lit(column).alias("column"), F.lit(r.kind).alias("rule"),
                                F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))
    return parts


def constraint_report(df: DataFrame, rules: Sequence[Rule], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Violations per rule: one pass for all row-wise rules, one count per value for all rules on a key column.

    ``references`` looks its values up in ``tables``; a null refers to nothing and breaks no such rule.
    """
    row_rules = [r for r in rules if r.kind not in ("unique", "references")]
    one = df.agg(*[F.count_if(_breaks(r)).alias(f"v{i}") for i, r in enumerate(row_rules)]) if row_rules else None
    entries = [F.struct(F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule"),
                        F.col(f"v{i}").alias("violations")) for i, r in enumerate(row_rules)]
    parts = [one.select(F.inline(F.array(*entries)))] if row_rules else []
    keyed: dict[str, list[Rule]] = {}
    for r in rules:
        if r.kind in ("unique", "references"):
            keyed.setdefault(r.column, []).append(r)
    for column, mine in keyed.items():
        parts += _key_report(df, column, mine, tables or {})
    return reduce(DataFrame.unionByName, parts)


def declared_report(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]]) -> DataFrame:
    """``table, column, rule, violations`` of every rule of every table, references between them included."""
    parts = [constraint_report(tables[name], mine, tables).select(F.lit(name).alias("table"), "*") for name, mine in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all row-wise rules, and rows that break one with the rules they break."""
    named = [F.when(_breaks(r), F.lit(f"{r.column}:{r.kind}")) for r in rules if r.kind not in ("unique", "references")]
    marked = df.withColumn("broken_rules", F.array_compact(F.array(*named)))
    good = marked.filter(F.size("broken_rules") == 0).drop("broken_rules")
    return good, marked.filter(F.size("broken_rules") > 0)


def slot_histogram(df: DataFrame, datetime: str) -> DataFrame:
    return histogram(df, temporal.half_hour_slot(F.col(datetime)), 1)
