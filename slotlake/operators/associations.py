"""How columns hang together: categories with categories and numbers, and which values are missing together.

Every measure comes from counts or sums per pair of columns and level, all pairs in one pass and added up before
they are shuffled. Rows where one of the two is null count for none of the pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotlake.session import freeze


def contingency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a``, ``b``, ``u``, ``v``, ``n``: rows of every pair of levels of every pair of columns."""
    text = lambda c: F.col(c).cast("string")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text(a).alias("u"), text(b).alias("v"))
                      for a, b in combinations(columns, 2)])
    rows = df.select(F.inline(pairs)).where("u IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("a", "b", "u", "v").agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a``, ``b``, ``n``, ``levels_a``, ``levels_b``, ``v``: Cramér's V with bias correction; null where a column has one level."""
    cells = freeze(contingency(df, columns), "cells")
    of_u = freeze(cells.groupBy("a", "b", "u").agg(F.sum("n").alias("n_u")), "margins")
    of_v = freeze(cells.groupBy("a", "b", "v").agg(F.sum("n").alias("n_v")), "margins")
    levels = of_u.groupBy("a", "b").agg(F.count("*").alias("levels_a"), F.sum("n_u").alias("n")).join(
        of_v.groupBy("a", "b").agg(F.count("*").alias("levels_b")), ["a", "b"])
    share = F.col("n") / F.col("n_u") * (F.col("n") / F.col("n_v"))
    phi = cells.join(of_u, ["a", "b", "u"]).join(of_v, ["a", "b", "v"]).groupBy("a", "b").agg((F.sum(share) - 1).alias("phi"))
    r, k, rest = F.col("levels_a"), F.col("levels_b"), F.col("n") - 1
    fair = F.greatest(F.lit(0.0), F.col("phi") - (r - 1) * (k - 1) / rest)
    least = F.least(r - (r - 1) * (r - 1) / rest, k - (k - 1) * (k - 1) / rest) - 1
    known = (r > 1) & (k > 1) & (least > 0)
    return phi.join(levels, ["a", "b"]).select("a", "b", "n", "levels_a", "levels_b", F.when(known, F.sqrt(F.try_divide(fair, least))).alias("v"))


def correlation_ratios(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``category``, ``number``, ``n``, ``ratio``: how much of a number's spread its category explains, as a square root; null
    where the number does not vary."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(x).alias("number"), F.col(c).cast("string").alias("level"),
                               F.col(x).cast("double").alias("x")) for c in categories for x in numbers])
    rows = df.select(F.inline(pairs)).where("level IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    groups = freeze(rows.groupBy("category", "number", "level").agg(
        F.count("*").alias("k"), F.avg("x").alias("mean"), F.var_pop("x").alias("within")), "levels")
    whole = groups.groupBy("category", "number").agg(F.sum("k").alias("n"), (F.sum(F.col("mean") * F.col("k")) / F.sum("k")).alias("centre"))
    between = F.col("k") * (F.col("mean") - F.col("centre")) ** 2
    return groups.join(whole, ["category", "number"]).groupBy("category", "number").agg(
        F.first("n").alias("n"), F.sqrt(F.try_divide(F.sum(between), F.sum(between + F.col("k") * F.col("within")))).alias("ratio"))


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``value``, ``rank`` (from 1) of all values of the columns; equal values share the average of their ranks.

    Values are counted, dealt by range and written with the number of their part, so ranks add up inside a part
    and a small table of parts says where each begins; no task sees a whole column. Null and NaN have no rank.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    counts = df.select(F.inline(entries)).where("value IS NOT NULL AND NOT isnan(value)").groupBy("column", "value").agg(F.count("*").alias("n"))
    dealt = freeze(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("column", "part").agg(F.sum("n").alias("here"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = freeze(parts.select("column", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before")), "parts")
    below = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))).join(parts, ["column", "part"])
    return ranked.select("column", "value", (F.col("before") + F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def rank_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a``, ``b``, ``n``, ``correlation``: Spearman's, over the rows that have a number in every column; null where one
    column does not vary."""
    rows = freeze(df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna(), "complete")
    names = [f"x{i}" for i in range(len(columns))]
    ranks = freeze(average_ranks(rows, names), "ranks")
    for x in names:
        own = ranks.where(F.col("column") == x).select(F.col("value").alias(x), F.col("rank").alias(f"r_{x}"))
        rows = rows.join(own, x).drop(x)
    pairs = list(combinations(range(len(columns)), 2))
    spread = lambda i, j: F.stddev_pop(f"r_x{i}") * F.stddev_pop(f"r_x{j}")
    one = rows.agg(F.count("*").alias("n"), *[F.try_divide(F.covar_pop(f"r_x{i}", f"r_x{j}"), spread(i, j)).alias(f"c{i}_{j}") for i, j in pairs])
    table = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col("n"), F.col(f"c{i}_{j}").alias("correlation")) for i, j in pairs])
    return one.select(F.inline(table))


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``pattern`` (a digit for each column, 1 where it is null), ``n_missing`` columns and ``n`` rows."""
    flags = [F.col(f"`{c}`").isNull().cast("int") for c in columns or df.columns]
    return df.select(F.concat(*[f.cast("string") for f in flags]).alias("pattern"), reduce(lambda a, b: a + b, flags).alias("n_missing")).groupBy(
        "pattern", "n_missing").agg(F.count("*").alias("n"))


def missing_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``a``, ``b``, ``n_both``, ``correlation``: whether two columns are null together; null where one always or never is."""
    names = list(columns or df.columns)
    patterns = freeze(missing_patterns(df, names), "patterns")
    flag = {c: F.col("pattern").substr(i + 1, 1) == "1" for i, c in enumerate(names)}
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), flag[a].alias("u"), flag[b].alias("v")) for a, b in combinations(names, 2)])
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("double")
    sums = patterns.select("n", F.inline(pairs)).groupBy("a", "b").agg(
        F.sum("n").cast("double").alias("rows"), count(F.col("u")).alias("n_a"), count(F.col("v")).alias("n_b"), count(F.col("u") & F.col("v")).alias("n_ab"))
    spread = F.sqrt(F.col("n_a") * (F.col("rows") - F.col("n_a"))) * F.sqrt(F.col("n_b") * (F.col("rows") - F.col("n_b")))
    return sums.select("a", "b", F.col("n_ab").cast("long").alias("n_both"),
                       F.try_divide(F.col("rows") * F.col("n_ab") - F.col("n_a") * F.col("n_b"), spread).alias("correlation"))
