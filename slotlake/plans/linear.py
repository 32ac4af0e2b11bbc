"""Least squares on scaled numbers and one-hot levels, by the Gram matrix.

The matrix of sums of products is put together from three aggregates of the training rows: products of numbers, numbers
summed per level, and rows per pair of levels. Only sums reach the driver, a square of the number of
columns, which is bounded by ``MOST_COLUMNS``; there the normal equations are solved. Levels of several
categories may add up to the same column; of all solutions the smallest is taken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.operators import encode, evaluate
from slotlake.plans.training import split_feature_names
from slotlake.session import freeze

#: Numbers and levels of a model, at most; the driver solves a system of that size.
MOST_COLUMNS = 4096


@dataclass
class LeastSquares:
    """``numbers``: column -> (mean, deviation, coefficient); ``levels``: column -> level -> coefficient."""

    intercept: float
    numbers: dict[str, tuple[float, float, float]]
    levels: dict[str, dict[str, float]]
    n_rows: int

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Every row; null where a number is missing. A level unseen in training, or missing, adds nothing."""
        terms = [F.lit(self.intercept)]
        for c, (mean, deviation, weight) in self.numbers.items():
            terms.append((_number(c) - mean) * F.lit(weight / deviation if deviation else 0.0))
        for c, weights in self.levels.items():
            if weights:
                known = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
                terms.append(F.coalesce(F.try_element_at(known, encode.level_text(df, c)), F.lit(0.0)))
        return df.withColumn(output, reduce(lambda a, b: a + b, terms))

    def coefficients(self) -> DataFrame:
        """``feature, coefficient``; numbers by the change of one deviation, so that they compare."""
        rows = [(c, float(w)) for c, (_, _, w) in self.numbers.items()]
        rows += [(f"{c}_{v}", float(w)) for c, weights in self.levels.items() for v, w in weights.items()]
        return SparkSession.active().createDataFrame(rows, "feature STRING, coefficient DOUBLE")


def _number(column: str) -> Column:
    value = F.col(column).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _levels_of(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """A row for each category of each row: ``column``, ``level``, and all columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("level")) for c in categories])
    return rows.select("*", F.inline(entries)).where("level IS NOT NULL")


def _scaled(train: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str]) -> tuple[DataFrame, list[tuple[float, float]], int]:
    """Complete rows: numbers ``x0``, ``x1``, … less their mean in deviations, ``y`` less its mean last; texts of levels."""
    values = [*[_number(c) for c in numbers], F.col(target).cast("double")]
    rows = train.select(*[v.alias(f"x{i}") for i, v in enumerate(values)], *[encode.level_text(train, c).alias(c) for c in categories])
    rows = freeze(rows.dropna(subset=[f"x{i}" for i in range(len(values))]), "least-squares")
    found = rows.agg(F.count("*"), *[f(f"x{i}") for i in range(len(values)) for f in (F.avg, F.stddev_pop)]).first()
    if not found[0]:
        raise ValueError("no complete row")
    moments = [(found[1 + 2 * i], found[2 + 2 * i]) for i in range(len(values))]
    scaled = {f"x{i}": (F.col(f"x{i}") - m) / F.lit(d) if d else F.lit(0.0) for i, (m, d) in enumerate(moments[:-1])}
    return rows.withColumns({**scaled, f"x{len(numbers)}": F.col(f"x{len(numbers)}") - moments[-1][0]}), moments, found[0]


def fit_least_squares(train: DataFrame, target: str, features: Sequence[str],
                      integer_categories: Sequence[str] = K.INTEGER_CATEGORICAL_COLUMNS,
                      baselines: Mapping[str, str] = K.ONE_HOT_BASELINES) -> LeastSquares:
    """Fit on rows whose numbers and target are there. Beyond ``MOST_COLUMNS`` columns an error, never a part of them."""
    evaluate.assert_no_leakage(features, [*K.TIME_SIBLINGS, target])
    numeric, text = split_feature_names(train, features)
    categories = [*text, *[c for c in integer_categories if c in features]]
    numbers = [c for c in numeric if c not in categories]
    rows, moments, n = _scaled(train, target, numbers, categories)
    size, xs = len(numbers), [F.col(f"x{i}") for i in range(len(numbers) + 1)]

    level_sums = []
    if categories:
        summed = _levels_of(rows, categories).groupBy("column", "level").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)])
        summed = freeze(summed.where(_not_baseline(baselines)), "level-sums")
        if size + summed.count() > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        level_sums = summed.orderBy("column", "level").collect()
    places = {(r["column"], r["level"]): 1 + size + i for i, r in enumerate(level_sums)}
    gram, right = np.zeros((1 + size + len(places),) * 2), np.zeros(1 + size + len(places))
    gram[0, 0] = n

    products = rows.agg(*[F.sum(xs[i] * xs[j]) for i in range(size) for j in range(i, size + 1)], *[F.sum(x) for x in xs]).first()
    at = iter(products)
    for i in range(size):
        for j in range(i, size):
            gram[1 + i, 1 + j] = gram[1 + j, 1 + i] = next(at)
        right[1 + i] = next(at)
    for i in range(size):
        gram[0, 1 + i] = gram[1 + i, 0] = next(at)
    right[0] = next(at)
    for r in level_sums:
        p = places[r["column"], r["level"]]
        gram[0, p] = gram[p, 0] = gram[p, p] = r["n"]
        gram[1:1 + size, p] = gram[p, 1:1 + size] = [r[f"s{i}"] for i in range(size)]
        right[p] = r[f"s{size}"]
    if len(categories) > 1:
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"`{a}`").alias("u"), F.lit(b).alias("b"), F.col(f"`{b}`").alias("v"))
                          for a, b in combinations(categories, 2)])
        for r in rows.select(F.inline(pairs)).groupBy("a", "u", "b", "v").count().toLocalIterator():  # the square of the columns at most
            p, q = places.get((r["a"], r["u"])), places.get((r["b"], r["v"]))
            if p and q:
                gram[p, q] = gram[q, p] = r["count"]

    weights = np.linalg.lstsq(gram, right, rcond=1e-12)[0]
    weights += np.linalg.lstsq(gram, right - gram @ weights, rcond=1e-12)[0]
    levels: dict[str, dict[str, float]] = {c: {} for c in categories}
    for (c, v), p in places.items():
        levels[c][v] = float(weights[p])
    return LeastSquares(float(weights[0] + moments[-1][0]), {c: (*moments[i], float(weights[1 + i])) for i, c in enumerate(numbers)}, levels, n)


def _not_baseline(baselines: Mapping[str, str]) -> Column:
    """Whether a level is none of those that are left out, one a category at most."""
    out = F.lit(True)
    for c, v in baselines.items():
        out = out & ~((F.col("column") == c) & (F.col("level") == v))
    return out


def residual_sums(model: LeastSquares, train: DataFrame, target: str, output: str = "total") -> DataFrame:
    """``column``, ``level`` (null for a number), ``total`` and ``size``: sums of residuals times each input, and of their
    absolute values, over the complete training rows. For least squares all totals are zero but for rounding."""
    # written, so that the long sum of a prediction is planned and computed once
    rows = freeze(model.predict(train, "_p").select(*dict.fromkeys([*model.numbers, *model.levels]), (F.col(target) - F.col("_p")).alias("_e")), "residuals")
    rows = rows.where("_e IS NOT NULL")
    texts = rows.select("_e", *[encode.level_text(rows, c).alias(c) for c in model.levels])
    part = {c: (_number(c) - m) * F.col("_e") for c, (m, _, _) in model.numbers.items()}
    sums = rows.agg(*[f(x) for x in part.values() for f in (F.sum, lambda x: F.sum(F.abs(x)))]).first() if part else ()
    found = [(c, None, sums[2 * i], sums[2 * i + 1]) for i, c in enumerate(part)]
    out = [SparkSession.active().createDataFrame(found, f"column STRING, level STRING, {output} DOUBLE, size DOUBLE")]
    if model.levels:
        out.append(_levels_of(texts, list(model.levels)).groupBy("column", "level").agg(
            F.sum("_e").alias(output), F.sum(F.abs("_e")).alias("size")))
    return reduce(DataFrame.unionByName, out)
