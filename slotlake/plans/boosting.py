"""Boosting with losses that ``pyspark.ml`` does not have: softmax over many classes, absolute error.

Each round fits regression trees of ``pyspark.ml`` to the gradient of the loss and keeps their shape only: what a leaf
adds is computed anew from the rows that reach it. The scores of all rows are carried in a table that is written once
a round, so a lost executor costs one round at most, and plans do not grow with the rounds. The driver sees
sums or medians per leaf, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.config import BoostSettings
from slotlake.functions.temporal import round_to_slot
from slotlake.operators import evaluate, ranking
from slotlake.plans.training import in_parallel, split_feature_names, vector_stages, with_model_types
from slotlake.session import freeze

#: Added to the sum of second derivatives of a leaf, so that small leaves move little.
RIDGE = 1.0
#: Halvings of the step that are tried when a round does not lower the loss.
HALVINGS = 8
#: Trees in one plan when rows are scored; beyond that scores are written in between.
TREES_A_PLAN = 96


@dataclass
class Round:
    """Trees of a round, what each of their leaves adds at full step, the step taken, and the loss after it."""

    trees: list[DecisionTreeRegressionModel]
    values: list[list[float]]
    rows: list[list[int]]
    step: float
    loss: float


@dataclass
class Inputs:
    """Encoders, and the value that stands for a missing number: below all of the training rows."""

    prepare: PipelineModel
    numeric: list[str]
    categorical: list[str]
    missing: dict[str, float]

    def vectors(self, df: DataFrame) -> DataFrame:
        return self.prepare.transform(filled(with_model_types(df, self.numeric, self.categorical), self.missing))

    def bins(self) -> int:
        """A tree needs a bin for every level of a category, unseen ones included."""
        levels = [len(a) + 1 for s in self.prepare.stages if hasattr(s, "labelsArray") for a in s.labelsArray]
        return max([128, *levels])


@dataclass
class Boosted:
    inputs: Inputs
    start: list[float]
    first_loss: float
    rounds: list[Round] = field(default_factory=list)

    def scores(self, df: DataFrame, output: str = "_scores") -> DataFrame:
        """``df`` with the array of scores, one a class or one alone."""
        rows = self.inputs.vectors(df).select(*df.columns, "features", F.array(*[F.lit(s) for s in self.start]).alias(output))
        trees = 0
        for r in self.rounds:
            if trees + len(r.trees) > TREES_A_PLAN and trees:
                rows, trees = freeze(rows, "scores"), 0
            rows = with_leaves(rows, r.trees).withColumn(output, stepped(F.col(output), added(r.values), r.step)).drop("_leaves")
            trees += len(r.trees)
        return rows.select(*df.columns, output)

    def losses(self) -> list[float]:
        """Mean loss of the training rows at the start and after every round."""
        return [self.first_loss, *[r.loss for r in self.rounds]]

    def importance(self) -> DataFrame:
        """``feature``, ``importance``: shares of the features in all trees, averaged."""
        trees = [t for r in self.rounds for t in r.trees]
        names = [*self.inputs.numeric, *self.inputs.categorical]
        rows = [(n, sum(float(t.featureImportances[i]) for t in trees) / max(1, len(trees))) for i, n in enumerate(names)]
        return SparkSession.active().createDataFrame(rows, "feature STRING, importance DOUBLE")


def _tree(settings: BoostSettings, bins: int, place: int = 0) -> DecisionTreeRegressor:
    """For the gradient ``_g``; the leaf that a row reaches goes to a column of its own."""
    return DecisionTreeRegressor(labelCol="_g", leafCol=f"_leaf{place}", predictionCol=f"_mean{place}", maxDepth=settings.depth,
                                 minInstancesPerNode=settings.min_leaf, seed=settings.seed, maxBins=bins, cacheNodeIds=True, checkpointInterval=10)


def with_leaves(rows: DataFrame, trees: Sequence[DecisionTreeRegressionModel]) -> DataFrame:
    """Add ``_leaves``: the number of the leaf that each row reaches in each tree."""
    before = rows.columns
    for tree in trees:
        rows = tree.transform(rows)
    return rows.select(*before, F.array(*[F.col(f"_leaf{i}").cast("int") for i in range(len(trees))]).alias("_leaves"))


def added(values: Sequence[Sequence[float]]) -> Column:
    """What each tree adds to a row at full step: the value of the leaf that the row reaches."""
    table = ", ".join(f"array({', '.join(f'{float(v)!r}D' for v in leaves)})" for leaves in values)
    return F.expr(f"transform(_leaves, (leaf, i) -> get(get(array({table}), i), leaf))")


def stepped(scores: Column, more: Column, step: float) -> Column:
    """Scores after a step."""
    return F.zip_with(scores, more, lambda s, a: s + F.lit(step) * a)


def softmax(scores: Column) -> Column:
    """Class probabilities; the largest score is taken off first, so that nothing overflows."""
    most = F.array_max(scores)
    shares = F.transform(scores, lambda s: F.exp(s - most))
    whole = F.aggregate(shares, F.lit(0.0), lambda a, s: a + s)
    return F.transform(shares, lambda s: s / whole)


def log_loss(scores: Column, label: Column) -> Column:
    """Minus the logarithm of the probability of the label's class."""
    most = F.array_max(scores)
    return F.log(F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - most))) + most - F.get(scores, label)


def filled(df: DataFrame, missing: dict[str, float]) -> DataFrame:
    """Numbers that are null, NaN or infinite as the value that stands for them; trees take finite numbers only."""
    usual = lambda c: F.when(F.abs(c) < float("inf"), c)
    return df.withColumns({c: F.coalesce(usual(F.col(c)), F.lit(v)) for c, v in missing.items()})


def _inputs(train: DataFrame, target: str, features: Sequence[str], label: Column) -> tuple[Inputs, DataFrame]:
    """Fitted encoders, and the training rows (``label``, ``features``), written."""
    evaluate.assert_no_leakage(features, [*K.TIME_SIBLINGS, target])
    numeric, categorical = split_feature_names(train, features)
    typed = with_model_types(train, numeric, categorical).select(label.alias("label"), *numeric, *categorical)
    finite = [F.min(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in numeric]
    least = typed.agg(*finite).first() if numeric else {}
    missing = {c: 0.0 if least[c] is None else least[c] - 1 - abs(least[c]) for c in numeric}
    rows = filled(typed, missing)
    inputs = Inputs(Pipeline(stages=vector_stages(numeric, categorical)).fit(rows), numeric, categorical, missing)
    return inputs, freeze(inputs.prepare.transform(rows).select("label", "features"), "boosting")


# --- softmax -------------------------------------------------------------------------------------------------

@dataclass
class SoftmaxModel(Boosted):
    """A score for every class; predictions and probabilities like those of ``SlotModel``."""

    labels: list[int] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.inputs.numeric, *self.inputs.categorical]

    def probabilities(self, df: DataFrame, output: str = "probabilities") -> DataFrame:
        return self.scores(df).select(*df.columns, softmax(F.col("_scores")).alias(output))

    def predict(self, df: DataFrame, output: str = "prediction_label", probability: str = "probability") -> DataFrame:
        """Add the likeliest label, of equals the smallest, and its probability."""
        shares = F.col("_shares")
        place = F.array_position(shares, F.array_max(shares)).cast("int")
        return self.probabilities(df, "_shares").select(
            *df.columns, F.element_at(F.lit(self.labels), place).alias(output), F.array_max(shares).alias(probability))


def _leaf_sums(rows: DataFrame, classes: int) -> tuple[list[list[float]], list[list[int]]]:
    """What each leaf of each class's tree adds: one Newton step on the softmax loss, from sums of all its rows. The
    probability of a class is taken from the written gradient, never derived again for every class of a row."""
    reached = [F.struct(F.get("_leaves", F.lit(k)).alias("leaf"), F.col(f"_g{k}").alias("g")) for k in range(classes)]
    each = rows.select("label", F.posexplode(F.array(*reached)).alias("c", "r"))
    g = F.col("r.g")
    p = (F.col("label") == F.col("c")).cast("double") - g
    sums = each.groupBy("c", F.col("r.leaf").alias("leaf")).agg(F.sum(g).alias("g"), F.sum(p * (1 - p)).alias("h"), F.count("*").alias("n"))
    found = {(r["c"], r["leaf"]): r for r in sums.collect()}  # classes times leaves
    leaves = [max(leaf for c, leaf in found if c == k) + 1 for k in range(classes)]
    value = lambda r: r["g"] / (r["h"] + RIDGE) if r else 0.0
    return ([[float(value(found.get((k, i)))) for i in range(n)] for k, n in enumerate(leaves)],
            [[found[k, i]["n"] if (k, i) in found else 0 for i in range(n)] for k, n in enumerate(leaves)])


def fit_softmax(train: DataFrame, target: str, features: Sequence[str], settings: BoostSettings = BoostSettings(), threads: int = 8) -> SoftmaxModel:
    """One loss over all classes: every round fits a tree a class to its gradient, from the scores of all classes.

    A round takes the longest step, of the learning rate and its halvings, that lowers the training loss; where
    none does, boosting ends. Rows without a label are left out. No labelled rows are an error.
    """
    known = train.filter(F.col(target).isNotNull())
    counts = sorted((r[target], r["count"]) for r in known.groupBy(target).count().collect())  # one row a class
    if not counts:
        raise ValueError("no row has a label")
    labels, n = [c for c, _ in counts], sum(k for _, k in counts)
    place = F.array_position(F.lit(labels), F.col(target)).cast("int") - 1
    inputs, rows = _inputs(known, target, features, place)
    start = [float(v) for v in SparkSession.active().range(1).select(*[F.log(F.lit(k / n)) for _, k in counts]).first()]
    rows = rows.withColumn("scores", F.array(*[F.lit(s) for s in start]))
    mean = lambda scores: F.avg(log_loss(scores, F.col("label")))
    model = SoftmaxModel(inputs, start, rows.agg(mean(F.col("scores"))).first()[0], [], labels)
    gradient = F.transform(softmax(F.col("scores")), lambda p, k: (F.col("label") == k).cast("double") - p)
    bins, classes = inputs.bins(), range(len(labels))
    for _ in range(settings.rounds if len(labels) > 1 else 0):
        # written, so that the many fits of a round read gradients instead of deriving them, each only its own
        rows = rows.withColumn("gradient", gradient).select(*rows.columns, *[F.get("gradient", F.lit(k)).alias(f"_g{k}") for k in classes])
        rows = freeze(rows, "gradients")
        fit = lambda k: _tree(settings, bins, k).fit(rows.select("features", F.col(f"_g{k}").alias("_g")))  # noqa: E731, B023
        trees = in_parallel(fit, classes, threads)
        reached = freeze(with_leaves(rows, trees), "boosting")
        values, sizes = _leaf_sums(reached, len(labels))
        reached = reached.drop(*[f"_g{k}" for k in classes]).withColumn("added", added(values))
        # the first step nearly always lowers the loss: a shorter one is judged only where it does not
        for step in (settings.learning_rate / 2 ** i for i in range(HALVINGS)):
            loss = reached.agg(mean(stepped(F.col("scores"), F.col("added"), step))).first()[0]
            if loss < model.losses()[-1]:
                break
        else:
            break
        model.rounds.append(Round(trees, values, sizes, step, loss))
        rows = reached.withColumn("scores", stepped(F.col("scores"), F.col("added"), step)).drop("_leaves", "added")
    return model


# --- absolute error ------------------------------------------------------------------------------------------

@dataclass
class AbsoluteModel(Boosted):
    """One score, the value itself."""

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.scores(df).select(*df.columns, F.get("_scores", F.lit(0)).alias(output))

    def leaves(self) -> DataFrame:
        """``round``, ``leaf``, ``n``, ``value``: rows of each leaf in training and the median it adds."""
        rows = [(i + 1, j, r.rows[0][j], v) for i, r in enumerate(self.rounds) for j, v in enumerate(r.values[0])]
        return SparkSession.active().createDataFrame(rows, "round INT, leaf INT, n BIGINT, value DOUBLE")


def leaf_medians(rows: DataFrame, residual: Column, leaves: int) -> tuple[list[float], list[int]]:
    """Exact median of the residuals in each leaf, all leaves together, and how many rows each holds."""
    columns = {str(i): F.when(F.get("_leaves", F.lit(0)) == i, residual) for i in range(leaves)}
    found = ranking.quantiles(rows, columns, [0.5])
    sizes = rows.agg(*[F.count(c) for c in columns.values()]).first()
    return [found[str(i)][0] or 0.0 for i in range(leaves)], list(sizes)


def fit_absolute(train: DataFrame, target: str, features: Sequence[str], settings: BoostSettings = BoostSettings(),
                 each_round=None) -> AbsoluteModel:
    """Boosting on absolute error: trees follow the sign of the residual, and each leaf adds the median of its residuals.

    A step towards the median never raises a leaf's absolute error, so the mean never rises over the rounds; a round that
    does not lower it ends boosting. ``each_round(rows, round)`` sees the written rows of a round, with ``_leaves``.
    """
    known = train.filter(F.col(target).isNotNull())
    inputs, rows = _inputs(known, target, features, F.col(target).cast("double"))
    start = ranking.quantiles(rows, ["label"], [0.5])["label"][0]
    if start is None:
        raise ValueError("no row has a label")
    rows = rows.withColumn("scores", F.array(F.lit(start)))
    residual = F.col("label") - F.get("scores", F.lit(0))
    model = AbsoluteModel(inputs, [start], rows.agg(F.avg(F.abs(residual))).first()[0])
    for _ in range(settings.rounds):
        tree = _tree(settings, inputs.bins()).fit(rows.select("features", F.signum(residual).alias("_g")))
        reached = freeze(with_leaves(rows, [tree]), "boosting")
        leaves = reached.agg(F.max(F.get("_leaves", F.lit(0)))).first()[0] + 1
        values, sizes = leaf_medians(reached, residual, leaves)
        after = F.get(stepped(F.col("scores"), added([values]), settings.learning_rate), F.lit(0))
        loss = reached.agg(F.avg(F.abs(F.col("label") - after))).first()[0]
        done = Round([tree], [values], [sizes], settings.learning_rate, loss)
        if each_round:
            each_round(reached, done)
        if loss >= model.losses()[-1]:
            break
        model.rounds.append(done)
        rows = reached.withColumn("scores", F.array(after)).drop("_leaves")
    return model


def predict_slots(model: AbsoluteModel, df: DataFrame, output: str = "prediction") -> DataFrame:
    """The value rounded and clipped to 0..47."""
    return model.predict(df, "_slot").withColumn(output, round_to_slot(F.col("_slot"))).drop("_slot")
