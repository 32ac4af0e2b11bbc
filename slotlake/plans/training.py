"""Training per meal band with ``pyspark.ml``, cross-validation and parameter search."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake import constants as K
from slotlake.config import (
    MEAL_BANDS, ROUTING_COLUMN, Band, BoostSettings, EvaluationSettings, ForestSettings, Range,
)
from slotlake.functions.temporal import round_to_slot
from slotlake.functions.values import category_text
from slotlake.operators import encode, evaluate
from slotlake.operators.split import split_random, split_temporal, stratified_folds
from slotlake.session import freeze

CODE = "_code"


def in_parallel(run: Callable, items: Sequence, threads: int = 4) -> list:
    """Results of ``run`` per item, in order. Fits of small bands alone would leave executors idle."""
    items = list(items)
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(run), items)


# --- estimators ------------------------------------------------------------------------------------

def forest_classifier(s: ForestSettings = ForestSettings()) -> Estimator:
    return RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.min_leaf,
                                  seed=s.seed, maxBins=128, cacheNodeIds=True, checkpointInterval=10)


def forest_regressor(s: ForestSettings = ForestSettings()) -> Estimator:
    return RandomForestRegressor(numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.min_leaf,
                                 seed=s.seed, maxBins=128, cacheNodeIds=True, checkpointInterval=10)


def boosted_classifier(s: BoostSettings = BoostSettings(), parallelism: int = 4) -> Estimator:
    """One boosted model per class: Spark's boosting itself separates only two classes."""
    one = GBTClassifier(maxIter=s.rounds, maxDepth=s.depth, stepSize=s.learning_rate, seed=s.seed,
                        minInstancesPerNode=s.min_leaf, maxBins=128)
    return OneVsRest(classifier=one, parallelism=parallelism)


def boosted_regressor(s: BoostSettings = BoostSettings(), loss: str = "squared") -> Estimator:
    return GBTRegressor(maxIter=s.rounds, maxDepth=s.depth, stepSize=s.learning_rate, seed=s.seed,
                        minInstancesPerNode=s.min_leaf, lossType=loss, maxBins=128)


# --- feature vectors ---------------------------------------------------------------------------------

def split_feature_names(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical ones among the features."""
    types = dict(df.dtypes)
    text = [c for c in features if types[c] == "string"]
    return [c for c in features if c not in text], text


def with_model_types(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Doubles and non-missing category text; a column the frame lacks becomes missing."""
    present = set(df.columns)
    pick = lambda c: F.col(c) if c in present else F.lit(None)
    return df.withColumns({
        **{c: pick(c).try_cast("double") for c in numeric},
        **{c: category_text(pick(c)) for c in categorical},
    })


def vector_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Category codes by sorted label, with one more code for labels unseen in training."""
    stages: list = []
    codes = [f"{c}{CODE}" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=codes,
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*numeric, *codes], outputCol="features", handleInvalid="keep"))
    return stages


def fit_encoders(inputs: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PipelineModel:
    return Pipeline(stages=vector_stages(numeric, categorical)).fit(inputs)


def fit_on_vectors(before: PipelineModel, vectors: DataFrame, estimator: Estimator) -> PipelineModel:
    """The estimator behind fitted encoders. A tree needs a bin for every level of a category, unseen ones included."""
    levels = max([len(a) + 1 for s in before.stages if hasattr(s, "labelsArray") for a in s.labelsArray], default=0)
    tree = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    if levels > tree.getMaxBins():
        tree.setMaxBins(levels)
    return PipelineModel([*before.stages, estimator.fit(vectors)])


def fit_stages(inputs: DataFrame, numeric: Sequence[str], categorical: Sequence[str], estimator: Estimator) -> PipelineModel:
    """Encoders and estimator."""
    before = fit_encoders(inputs, numeric, categorical)
    return fit_on_vectors(before, before.transform(inputs), estimator)


# --- one classifier ------------------------------------------------------------------------------------

@dataclass
class SlotModel:
    """A fitted classifier: pipeline, class labels and feature names."""

    pipeline: PipelineModel
    labels: list[int]
    numeric: list[str]
    categorical: list[str]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def predict(self, df: DataFrame, output: str = "prediction_label", probability: str = "probability") -> DataFrame:
        """Add the predicted label and the probability of it."""
        before = df.columns
        raw = self.pipeline.transform(with_model_types(df, self.numeric, self.categorical))
        label = F.element_at(F.lit(self.labels), F.col("prediction").cast("int") + 1)
        confidence = class_probability(raw)
        return raw.select(*before, label.alias(output), confidence.alias(probability))


def class_probability(raw: DataFrame) -> Column:
    """Largest class probability; one-vs-rest margins are squashed and normalised first."""
    if "probability" in raw.columns:
        return F.array_max(vector_to_array("probability"))
    scores = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    return F.array_max(scores) / F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)


def _class_inputs(train: DataFrame, target: str, features: Sequence[str]) -> tuple[DataFrame, list[int], list[str], list[str]]:
    """``label`` (the place of the class) and typed features of the rows with a class; the classes, and the features by kind."""
    evaluate.assert_no_leakage(features, [*K.TIME_SIBLINGS, target])
    numeric, categorical = split_feature_names(train, features)
    typed = with_model_types(train.filter(F.col(target).isNotNull()), numeric, categorical)
    # a multiclass model holds its classes on the driver in any case
    labels = sorted(r[0] for r in typed.select(target).distinct().collect())
    place = F.array_position(F.lit(labels), F.col(target)) - 1
    labelled = typed.withColumn("label", place.cast("double"))
    return _with_classes(labelled, labels).select("label", *numeric, *categorical), labels, numeric, categorical


def _with_classes(rows: DataFrame, labels: Sequence[int]) -> DataFrame:
    metadata = {"ml_attr": {"type": "nominal", "vals": [str(v) for v in labels], "name": "label"}}
    return rows.withMetadata("label", metadata)


def fit_classifier(train: DataFrame, target: str, features: Sequence[str], estimator: Estimator) -> SlotModel:
    inputs, labels, numeric, categorical = _class_inputs(train, target, features)
    return SlotModel(fit_stages(inputs, numeric, categorical, estimator), labels, numeric, categorical)


@dataclass
class EncodedRows:
    """Training rows as vectors, written once, for several classifiers on the same rows."""

    before: PipelineModel
    vectors: DataFrame
    labels: list[int]
    numeric: list[str]
    categorical: list[str]

    def fit(self, estimator: Estimator) -> SlotModel:
        """As ``fit_classifier`` on the same rows."""
        return SlotModel(fit_on_vectors(self.before, self.vectors, estimator), self.labels, self.numeric, self.categorical)


def encode_rows(train: DataFrame, target: str, features: Sequence[str]) -> EncodedRows:
    """Encoders fitted on the rows, and the vectors written."""
    inputs, labels, numeric, categorical = _class_inputs(train, target, features)
    before = fit_encoders(inputs, numeric, categorical)
    vectors = freeze(before.transform(inputs).select("label", "features"), "vectors")
    return EncodedRows(before, _with_classes(vectors, labels), labels, numeric, categorical)


# --- one regressor ----------------------------------------------------------------------------------------

@dataclass
class ValueModel:
    pipeline: PipelineModel
    numeric: list[str]
    categorical: list[str]

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        typed = with_model_types(df, self.numeric, self.categorical)
        raw = self.pipeline.transform(typed)
        return raw.select(*df.columns, F.col("prediction").alias(output))


def fit_regressor(train: DataFrame, target: str, features: Sequence[str], estimator: Estimator) -> ValueModel:
    evaluate.assert_no_leakage(features, [*K.TIME_SIBLINGS, target])
    numeric, categorical = split_feature_names(train, features)
    typed = with_model_types(train.filter(F.col(target).isNotNull()), numeric, categorical)
    inputs = typed.select(F.col(target).cast("double").alias("label"), *numeric, *categorical)
    return ValueModel(fit_stages(inputs, numeric, categorical, estimator), numeric, categorical)


def predict_slots(model: ValueModel, df: DataFrame, output: str = "prediction") -> DataFrame:
    """Ordinal prediction: the regressed slot rounded and clipped to 0..47."""
    return model.predict(df, "_slot").withColumn(output, round_to_slot(F.col("_slot"))).drop("_slot")


@dataclass
class LinearModel:
    """Least squares on numbers and one-hot categories, held as sparse vectors."""

    pipeline: PipelineModel
    plain: list[str]
    categories: list[str]
    names: list[str]
    deviations: list[float]

    def predict(self, df: DataFrame, keep: Sequence[str], output: str = "prediction") -> DataFrame:
        typed = _linear_inputs(df, self.plain, self.categories, keep)
        raw = self.pipeline.transform(typed)
        predicted = F.when(F.col("_complete"), F.col("prediction"))
        return raw.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], predicted.alias(output))

    def coefficients(self) -> DataFrame:
        """Effect of one population deviation of each input, so that inputs compare."""
        rows = [(n, float(c * d)) for n, c, d in zip(self.names, self.pipeline.stages[-1].coefficients, self.deviations)]
        return SparkSession.active().createDataFrame(rows, "feature STRING, coefficient DOUBLE")


def _linear_inputs(df: DataFrame, plain: Sequence[str], categories: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Numbers and category text; ``_complete`` tells whether every number is there, else it is 0 here."""
    numbers = {c: F.col(c).try_cast("double") for c in plain}
    known = {c: v.isNotNull() & ~F.isnan(v) for c, v in numbers.items()}
    return df.select(
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        *[F.when(known[c], v).otherwise(0.0).alias(c) for c, v in numbers.items()],
        *[encode.level_text(df, c).alias(c) for c in categories],
        reduce(lambda a, b: a & b, known.values(), F.lit(True)).alias("_complete"))


def fit_linear(train: DataFrame, target: str, features: Sequence[str],
               integer_categories: Sequence[str] = K.INTEGER_CATEGORICAL_COLUMNS,
               baselines: Mapping[str, str] = K.ONE_HOT_BASELINES) -> LinearModel:
    """Fit on complete rows; ``predict`` answers every row, with null where a number is missing. A label unseen in training, or missing, is zero in every one-hot place:
    the indexer gives both a last code of their own, and the encoder drops the last code."""
    evaluate.assert_no_leakage(features, [*K.TIME_SIBLINGS, target])
    numeric, text = split_feature_names(train, features)
    categories = [*text, *[c for c in integer_categories if c in features]]
    plain = [c for c in numeric if c not in categories]
    rows = _linear_inputs(train, plain, categories, [target]).withColumn(
        "label", F.col(f"_keep_{target}").cast("double")).filter("_complete and label is not null")
    stages, names = [], list(plain)
    if categories:
        codes, vectors = [f"{c}{CODE}" for c in categories], [f"{c}_vector" for c in categories]
        indexer = StringIndexer(inputCols=categories, outputCols=codes, stringOrderType="alphabetAsc",
                                handleInvalid="keep").fit(rows)
        stages = [indexer, OneHotEncoder(inputCols=codes, outputCols=vectors, dropLast=True)]
        names += [f"{c}_{v}" for c, labels in zip(categories, indexer.labelsArray) for v in labels]
        plain_and_vectors = [*plain, *vectors]
    else:
        plain_and_vectors = plain
    dropped = {f"{c}_{v}" for c, v in baselines.items()}
    kept = [i for i, n in enumerate(names) if n not in dropped]
    prepare = Pipeline(stages=[
        *stages, VectorAssembler(inputCols=plain_and_vectors, outputCol="_all", handleInvalid="error"),
        VectorSlicer(inputCol="_all", outputCol="features", indices=kept)]).fit(rows)
    vectors_only = prepare.transform(rows).select("label", "features")
    moments = vectors_only.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("m")).first()["m"]
    share = (moments["count"] - 1) / moments["count"] if moments["count"] else 0.0
    model = LinearRegression(solver="auto", regParam=0.0).fit(vectors_only)
    return LinearModel(PipelineModel([*prepare.stages, model]), plain, categories, [names[i] for i in kept],
                       [math.sqrt(v * share) for v in moments["variance"]])


# --- importance --------------------------------------------------------------------------------------------

def feature_importance(model: SlotModel | ValueModel, top: int | None = None) -> DataFrame:
    """``feature, importance``, largest first; one-vs-rest models are averaged."""
    last = model.pipeline.stages[-1]
    parts = last.models if hasattr(last, "models") else [last]
    names = [*model.numeric, *model.categorical]
    rows = [(n, float(sum(p.featureImportances[i] for p in parts)) / len(parts)) for i, n in enumerate(names)]
    table = SparkSession.active().createDataFrame(rows, "feature STRING, importance DOUBLE")
    ranked = table.orderBy(F.desc("importance"), "feature")
    return ranked.limit(top) if top else ranked


# --- cross-validation and search ----------------------------------------------------------------------------

def scores_by_fold(conf: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 of every fold, from confusion counts with a ``fold`` column."""
    return evaluate.accuracy(conf, ["fold"]).join(evaluate.weighted_f1(conf, ["fold"]), "fold")


def summarise_folds(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds."""
    return scores.agg(
        F.avg("accuracy").alias("cv_acc_mean"), F.stddev_pop("accuracy").alias("cv_acc_std"),
        F.avg("f1_weighted").alias("cv_f1_mean"), F.stddev_pop("f1_weighted").alias("cv_f1_std"))


def mark_folds(df: DataFrame, target: str, key: str, features: Sequence[str], folds: int = 5) -> DataFrame:
    """The columns that fits need and ``fold``, written once: no fit ranks the rows again."""
    return freeze(stratified_folds(df.select(key, target, *features), target, key, folds), "folds")


def score_folds(marked: DataFrame, target: str, features: Sequence[str], estimator: Callable[[], Estimator],
                folds: int = 5) -> DataFrame:
    """Fit everything, encoders included, per fold of marked rows; one row of means and deviations."""
    def run(fold: int) -> DataFrame:
        model = fit_classifier(marked.filter(F.col("fold") != fold), target, features, estimator())
        return model.predict(marked.filter(F.col("fold") == fold)).select(
            "fold", F.col(target).alias("label"), F.col("prediction_label").alias("prediction"))

    predicted = reduce(DataFrame.unionByName, in_parallel(run, range(folds)))
    conf = freeze(evaluate.confusion(predicted, by=["fold"]), "fold-counts")
    return summarise_folds(scores_by_fold(conf))


def cross_validate(df: DataFrame, target: str, key: str, features: Sequence[str],
                   estimator: Callable[[], Estimator], folds: int = 5) -> DataFrame:
    return score_folds(mark_folds(df, target, key, features, folds), target, features, estimator, folds)


def search_params(df: DataFrame, target: str, key: str, features: Sequence[str],
                  estimator: Callable[[dict], Estimator], space: Mapping[str, Range], trials: int,
                  folds: int = 5, seed: int = 42) -> tuple[dict, DataFrame]:
    """Best of ``trials`` random draws by cross-validated accuracy, and all trials on the same folds."""
    rng = random.Random(seed)
    marked = mark_folds(df, target, key, features, folds)
    drawn = [{name: values.draw(rng) for name, values in space.items()} for _ in range(trials)]
    scores = [score_folds(marked, target, features, lambda p=p: estimator(p), folds).first()["cv_acc_mean"] for p in drawn]
    best = max(range(trials), key=lambda t: (scores[t], -t))
    table = SparkSession.active().createDataFrame(
        [(t, str(p), s) for t, (p, s) in enumerate(zip(drawn, scores))], "trial INT, params STRING, cv_acc_mean DOUBLE")
    return drawn[best], table


# --- bands ---------------------------------------------------------------------------------------------------

@dataclass
class BandModel:
    band: Band
    model: SlotModel
    n_rows: int


def candidate_features(df: DataFrame, target: str, leakage: Sequence[str], ids: Sequence[str] = ()) -> list[str]:
    banned = {*K.NON_FEATURE_COLUMNS, *K.TIME_SIBLINGS, *leakage, target, *ids, "subset"}
    return [c for c in df.columns if c not in banned]


def train_band(df: DataFrame, band: Band, target: str, key: str, features: Sequence[str],
               estimator: Estimator, settings: EvaluationSettings = EvaluationSettings()) -> tuple[BandModel, DataFrame]:
    """Fit one band on its training rows; its test rows come back with their predictions."""
    rows = df.filter(F.col(ROUTING_COLUMN).between(band.first, band.last))
    if settings.split == "temporal":
        train, test = split_temporal(rows, "booking_time", key, settings.test_size)
    else:
        train, test = split_random(rows, key, settings.test_size)
    model = fit_classifier(train, target, features, estimator)
    predicted = model.predict(test).select(
        key, F.lit(band.name).alias("subset"), F.col(target).alias("label"),
        F.col("prediction_label").alias("prediction"), "probability")
    return BandModel(band, model, rows.count()), predicted


def train_bands(df: DataFrame, target: str, key: str, features: Sequence[str],
                estimator: Callable[[], Estimator], bands: Sequence[Band] = MEAL_BANDS,
                settings: EvaluationSettings = EvaluationSettings()) -> tuple[list[BandModel], DataFrame]:
    """A model per band and the pooled predictions on the test rows.

    Every fit reads ``df`` several times, so give it a written table rather than a long plan.
    """
    trained = in_parallel(
        lambda b: train_band(df, b, target, key, features, estimator(), settings), bands)
    return [m for m, _ in trained], reduce(DataFrame.unionByName, [p for _, p in trained])


def summary(predictions: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row per band: test rows, accuracy, weighted F1 and tolerance accuracy."""
    conf = freeze(evaluate.confusion(predictions, by=["subset"]), "band-counts")  # one run of the models
    return (
        evaluate.accuracy(conf, ["subset"])
        .join(evaluate.weighted_f1(conf, ["subset"]), "subset")
        .join(evaluate.tolerance_accuracy(conf, tolerance, ["subset"]).drop("n"), "subset")
    )


def ablate(df: DataFrame, variants: Mapping[str, Sequence[str]], target: str, key: str,
           estimator: Callable[[], Estimator], bands: Sequence[Band] = MEAL_BANDS, folds: int = 5) -> DataFrame:
    """Cross-validated scores of every feature set on every band."""
    parts = []
    for band in bands:
        rows = df.filter(F.col(ROUTING_COLUMN).between(band.first, band.last))
        marked = mark_folds(rows, target, key, sorted({c for v in variants.values() for c in v}), folds)
        for name, features in variants.items():
            scores = score_folds(marked, target, features, estimator, folds)
            parts.append(scores.select(F.lit(band.name).alias("subset"), F.lit(name).alias("variant"), "*"))
    return reduce(DataFrame.unionByName, parts)


def compare_band_sets(df: DataFrame, target: str, key: str, features: Sequence[str], band_sets: Mapping[str, Sequence[Band]],
                      classifier: Callable[[], Estimator], ordinal: Callable[[], Estimator]) -> DataFrame:
    """One row per kind of model and set of bands, pooled over its bands: test rows, accuracy, weighted F1,
    and the share within one slot. All sets are judged on the same split."""
    def ordinal_rows(band: Band) -> DataFrame:
        rows = df.filter(F.col(ROUTING_COLUMN).between(band.first, band.last))
        train, test = split_random(rows, key)
        model = fit_regressor(train, target, features, ordinal())
        return predict_slots(model, test).select(F.col(target).alias("label"), "prediction")

    parts = []
    for name, bands in band_sets.items():
        _, by_class = train_bands(df, target, key, features, classifier, bands)
        by_order = reduce(DataFrame.unionByName, in_parallel(ordinal_rows, bands))
        for kind, predicted in (("classifier", by_class.select("label", "prediction")), ("ordinal", by_order)):
            conf = freeze(evaluate.confusion(predicted), "band-set-counts")
            found = evaluate.accuracy(conf).crossJoin(evaluate.weighted_f1(conf)).crossJoin(
                evaluate.tolerance_accuracy(conf, 1).drop("n"))  # one row each
            parts.append(found.select(F.lit(kind).alias("kind"), F.lit(name).alias("band_set"), F.lit(len(bands)).alias("n_bands"), "*"))
    return reduce(DataFrame.unionByName, parts)


def geo_variants(features: Sequence[str]) -> dict[str, list[str]]:
    """Feature sets with all, some or none of the geographic columns."""
    codes, place = set(K.GEO_CATEGORICAL_COLUMNS), {"lat", "lng"}
    base = [c for c in features if c not in codes | place]
    return {
        "all_geo": list(features),
        "codes_only": base + [c for c in features if c in codes],
        "latlng_only": base + [c for c in features if c in place],
        "no_geo": base,
    }
