"""A model per meal band: ``train.py FEATURES BUNDLE --granularity half_hour``."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from slotlake.config import (BOOST_SEARCH_SPACE, FOREST_SEARCH_SPACE, MEAL_BANDS, ROUTING_COLUMN, BoostSettings,
                             EvaluationSettings, ForestSettings, resolve_granularity)
from slotlake.operators import evaluate
from slotlake.operators.cleaning import fill_numeric, numeric_columns
from slotlake.plans import scoring, training
from slotlake.session import clear_workspace, freeze, get_spark
from slotlake.sources.delimited import write_table


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("features")
    args.add_argument("bundle")
    args.add_argument("--granularity", choices=["hour", "half_hour"], default="half_hour")
    args.add_argument("--model", choices=["forest", "boosted"], default="forest")
    args.add_argument("--split", choices=["random", "temporal"], default="random")
    args.add_argument("--tune", type=int, default=0, metavar="TRIALS")
    args.add_argument("--size", type=int, default=200, help="trees or boosting rounds")
    options = args.parse_args(argv)
    spark = get_spark("slotlake-train")
    target, leakage = resolve_granularity(options.granularity)
    df = spark.read.parquet(options.features)
    numeric = [c for c in numeric_columns(df) if c not in ("booking_id", ROUTING_COLUMN, target, *leakage)]
    df = freeze(fill_numeric(df, "mean", columns=numeric), "training-rows")
    columns = training.candidate_features(df, target, leakage, ["booking_id"])

    if options.model == "forest":
        make = lambda p: training.forest_classifier(ForestSettings(**p))
        params, space = {"trees": options.size}, FOREST_SEARCH_SPACE
    else:
        make = lambda p: training.boosted_classifier(BoostSettings(**p))
        params, space = {"rounds": options.size}, BOOST_SEARCH_SPACE
    settings = EvaluationSettings(split=options.split)

    def one(band):
        """A band's model, test predictions, and cross-validated scores of its settings."""
        rows = df.filter(df[ROUTING_COLUMN].between(band.first, band.last))
        chosen, trials = params, None
        if options.tune:
            chosen, trials = training.search_params(rows, target, "booking_id", columns, make, space, options.tune, settings.folds)
            scores = trials.orderBy(trials["cv_acc_mean"].desc(), "trial").limit(1)
        else:
            scores = training.cross_validate(rows, target, "booking_id", columns, lambda: make(chosen), settings.folds)
        return (*training.train_band(df, band, target, "booking_id", columns, make(chosen), settings), scores)

    trained = training.in_parallel(one, MEAL_BANDS)
    predictions = freeze(reduce(DataFrame.unionByName, [p for _, p, _ in trained]), "predictions")
    scoring.save_bundle([m for m, _, _ in trained], options.bundle, target, leakage)
    metrics = f"{options.bundle}-metrics"
    conf = freeze(evaluate.confusion(predictions, by=["subset"]), "confusion")
    write_table(training.summary(predictions, settings.tolerance), f"{metrics}/summary")
    write_table(conf, f"{metrics}/confusion")
    for model, _, scores in trained:
        name = model.band.name
        write_table(training.feature_importance(model.model), f"{metrics}/importance/{name}")
        write_table(scores, f"{metrics}/cross_validation/{name}")
        write_table(evaluate.classification_report(conf.filter(conf["subset"] == name).drop("subset")), f"{metrics}/report/{name}")


if __name__ == "__main__":
    main()
    clear_workspace(SparkSession.active())
