"""What a model's features are worth: gain of the splits in its trees, and what a shuffled column costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.operators.ranking import rank_in_group
from slotlake.plans.training import SlotModel, ValueModel
from slotlake.session import freeze, new_path


def split_nodes(model: SlotModel | ValueModel) -> DataFrame:
    """``part, tree, node, feature, gain, n``: every split of every tree, read from the stored model, so that its
    trees never pass through the driver's Python. ``part`` numbers the models of a one-vs-rest."""
    spark, last = SparkSession.active(), model.pipeline.stages[-1]
    tables = []
    for i, part in enumerate(last.models if hasattr(last, "models") else [last]):
        path = new_path(spark, "trees")
        part.write().save(path)
        node = F.col("nodeData")
        tables.append(spark.read.parquet(f"{path}/data").filter(node["leftChild"] >= 0).select(
            F.lit(i).alias("part"), F.col("treeID").alias("tree"), node["id"].alias("node"),
            node["split"]["featureIndex"].alias("feature"), node["gain"].alias("gain"), node["rawCount"].alias("n")))
    return reduce(DataFrame.unionByName, tables)


def gain_importance(model: SlotModel | ValueModel) -> DataFrame:
    """``feature, n_splits, gain, share``: gain times rows, summed over all splits on a feature. Shares add up to
    one; a feature without a split has zeros, and so has every feature of trees without any split."""
    names = SparkSession.active().createDataFrame(list(enumerate(model.numeric + model.categorical)), "_index INT, feature STRING")
    sums = split_nodes(model).groupBy(F.col("feature").alias("_index")).agg(
        F.count("*").alias("n_splits"), F.sum(F.col("gain") * F.col("n")).alias("gain"))
    found = freeze(names.join(sums, "_index", "left").select(
        "feature", F.coalesce("n_splits", F.lit(0)).alias("n_splits"), F.coalesce("gain", F.lit(0.0)).alias("gain")), "gains")
    total = found.agg(F.sum("gain").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("gain") / F.col("_total")).otherwise(0.0)
    return found.crossJoin(total).select("feature", "n_splits", "gain", share.alias("share"))  # one total


def _score(model: SlotModel | ValueModel, rows: DataFrame, target: str) -> DataFrame:
    """``_score`` of every row: hit or miss of a label, negative absolute error of a value."""
    predicted = model.predict(rows, "_prediction")
    if isinstance(model, SlotModel):
        return predicted.withColumn("_score", (F.col("_prediction") == F.col(target)).cast("double"))
    return predicted.withColumn("_score", -F.abs(F.col("_prediction") - F.col(target)))


def permutation_importance(model: SlotModel | ValueModel, df: DataFrame, target: str, key: str, repeats: int = 1,
                           seed: int = 42) -> DataFrame:
    """``feature, importance, deviation, n``: by how much the mean score falls when one column is shuffled.

    ``key`` is unique. Each row meets one other by its place in two orders of the key's hash, so a shuffle is a true
    permutation, drawn without a global sort and the same on every run. One such join serves all columns: the copies of
    a row, one per column and an unchanged one, are made and scored where it lies. Rows without a target are left out;
    without any row the result is empty.
    """
    names = [*model.numeric, *model.categorical]
    given = df.filter(F.col(target).isNotNull()).select(key, target, *names)
    rows = freeze(rank_in_group(given, [], key, "_at"), "ranked")
    drawn = rows.select(
        *[F.col(c).alias(f"_other_{c}") for c in names], F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_turn"), F.col(key).alias("_key"))
    drawn = drawn.withColumn("_draw", F.concat_ws(":", F.lit(str(seed)), F.col("_turn").cast("string"), F.col("_key").cast("string")))
    others = rank_in_group(drawn, ["_turn"], "_draw", "_to").drop("_draw", "_key")
    met = rows.join(others, F.col("_at") == F.col("_to"))
    copies = met.withColumn("_changed", F.explode(F.array(F.lit(""), *[F.lit(c) for c in names])))
    changed = copies.select("_turn", "_changed", target, *[
        F.when(F.col("_changed") == c, F.col(f"_other_{c}")).otherwise(F.col(c)).alias(c) for c in names])
    scores = freeze(_score(model, changed, target).groupBy("_turn", "_changed").agg(
        F.avg("_score").alias("_mean"), F.count("*").alias("n")), "shuffled-scores")
    whole = scores.filter("_changed = ''").select("_turn", F.col("_mean").alias("_whole"))
    fall = F.col("_whole") - F.col("_mean")
    return scores.filter("_changed <> ''").join(whole, "_turn").groupBy(F.col("_changed").alias("feature")).agg(
        F.avg(fall).alias("importance"), F.stddev_pop(fall).alias("deviation"), F.max("n").alias("n"))
