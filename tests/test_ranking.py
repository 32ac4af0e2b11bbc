"""Exact ranks against brute force, with limits small enough to force every path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotlake.operators import ranking, split


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(4)


CASES = {
    "uniform": np.random.default_rng(1).uniform(0, 1, 4000),
    "outlier": np.append(np.random.default_rng(2).normal(0, 1, 3000), [1e15, -1e12]),
    "one value": np.full(3000, 7.0),
    "hot value": np.append(np.full(2000, 5.0), np.random.default_rng(3).integers(0, 10**6, 3000)),
    "two hot values": np.append(np.full(2000, 5.0), np.full(2000, 7.0)),
    "hot edges": np.concatenate([np.full(1500, 0.0), np.full(1500, 9.0), np.random.default_rng(4).uniform(0, 9, 1000)]),
    "few": np.array([3.0, 1.0, 2.0]),
    "single": np.array([3.0]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("settle_rows", [50, 1_000_000])
def test_quantiles(spark, name, settle_rows):
    values = CASES[name]
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = ranking.quantiles(frame(spark, values), ["x"], probabilities, settle_rows=settle_rows, accuracy=100)["x"]
    np.testing.assert_allclose(got, np.quantile(values, probabilities), rtol=1e-12)


def test_quantiles_leave_missing_out(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "x double, y double")
    assert ranking.quantiles(df, ["x", "y"], [0.5]) == {"x": [2.0], "y": [None]}


def test_order_statistic_of_integers(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    got = ranking.order_statistics(df, {"x": F.col("x")}, {"x": [(0, 0), (1234, 1235), (4999, 4999)]}, settle_rows=40, accuracy=100)
    assert got["x"] == [(0, 0), (1234, 1235), (4999, 4999)]


def test_rank_in_group_with_a_hot_group(spark):
    import hashlib
    lines = [(i, "hot" if i % 3 else ("a" if i % 2 else None)) for i in range(900)]
    df = spark.createDataFrame(lines, "k bigint, g string")
    for digits in (1, 3):
        got = {r["k"]: r["rank"] for r in ranking.rank_in_group(df, ["g"], "k", digits=digits).collect()}
        for group in ("hot", "a", None):
            members = sorted((k for k, g in lines if g == group), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
            assert [got[k] for k in members] == list(range(len(members)))


def test_folds_are_balanced_and_complete(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 % 3).alias("label"))
    counts = split.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in range(3):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in counts) == 1003


def test_sorted_codes_in_pieces(spark):
    labels = sorted({f"Customer#{i * 37 % 1000:05d}" for i in range(1000)} | {"北", "a", "Z"})
    df = spark.createDataFrame([("c", v) for v in labels] + [("small", "y"), ("small", "x")], "column string, label string")
    direct = {(r["column"], r["label"]): r["code"] for r in ranking.sorted_codes(df).collect()}
    pieces = {(r["column"], r["label"]): r["code"] for r in ranking.sorted_codes(df, pieces=20).collect()}
    assert direct == pieces == {**{("c", v): i for i, v in enumerate(labels)}, ("small", "x"): 0, ("small", "y"): 1}


@pytest.mark.parametrize("ties", [1, 10, 1000])
def test_temporal_split_with_ties(spark, ties):
    df = spark.range(1000).select("id", F.timestamp_seconds(F.floor(F.col("id") * 7 % 1000 / ties)).alias("t"))
    ordered = sorted((r["t"], r["id"]) for r in df.collect())
    train, test = split.split_temporal(df, "t", "id", 0.2)
    assert sorted(r["id"] for r in test.collect()) == sorted(i for _, i in ordered[800:])
    assert train.count() == 800


def test_random_split_ignores_partitioning(spark):
    df = spark.range(2000)
    a = {r["id"] for r in split.split_random(df.repartition(7), "id")[1].collect()}
    b = {r["id"] for r in split.split_random(df.coalesce(1), "id")[1].collect()}
    assert a == b and 320 < len(a) < 480


def test_rows_without_a_time_are_the_latest(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 10 <> 3 THEN timestamp_seconds(id) END AS t")
    train, test = split.split_temporal(df, "t", "id", 0.2)
    assert train.count() == 80 and test.count() == 20
    assert test.filter("t IS NULL").count() == 10 and train.filter("t IS NULL").count() == 0
    train, test = split.split_temporal(df, "t", "id", 0.05)
    assert [r["id"] for r in test.orderBy("id").collect()] == [53, 63, 73, 83, 93] and train.count() == 95
