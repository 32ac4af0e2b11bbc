import pytest
from pyspark.sql import functions as F

from slotlake.config import BoostSettings, ForestSettings
from slotlake.plans import importance, training


@pytest.fixture(scope="module")
def frame(spark):
    """The label is a third of ``a``; ``b`` says nothing, ``c`` is constant, ``d`` repeats a bit of the label."""
    return spark.range(600).selectExpr(
        "id k", "cast(floor(id % 30 / 10) as int) y", "cast(id % 30 as double) a", "cast(hash(id) % 17 as double) b", "1.0D c",
        "if(id % 30 < 10, 'x', 'z') d")


FEATURES = ["a", "b", "c", "d"]


def shares(table):
    return {r.feature: r for r in table.collect()}


def test_gain_of_a_forest(frame):
    model = training.fit_classifier(frame, "y", FEATURES, training.forest_classifier(ForestSettings(5, 4)))
    got = shares(importance.gain_importance(model))
    assert set(got) == set(FEATURES) and sum(r.share for r in got.values()) == pytest.approx(1)
    assert got["c"].share == 0 and got["c"].n_splits == 0 and got["a"].share > 5 * got["b"].share
    nodes = importance.split_nodes(model).toPandas()
    plain = (nodes.gain * nodes.n).groupby(nodes.feature).sum()
    assert [got[FEATURES[i]].gain for i in plain.index] == pytest.approx(plain.tolist())
    roots = nodes[nodes.node == 0]
    assert roots.tree.is_unique and len(roots) == 5


def test_gain_of_one_model_per_class(frame):
    model = training.fit_classifier(frame, "y", FEATURES, training.boosted_classifier(BoostSettings(2, 2)))
    got = shares(importance.gain_importance(model))
    assert sum(r.share for r in got.values()) == pytest.approx(1)
    assert {r.part for r in importance.split_nodes(model).select("part").distinct().collect()} == {0, 1, 2}


def test_trees_without_a_split(frame):
    model = training.fit_classifier(frame, "y", ["c"], training.forest_classifier(ForestSettings(2, 2)))
    assert [(r.feature, r.n_splits, r.gain, r.share) for r in importance.gain_importance(model).collect()] == [("c", 0, 0.0, 0.0)]


def test_permutation(frame, monkeypatch):
    model = training.fit_classifier(frame, "y", FEATURES, training.forest_classifier(ForestSettings(5, 4)))
    seen = []
    score = importance._score
    monkeypatch.setattr(importance, "_score", lambda m, r, t: (seen.append(r), score(m, r, t))[1])
    got = shares(importance.permutation_importance(model, frame, "y", "k", repeats=2))
    assert set(got) == set(FEATURES) and all(r.n == 600 for r in got.values())
    assert got["c"].importance == 0 and got["c"].deviation == 0 and got["a"].importance > 0.1
    # a column keeps its values, the others their rows
    rows = seen[0].filter("_turn = 1")
    same = rows.filter("_changed = ''").toPandas()
    shuffled = rows.filter("_changed = 'b'").toPandas()
    assert sorted(shuffled.b) == sorted(same.b) and (shuffled.y == (shuffled.a // 10)).all()
    again = shares(importance.permutation_importance(model, frame.repartition(7), "y", "k", repeats=2))
    assert {c: r.importance for c, r in again.items()} == pytest.approx({c: r.importance for c, r in got.items()})


def test_permutation_of_a_value_and_of_nothing(frame, monkeypatch):
    model = training.fit_regressor(frame, "y", ["a", "c"], training.forest_regressor(ForestSettings(3, 4)))
    holes = frame.withColumn("y", F.when(F.col("k") >= 100, F.col("y")))
    seen, score = [], importance._score
    monkeypatch.setattr(importance, "_score", lambda m, r, t: (seen.append(r), score(m, r, t))[1])
    got = shares(importance.permutation_importance(model, holes, "y", "k"))
    value = {r.a: r.p for r in model.predict(frame.select("a", "c").distinct(), "p").collect()}
    error = {c: part.y.sub(part.a.map(value)).abs().mean() for c, part in seen[0].toPandas().groupby("_changed")}
    assert got["a"].importance == pytest.approx(error["a"] - error[""]) and got["a"].importance > 0
    assert got["c"].importance == 0 and got["a"].n == 500
    assert importance.permutation_importance(model, frame.limit(0), "y", "k").count() == 0
