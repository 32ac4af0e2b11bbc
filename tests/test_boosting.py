import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotlake.config import BoostSettings
from slotlake.plans import boosting, training


@pytest.fixture(scope="module")
def slots(spark):
    """Four classes that a number and a category explain, with noise, nulls and a category of one row."""
    draw = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        x, c = float(draw.normal()), str(draw.choice(["a", "b", "c"]))
        y = int(x > 0.3) + 2 * int(c == "b") if draw.random() < 0.8 else int(draw.integers(4))
        rows.append((i, None if i % 50 == 0 else x, None if i % 70 == 0 else c, 30 + 3 * y))
    rows.append((1200, 0.0, "rare", 30))
    rows.append((1201, 0.0, "a", None))
    return spark.createDataFrame(rows, "id int, x double, c string, slot int")


def test_loss_falls_from_the_entropy_and_shares_add_up(slots):
    model = boosting.fit_softmax(slots, "slot", ["x", "c"], BoostSettings(rounds=4, depth=2, learning_rate=0.5))
    counts = [r["count"] for r in slots.dropna(subset=["slot"]).groupBy("slot").count().collect()]
    n = sum(counts)
    losses = model.losses()
    assert losses[0] == pytest.approx(-sum(k / n * math.log(k / n) for k in counts))
    assert len(losses) == 5 and all(b < a for a, b in zip(losses, losses[1:]))
    got = model.predict(model.probabilities(slots)).collect()
    assert len(got) == 1202 and all(sum(r.probabilities) == pytest.approx(1) for r in got)
    assert all(r.prediction_label == model.labels[int(np.argmax(r.probabilities))] and r.probability == max(r.probabilities) for r in got)
    again = [-math.log(r.probabilities[model.labels.index(r.slot)]) for r in got if r.slot is not None]
    assert statistics.fmean(again) == pytest.approx(losses[-1])


def test_leaf_values_are_newton_steps(slots):
    model = boosting.fit_softmax(slots, "slot", ["x", "c"], BoostSettings(rounds=1, depth=2))
    rows = boosting.with_leaves(model.inputs.vectors(slots.dropna(subset=["slot"])).select("slot", "features"), model.rounds[0].trees).collect()
    prior = [math.exp(s) for s in model.start]
    for k, label in enumerate(model.labels):
        for leaf, value in enumerate(model.rounds[0].values[k]):
            inside = [r for r in rows if r["_leaves"][k] == leaf]
            g = sum((r.slot == label) - prior[k] for r in inside)
            assert value == pytest.approx(g / (len(inside) * prior[k] * (1 - prior[k]) + boosting.RIDGE))
            assert model.rounds[0].rows[k][leaf] == len(inside)


def test_a_round_judges_one_step_and_derives_one_softmax(slots, monkeypatch):
    """Shorter steps are judged only where the first does not lower the loss, and leaves are summed from written gradients."""
    calls = {"log_loss": 0, "softmax": 0}

    def counted(name, real):
        def run(*args):
            calls[name] += 1
            return real(*args)
        return run

    for name in calls:
        monkeypatch.setattr(boosting, name, counted(name, getattr(boosting, name)))
    model = boosting.fit_softmax(slots, "slot", ["x", "c"], BoostSettings(rounds=3, depth=2, learning_rate=0.5))
    assert [r.step for r in model.rounds] == [0.5] * 3 and calls == {"log_loss": 4, "softmax": 1}


def test_the_longest_step_that_lowers_the_loss(slots):
    model = boosting.fit_softmax(slots, "slot", ["x", "c"], BoostSettings(rounds=1, depth=2, learning_rate=64))
    (done,), known = model.rounds, slots.dropna(subset=["slot"])
    rows = boosting.with_leaves(model.inputs.vectors(known).select("slot", "features"), done.trees).collect()

    def loss(step):
        out = []
        for r in rows:
            scores = [s + step * v[leaf] for s, v, leaf in zip(model.start, done.values, r["_leaves"])]
            most = max(scores)
            out.append(math.log(sum(math.exp(s - most) for s in scores)) + most - scores[model.labels.index(r.slot)])
        return statistics.fmean(out)

    lower = [s for s in (64 / 2 ** i for i in range(boosting.HALVINGS)) if loss(s) < model.first_loss]
    assert done.step == lower[0] < 64 and done.loss == pytest.approx(loss(done.step))


def test_softmax_loses_less_than_one_model_a_class(slots):
    """Same trees, rounds and step."""
    known, settings = slots.dropna(), BoostSettings(rounds=6, depth=2, learning_rate=0.3)
    joint = boosting.fit_softmax(known, "slot", ["x", "c"], settings).losses()[-1]
    apart = training.fit_classifier(known, "slot", ["x", "c"], training.boosted_classifier(settings))
    raw = apart.pipeline.transform(training.with_model_types(known, apart.numeric, apart.categorical))
    margins = training.vector_to_array("rawPrediction")
    shares = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))
    label = F.array_position(F.lit(apart.labels), F.col("slot")).cast("int") - 1
    loss = raw.select(F.avg(-F.log(F.get(shares, label) / F.aggregate(shares, F.lit(0.0), lambda a, s: a + s)))).first()[0]
    assert joint < loss


def test_scores_are_written_between_many_trees(slots, monkeypatch):
    model = boosting.fit_softmax(slots, "slot", ["x", "c"], BoostSettings(rounds=3, depth=1))
    key = lambda m: sorted((r.id, tuple(r.probabilities)) for r in m.probabilities(slots).collect())
    want = key(model)
    monkeypatch.setattr(boosting, "TREES_A_PLAN", 4)
    assert key(model) == want


def test_one_class_and_no_class(slots):
    model = boosting.fit_softmax(slots.where("slot = 30"), "slot", ["x", "c"])
    assert model.losses() == [0.0] and {r.probability for r in model.predict(slots).collect()} == {1.0}
    with pytest.raises(ValueError):
        boosting.fit_softmax(slots.where("slot is null"), "slot", ["x", "c"])
    with pytest.raises(ValueError):
        boosting.fit_absolute(slots.limit(0), "slot", ["x", "c"])


def test_absolute_error_by_medians(slots):
    seen = []
    model = boosting.fit_absolute(slots, "slot", ["x", "c"], BoostSettings(rounds=5, depth=2, learning_rate=0.5),
                                  lambda rows, done: seen.append((rows.collect(), done)))
    known = [r.slot for r in slots.collect() if r.slot is not None]
    losses = model.losses()
    assert losses[0] == pytest.approx(statistics.fmean(abs(y - statistics.median(known)) for y in known))
    assert len(losses) > 2 and all(b < a for a, b in zip(losses, losses[1:]))
    for rows, done in seen:
        for leaf, value in enumerate(done.values[0]):
            left = [r.label - r.scores[0] for r in rows if r["_leaves"][0] == leaf]
            assert value == pytest.approx(statistics.median(left)) and done.rows[0][leaf] == len(left)
    got = model.predict(slots).collect()
    assert statistics.fmean(abs(r.prediction - r.slot) for r in got if r.slot is not None) == pytest.approx(losses[-1])
    assert model.leaves().agg(F.sum("n")).first()[0] == len(known) * len(model.rounds)
    assert {type(r.prediction) for r in boosting.predict_slots(model, slots).collect()} == {int}
