import numpy as np
import pytest

from slotlake.plans import linear, training

FEATURES = ["a", "b", "c", "k", "weekday"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    out = []
    for i in range(400):
        a, b, k = float(draw.normal(50, 9)), float(draw.integers(3)), int(draw.integers(1, 6))
        c = str(draw.choice(["x", "y", "z"]))
        y = 3 * a - b + {"x": 1, "y": 5, "z": -2}[c] + k + float(draw.normal())
        out.append((i, None if i % 41 == 0 else a, b, None if i % 37 == 0 else c, c + "2", k, None if i % 29 == 0 else y))
    return spark.createDataFrame(out, "id int, a double, b double, c string, k string, weekday int, y double")


def design(rows, levels):
    """Columns of complete rows: one, scaled numbers, levels."""
    done = [r for r in rows.collect() if r.a is not None and r.y is not None]
    x = [np.ones(len(done))]
    for c in ("a", "b"):
        v = np.array([r[c] for r in done])
        x.append((v - v.mean()) / v.std())
    for c, vs in levels.items():
        x += [np.array([float(str(r[c]) == v) for r in done]) for v in vs]
    return np.array(x).T, np.array([r.y for r in done]), done


def test_residuals_are_orthogonal_to_every_input_though_levels_repeat(rows):
    model = linear.fit_least_squares(rows, "y", FEATURES, ["weekday"], {"weekday": "1"})
    x, y, done = design(rows, {"c": "xyz", "k": ["x2", "y2", "z2"], "weekday": "2345"})
    assert model.n_rows == len(done) and model.coefficients().count() == x.shape[1] - 1
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r.id: r.prediction for r in model.predict(rows).collect()}
    assert len(got) == 400 and all(got[r.id] == pytest.approx(w, abs=1e-8) for r, w in zip(done, want))
    assert got[0] is None
    sums = linear.residual_sums(model, rows, "y").collect()
    assert len(sums) == 2 + 3 + 3 + 5 and all(abs(r.total) < 1e-9 * r["size"] for r in sums)


def test_agrees_with_the_library_where_the_solution_is_one(rows):
    known = rows.dropna()
    model = linear.fit_least_squares(known, "y", ["a", "b", "weekday"], ["weekday"], {"weekday": "1"})
    library = training.fit_linear(known, "y", ["a", "b", "weekday"], ["weekday"], {"weekday": "1"})
    theirs = {r.id: r.prediction for r in library.predict(known, ["id"]).collect()}
    assert all(r.prediction == pytest.approx(theirs[r.id], abs=1e-5) for r in model.predict(known).collect())


def test_edges(rows, monkeypatch):
    alone = linear.fit_least_squares(rows.selectExpr("id", "1.0D AS a", "y"), "y", ["a"], [], {})
    mean = np.mean([r.y for r in rows.collect() if r.y is not None])
    assert all(r.prediction == pytest.approx(mean) for r in alone.predict(rows.selectExpr("1.0D AS a")).collect())
    unseen = linear.fit_least_squares(rows.where("c = 'x'"), "y", ["c", "b"], [], {})
    assert unseen.predict(rows).where("prediction IS NULL").count() == 0
    with pytest.raises(ValueError):
        linear.fit_least_squares(rows.limit(0), "y", ["a"], [], {})
    monkeypatch.setattr(linear, "MOST_COLUMNS", 4)
    with pytest.raises(ValueError):
        linear.fit_least_squares(rows, "y", FEATURES, ["weekday"], {})
