import math

import numpy as np
import pytest

from slotlake.operators import associations, profile

ROWS = [("x", "p", 1.0, None), ("x", "p", 2.0, 1), ("y", "q", 5.0, None), ("y", "q", 6.0, 2), ("y", "p", 5.5, 3), (None, "q", None, None), ("x", None, 9.0, 1)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "c string, d string, x double, k int")


def test_cramers_v_by_hand(frame):
    got = associations.cramers_v(frame, ["c", "d"]).first()
    # cells x,p 2; y,q 2; y,p 1 of five rows
    phi = 4 / (2 * 3) + 4 / (3 * 2) + 1 / (3 * 3) - 1
    assert (got.n, got.levels_a, got.levels_b) == (5, 2, 2)
    assert got.v == pytest.approx(math.sqrt((phi - 1 / 4) / (2 - 1 / 4 - 1)))
    assert associations.cramers_v(frame.where("c = 'x'"), ["c", "d"]).first().v is None
    assert associations.cramers_v(frame.limit(0), ["c", "d"]).count() == 0


def test_correlation_ratio_by_hand(frame):
    got = associations.correlation_ratios(frame, ["c"], ["x"]).first()
    a, b = np.array([1, 2, 9.0]), np.array([5, 6, 5.5])
    both = np.concatenate([a, b])
    between = sum(len(g) * (g.mean() - both.mean()) ** 2 for g in (a, b))
    assert got.n == 6 and got.ratio == pytest.approx(math.sqrt(between / ((both - both.mean()) ** 2).sum()))
    assert associations.correlation_ratios(frame.where("x = 5"), ["c"], ["x"]).first().ratio is None


def test_missing_values(frame):
    got = {r.pattern: (r.n_missing, r.n) for r in associations.missing_patterns(frame).collect()}
    assert got == {"0001": (1, 2), "0000": (0, 3), "1011": (3, 1), "0100": (1, 1)}
    pairs = {(r.a, r.b): (r.n_both, r.correlation) for r in associations.missing_correlations(frame).collect()}
    flags = np.array([[v is None for v in r] for r in ROWS], float)
    for i, a in enumerate("cdxk"):
        for j, b in enumerate("cdxk"):
            if i < j:
                assert pairs[a, b][0] == (flags[:, i] * flags[:, j]).sum()
                assert pairs[a, b][1] == pytest.approx(np.corrcoef(flags[:, i], flags[:, j])[0, 1])
    assert associations.missing_correlations(frame, ["c", "x"]).count() == 1


def test_ranks_and_rank_correlation(spark):
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 40, 500).astype(float), draw.normal(size=500)
    rows = [(float(a), float(b) + float(a) / 9, 1.0) for a, b in zip(x, y)]
    frame = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1.0, float("nan"), 1.0)], "x double, y double, z double")

    def rank(values):
        return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])

    full = np.array([r[0] for r in rows] + [1.0])
    got = {r.value: r["rank"] for r in associations.average_ranks(frame, ["x"]).collect()}
    assert got == dict(zip(full, rank(full)))
    found = {(r.a, r.b): (r.n, r.correlation) for r in associations.rank_correlations(frame, ["x", "y", "z"]).collect()}
    want = np.corrcoef(rank(np.array([r[0] for r in rows])), rank(np.array([r[1] for r in rows])))[0, 1]
    assert found["x", "y"][0] == 500 and found["x", "y"][1] == pytest.approx(want)
    assert found["x", "z"][1] is None


def test_histogram_by_spread_by_hand(spark):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 40.0, None]
    frame = spark.createDataFrame([(v, 7) for v in values], "x double, same int")
    got = {(r.column, r.bin): (r.low, r.high, r.n) for r in profile.histogram_by_spread(frame, ["x", "same"]).collect()}
    # quartiles 1.75 and 5.25, eight values: the width is 2 * 3.5 / 2
    assert got == {("x", 0): (0, 3.5, 4), ("x", 1): (3.5, 7, 3), ("x", 11): (38.5, 42, 1), ("same", 0): (7, 7, 9)}
    assert profile.histogram_by_spread(frame.limit(0), ["x", "same"]).count() == 0


def test_histogram_by_depth_with_ties(spark):
    frame = spark.createDataFrame([(v,) for v in [1, 2, 3, 3, 3, 3, 3, 8, 9, 10, None]], "x int")
    got = sorted((r.bin, r.low, r.high, r.n) for r in profile.histogram_by_depth(frame, ["x"], 5).collect())
    # edges at ranks 2, 4, 6, 8 and 10: 2, 3, 3, 8, 10
    assert got == [(1, 1, 2, 2), (2, 3, 3, 5), (4, 8, 8, 1), (5, 9, 10, 2)]
    assert profile.histogram_by_depth(frame.where("x IS NULL"), ["x"]).count() == 0
