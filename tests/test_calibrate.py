import numpy as np
import pytest

from trackmill.operators import calibrate

TRUE = np.array([[1.1, 0.2, 3.0], [-0.1, 0.9, 7.0], [0.0003, 0.0002, 1.0]])


def pairs(n, wrong, seed=4, noise=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 500, 2)
        a, b, c = TRUE @ (x, y, 1)
        u, v = a / c + rng.normal() * noise, b / c + rng.normal() * noise
        out.append(("cam", i, float(x), float(y), float(u + (60 + 3 * i) * (i < wrong)), float(v - 40 * (i < wrong)), "clash"))
    return out


SCHEMA = "camera string, id long, x double, y double, wx double, wy double, sample string"


def test_outliers_have_no_part(spark):
    rows = pairs(400, 160) + [("cam", 1000, None, 1.0, 2.0, 3.0, ""), ("few", 1, 1.0, 2.0, 3.0, 4.0, "")]
    (r,) = calibrate.robust(spark.createDataFrame(rows, SCHEMA).drop("sample")).collect()
    assert r["camera"] == "cam" and r["inliers"] == 240
    assert np.array([r[c] for c in calibrate.NAMES]) == pytest.approx(TRUE.ravel(), abs=1e-8)


def test_least_squares_is_pulled_away_and_consensus_is_not(spark):
    points = spark.createDataFrame(pairs(300, 90, noise=0.1), SCHEMA).drop("sample")
    (plain,), (good,) = calibrate.fitted(points).collect(), calibrate.robust(points).collect()
    off = lambda r: abs(np.array([r[c] for c in calibrate.NAMES]) - TRUE.ravel()).max()
    assert off(good) < 0.2 < off(plain) and good["inliers"] == 210


def test_a_pair_may_repeat_and_samples_repeat(spark):
    rows = pairs(100, 30)
    points = spark.createDataFrame(rows + rows[50:60] * 3, SCHEMA).drop("sample")
    found = [tuple(r) for r in calibrate.hypotheses(points, 16).orderBy("sample").collect()]
    assert found == [tuple(r) for r in calibrate.hypotheses(points.repartition(7), 16).orderBy("sample").collect()] and len(found) <= 16
    assert calibrate.robust(points).first()["inliers"] == 70 + 30


def test_none(spark):
    assert calibrate.robust(spark.createDataFrame([], SCHEMA).drop("sample")).count() == 0
