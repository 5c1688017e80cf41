"""Small hand-written cases: ties, pauses, borders, empty and null input."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import geometry as G
from trackmill.operators import aggregates, evaluate, graph, identity, maintenance, scans, sequence


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def track(spark, xy, step=1_000_000, person="P1"):
    return spark.createDataFrame([(person, i, i, i * step, float(x), float(y), 0.5, "c01") for i, (x, y) in enumerate(xy)], "person string, n long, id long, us long, x double, y double, conf double, camera string")


def lit(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_boxes(spark):
    r = one(spark, G.iou(lit(0, 0, 10, 10), lit(10, 0, 20, 10)).alias("touch"), G.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0)).alias("none"), G.iou(lit(0, 0, 10, 10), lit(5, 0, 15, 10)).alias("half"), G.overlap_ratio(lit(0, 450, 100, 550), lit(50, 0, 1000, 1000)).alias("zone"))
    assert (r.touch, r.none, round(r.half, 9), r.zone) == (0, 0, round(1 / 3, 9), 0.5)


@pytest.mark.parametrize("t, q, want", [(0, 1, 1.5), (10, 1, 10), (0, 0.5, 2.25), (-5, 2, 1.5)])
def test_roi(spark, t, q, want):
    assert one(spark, G.roi_radius(F.lit(float(t)), F.lit(float(q))).alias("r")).r == want


def test_polygons(spark):
    xs, ys = F.array(*lit(0, 4, 4, 0)), F.array(*lit(0, 0, 3, 3))
    r = one(spark, G.polygon_area(xs, ys).alias("a"), G.in_polygon(xs, ys, *lit(1, 1)).alias("i"), G.in_polygon(xs, ys, *lit(5, 1)).alias("o"))
    assert (r.a, r.i, r.o) == (12, True, False)


def test_projection_round_trip(spark):
    h = lit(1, 0.1, 5, 0.05, 1.1, -3, 0.0001, 0.0002, 1)
    w = G.project(h, *lit(12, 34))
    back = G.project(G.inverse(h), *w)
    r = one(spark, back[0].alias("x"), back[1].alias("y"), G.project(lit(1, 0, 0, 0, 1, 0, 0, 0, 0), *lit(1, 1))[0].alias("none"))
    assert abs(r.x - 12) < 1e-9 and abs(r.y - 34) < 1e-9 and r.none is None


def test_match_confidence(spark):
    r = one(spark, *[G.match_confidence(F.lit(k), F.lit(1.0)).alias(k) for k in ("exact", "closest", "no_match")])
    assert (round(r.exact, 9), round(r.closest, 9), r.no_match) == (0.85, 0.6, None)


def test_turn_is_carried_over_a_pause(spark):
    r = sequence.turns(track(spark, [(0, 0), (1, 0), (1, 0), (1, 1)])).first()
    assert (r.turns, r.points, round(r.complexity, 9)) == (1, 4, round(1 / 3, 9))


def test_constant_speed_is_no_anomaly(spark):
    assert sequence.anomalies_of(track(spark, [(i, 0) for i in range(5)])).first().score == 0
    assert sequence.predicted(track(spark, [(i, 0) for i in range(4)])).count() == 0
    p = {r.t: r for r in sequence.predicted(track(spark, [(i, 0) for i in range(5)])).collect()}
    assert round(p[1].confidence, 6) == 0.973333 and round(p[30].confidence, 6) == 0.2 and (p[3].x, p[3].y) == (7, 0)


def test_interpolation_and_smoothing(spark):
    rows = sequence.interpolated(track(spark, [(0, 0), (4, 8)]), 0.25).where("interpolated").orderBy("j").collect()
    assert [(r.x, r.y, r.us) for r in rows] == [(1, 2, 250_000), (2, 4, 500_000), (3, 6, 750_000)]
    s = sequence.smoothed(track(spark, [(i * i, 0) for i in range(6)])).orderBy("n").collect()
    assert [r.sx for r in s] == [0, 1, 6, 11, 16, 25]


def test_velocities(spark):
    v = sequence.velocities(track(spark, [(0, 0), (1, 0), (4, 0)])).orderBy("n").collect()
    assert [r.vx for r in v] == [1, 2, 3]
    assert [r.vx for r in sequence.velocities(track(spark, [(0, 0), (1, 0)], step=0)).collect()] == [0, 0]


def test_upper_median_and_dwell(spark):
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate([10, 20, 30, 40])], "camera string, person int, dwell_s double")
    r = aggregates.dwell_summary(df).first()
    assert (r.median_s, r.avg_s, r.n_class0, r.pct_class0) == (30, 25, 4, 100)


def test_deduplicated_prefers_the_cache(spark):
    a = spark.createDataFrame([(1, "p", "c", 9, "cache")], "us long, person string, camera string, id long, tag string")
    b = spark.createDataFrame([(1, "p", "c", 2, "db"), (2, "p", "c", 3, "db")], a.schema)
    assert sorted((r.us, r.id, r.tag) for r in scans.deduplicated(a, b).collect()) == [(1, 9, "cache"), (2, 3, "db")]


def test_edges_and_cameras(spark):
    r = one(spark, scans.near_edge(F.lit(1.0), F.lit(50.0), 100, 100, 0.05).alias("near"), scans.near_edge(F.lit(1.0), F.lit(50.0), 100, 100, 0).alias("off"), *[scans.camera_of(F.lit(x)).alias(f"v{i}") for i, x in enumerate(["c07", "/x/c12/y", "cam 3", "none"])])
    assert tuple(r) == (True, False, "c07", "c12", "c03", None)


def test_filters_take_zero_as_a_value(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.5)], "us long, conf double")
    assert df.where(scans.wanted(end=0)).count() == 1 and df.where(scans.wanted(least_conf=0.0)).count() == 2 and df.where(scans.wanted()).count() == 2


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 6)):
        c = rng.integers(0, 20, size=(n, m)).astype(float)
        got = identity.assign(c)
        small, large = min(n, m), max(n, m)
        t = c if n <= m else c.T
        best = min(sum(t[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        assert len(got) == small and sum(c[i, j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == small


def test_clusters(spark):
    rng = np.random.default_rng(1)
    pts = [(0 + 0.01 * a, 0 + 0.01 * b) for a, b in rng.normal(size=(8, 2))] + [(10 + 0.01 * a, 10 + 0.01 * b) for a, b in rng.normal(size=(6, 2))] + [(5.0, -40.0)]
    got = identity.clustered(track(spark, pts).select("person", "id", "x", "y"), "person").groupBy("cluster").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 8), (8, 6)]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (5, 5), (None, 3)], "src long, dst long")
    got = sorted(tuple(r) for r in graph.connected_components(e).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10)]
    assert graph.connected_components(e.limit(0)).count() == 0
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(chain).agg(F.max("component")).first()[0] == 0


def test_second_prediction_of_a_truth_is_false(spark):
    schema = "camera string, frame long, id long, conf double, x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([("c", 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("c", 1, 2, 0.8, 0.0, 0.0, 10.0, 11.0)], schema)
    t = spark.createDataFrame([("c", 1, 7, 1.0, 0.0, 0.0, 10.0, 10.0)], schema)
    r = evaluate.average_precision(p, t).first()
    assert (r.ap, r.tp, r.predictions) == (1.0, 1, 2)


def test_retention_border(spark):
    day = 86_400_000_000
    rows = spark.createDataFrame([("x", 0, 90 * day), ("x", 1, 90 * day), ("factory", 30 * day, 90 * day)], "env string, us long, as_of long")
    p = spark.createDataFrame([("default", 90, 30, 7), ("factory", 60, 15, 3)], "env string, del int, arc int, com int")
    assert sorted(r["class"] for r in maintenance.classified(rows, p).collect()) == ["archive", "delete", "delete"]
