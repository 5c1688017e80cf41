"""Homographies out of point pairs: least squares in one pass, and consensus of seeded samples against outliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions import geometry as G
from trackmill.operators.spatial import homographies, projected
from trackmill.sources import views as V
from trackmill.sources.tables import materialise

#: Points are divided by SCALE before they are fitted; distance at which a pair still agrees; samples of four a camera.
SCALE, AGREE, SAMPLES = 100.0, 5.0, 128
NAMES = list("abcdefghi")
_TO_IMAGE = np.diag([1 / SCALE, 1 / SCALE, 1.0])


def equations(x, y, u, v) -> np.ndarray:
    """Two rows of the direct linear transform for each pair of points."""
    o, i = np.zeros_like(x), np.ones_like(x)
    return np.concatenate([np.stack([x, y, i, o, o, o, -u * x, -u * y, -u], 1), np.stack([o, o, o, x, y, i, -v * x, -v * y, -v], 1)])


def unscaled(h: np.ndarray) -> np.ndarray:
    """Nine coefficients for points as they are, the last one 1 where it isn't nothing."""
    h = np.linalg.inv(_TO_IMAGE) @ h.reshape(3, 3) @ _TO_IMAGE
    return (h / h[2, 2] if abs(h[2, 2]) > 1e-15 else h).ravel()


def fitted(points: DataFrame) -> DataFrame:
    """(camera, a to i): the homography of least squares of each camera's pairs (x, y) to (wx, wy). Each
    task adds up its pairs' normal equations, so that 81 numbers a camera and task are shuffled."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for camera, g in b.groupby("camera"):
                a = equations(*(g[c].to_numpy() / SCALE for c in ("x", "y", "wx", "wy")))
                total[camera] = total.get(camera, 0) + a.T @ a
        yield pd.DataFrame([(k, m.ravel()) for k, m in total.items()], columns=["camera", "m"])

    def solve(key, x: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.asarray(v).reshape(9, 9) for v in x["m"])
        return pd.DataFrame([(key[0], *unscaled(np.linalg.eigh(m)[1][:, 0]))], columns=["camera", *NAMES])

    rows = points.select("camera", "x", "y", "wx", "wy").dropna()
    return rows.mapInPandas(sums, "camera string, m array<double>").groupBy("camera").applyInPandas(solve, "camera string, " + ", ".join(f"{c} double" for c in NAMES))


def hypotheses(points: DataFrame, samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """(camera, sample, a to i): homographies of four pairs each. A camera's first 4 * samples pairs by the
    seeded hash of their id are dealt out by fours; these are kept within parts of a camera first, so that
    no task ranks all of its pairs. Of a camera with fewer pairs there are fewer samples, with fewer than four none."""
    most = 4 * samples
    rows = points.select("camera", "id", "x", "y", "wx", "wy").dropna().withColumn("h", F.xxhash64("id", F.lit(seed)))
    near = rows.withColumn("r", F.row_number().over(Window.partitionBy("camera", F.pmod("h", F.lit(64))).orderBy("h", "id"))).where(F.col("r") <= most)
    drawn = near.withColumn("r", F.row_number().over(Window.partitionBy("camera").orderBy("h", "id"))).where(F.col("r") <= most)

    def solve(key, g: pd.DataFrame) -> pd.DataFrame:
        g, out = g.sort_values("r"), []
        for k in range(len(g) // 4):
            four = g.iloc[4 * k : 4 * k + 4]
            h = unscaled(np.linalg.svd(equations(*(four[c].to_numpy() / SCALE for c in ("x", "y", "wx", "wy"))))[2][-1])
            if np.isfinite(h).all():
                out.append((key[0], k, *h))
        return pd.DataFrame(out, columns=["camera", "sample", *NAMES])

    return drawn.groupBy("camera").applyInPandas(solve, "camera string, sample int, " + ", ".join(f"{c} double" for c in NAMES))


def agreeing(points: DataFrame, homography: DataFrame, within: float = AGREE) -> DataFrame:
    """points with the columns of homography (by camera), where the projection is within a distance of the target."""
    wx, wy = G.project([F.col(c) for c in NAMES], F.col("x"), F.col("y"))
    return points.join(homography, "camera").where(G.distance(wx, wy, F.col("wx"), F.col("wy")) < within)


def robust(points: DataFrame, within: float = AGREE, samples: int = SAMPLES) -> DataFrame:
    """(camera, inliers, a to i): the sample whose homography most pairs agree with (the first among equals),
    fitted again on these pairs. points: camera, id, x, y, wx, wy; rows with a null are left out.
    Cameras without a sample, or with fewer than four agreeing pairs, give no row."""
    found, _ = materialise(hypotheses(points, samples))
    votes = agreeing(points, found, within).groupBy("camera", "sample").agg(F.count("*").alias("n"))
    best = votes.groupBy("camera").agg(F.max(F.struct("n", (-F.col("sample")).alias("m"))).alias("b")).where("b.n >= 4").select("camera", (-F.col("b.m")).alias("sample"), F.col("b.n").alias("inliers"))
    best, _ = materialise(found.join(best, ["camera", "sample"]))
    return best.select("camera", "inliers").join(fitted(agreeing(points, best.drop("sample", "inliers"), within)), "camera")


# --- queries

def planted(s: SparkSession, d: str) -> DataFrame:
    """Every event's point and its place on the map; three of ten places are wrong by 27 units and more."""
    p = projected(V.tracking_events(s, d), homographies(s), "x", "y").select("camera", "id", "x", "y", "wx", "wy")
    wrong = F.floor(F.col("id") / 4) % 10 < 3
    return p.withColumn("wx", F.when(wrong, F.col("wx") + 25 + F.col("id") % 41).otherwise(F.col("wx"))).withColumn("wy", F.when(wrong, F.col("wy") - 12 - F.col("id") % 53).otherwise(F.col("wy")))


def ransac_homography(s: SparkSession, d: str) -> DataFrame:
    return robust(planted(s, d)).select("camera", "inliers", *[(F.round(c, 6) + 0.0).alias(f"h_{c}") for c in NAMES])


QUERIES = {"ransac_homography": ransac_homography}
SQL = {
    "ransac_homography": f"WITH {V.EVENTS_SQL}, h(camera, a, b, c, d, e, f, g, h, i) AS (VALUES {V.values(V.HOMOGRAPHIES)}) SELECT camera, count(*) FILTER ((id // 4) % 10 >= 3) AS inliers, " + ", ".join(f"round(any_value(h.{c}), 6) AS h_{c}" for c in NAMES) + " FROM ev JOIN h USING (camera) GROUP BY camera",
}
