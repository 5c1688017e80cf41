"""Identity across cameras: pairs, assignment, conflicts, registries, nearest embeddings, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions import geometry as G
from trackmill.operators import buffers, slabs
from trackmill.operators.aggregates import half_up
from trackmill.operators.graph import connected_components
from trackmill.operators.spatial import grid_join
from trackmill.sources import views as V
from trackmill.sources.tables import table

RADIUS = 12.0


def camera_pairs(frames: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Positions of two cameras (a < b) in one frame within a radius: grid cells, then an equi-join."""
    rows = frames.select("env", "frame", "camera", "track", "x", "y")
    j = grid_join(rows, rows, "x", "y", radius, ["env", "frame"]).where("camera < b_camera")
    return j.withColumn("dist", G.distance(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))).where(F.col("dist") <= radius)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment (shortest augmenting paths); as many pairs as the smaller side has."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < low[free]
            low[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def matched(pairs: DataFrame, radius: float = RADIUS) -> DataFrame:
    """One-to-one matches of least total distance for each environment, frame and pair of cameras."""

    def one(key, x: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(x["track"]), np.unique(x["b_track"])
        cost = np.full((len(a), len(b)), 1e9)
        cost[np.searchsorted(a, x["track"]), np.searchsorted(b, x["b_track"])] = x["dist"]
        rows = [(*key, int(a[i]), int(b[j]), float(cost[i, j])) for i, j in assign(cost) if cost[i, j] <= radius]
        return pd.DataFrame(rows, columns=["env", "frame", "camera", "b_camera", "track", "b_track", "dist"])

    return pairs.groupBy("env", "frame", "camera", "b_camera").applyInPandas(one, "env string, frame long, camera string, b_camera string, track long, b_track long, dist double")


def cosine_top(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """The k most similar gallery rows of each query: q_id, g_id, sim, rank. queries and gallery have id and v."""
    return slabs.top(queries, gallery, k)


def clustered(points: DataFrame, key: str, eps: float = 0.5, least: int = 3) -> DataFrame:
    """Density clusters of each key's standardised points: pairs within eps by grid cells, core
    points by their neighbour count, components of cores; border points join the smallest one."""
    one = points.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.lit(0.0))
    p = points.join(one, key).select(key, "id", "x", "y", z("x").alias("zx"), z("y").alias("zy"))
    near = grid_join(p.select(key, "id", "zx", "zy"), p.select(key, "id", "zx", "zy"), "zx", "zy", eps, [key])
    near = near.where(G.distance(F.col("zx"), F.col("zy"), F.col("b_zx"), F.col("b_zy")) <= eps).select("id", "b_id")
    core = near.groupBy("id").count().where(F.col("count") >= least).select("id")
    edges = near.join(core, "id", "left_semi").join(core.select(F.col("id").alias("b_id")), "b_id", "left_semi").where("id != b_id")
    comp = connected_components(edges, "id", "b_id")
    member = core.join(comp, core["id"] == comp["node"], "left").select(core["id"].alias("b_id"), F.coalesce("component", core["id"]).alias("cluster"))
    own = near.join(member, "b_id").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return p.join(own, "id").select(key, "id", "x", "y", "cluster")


# --- queries

def cross_camera_pairs(s: SparkSession, d: str) -> DataFrame:
    return camera_pairs(V.frames(s, d)).select("env", "frame", "camera", "b_camera", "track", "b_track", half_up(F.col("dist")).alias("dist"))


def hungarian_match(s: SparkSession, d: str) -> DataFrame:
    return matched(camera_pairs(V.frames(s, d))).withColumn("dist", half_up(F.col("dist")))


def matched_identities(s: SparkSession, d: str) -> DataFrame:
    """Connected tracks of one environment under the smallest of their ids (a batch form without guards)."""
    m = matched(camera_pairs(V.frames(s, d)))
    c = connected_components(m.select(F.col("track").alias("a"), F.col("b_track").alias("b")), "a", "b")
    return c.select(F.col("node").alias("track"), F.concat(F.lit("P"), F.col("component").cast("string")).alias("global_id"))


def buffer_match(s: SparkSession, d: str) -> DataFrame:
    """Tracks to those of other cameras seen in the six frames before: the nearest within a radius, each claimed once."""
    f = V.frames(s, d).where("env = 'campus'")
    best = buffers.in_blocks(f, buffers.nearest, "frame long, camera string, track long, b_track long, dist double")
    claim = best.withColumn("r", F.row_number().over(Window.partitionBy("frame", "b_track").orderBy("dist", "track", "camera"))).where("r = 1")
    return claim.select("frame", "camera", "track", "b_track", "dist")


def conflict_resolve(s: SparkSession, d: str) -> DataFrame:
    """Of equal global ids at one camera and frame the most confident keeps it; the others get ids of their own."""
    f = V.frames(s, d).withColumn("gid", F.concat(F.lit("G"), (F.col("track") % 20).cast("string")))
    w = Window.partitionBy("env", "frame", "camera", "gid").orderBy(F.desc("conf"), "track")
    r = F.row_number().over(w)
    return f.withColumn("r", r).select("env", "frame", "camera", "track", F.when(F.col("r") == 1, F.col("gid")).otherwise(F.concat_ws("-", "gid", "track")).alias("gid"))


def shared_ids(s: SparkSession, d: str) -> DataFrame:
    return V.tracking_events(s, d).groupBy("person").agg(F.count_distinct("camera").alias("cameras"), F.count_distinct("camera", "track").alias("tracks")).where("cameras > 1")


def registry_lookup(s: SparkSession, d: str) -> DataFrame:
    """Events with the global id registered for their camera and track; pairs that aren't registered have none."""
    e = V.tracking_events(s, d)
    reg = e.where("track % 3 != 0").groupBy("camera", "track").agg(F.concat(F.lit("P"), F.min("track").cast("string")).alias("global_id"))
    return e.join(reg, ["camera", "track"], "left").select("id", "global_id")


def embedding_rows(s: SparkSession, d: str, kind: str = "double") -> DataFrame:
    """id, v, label; kind: of a vector's entries, which are stored as float."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("v"), "label")


def knn_handoff(s: SparkSession, d: str) -> DataFrame:
    """Entries to exits: of the five most similar, the first of another camera, seen lately and similar enough."""
    e = embedding_rows(s, d, "float")
    top = cosine_top(e.where("id % 10 = 0"), e.where("id % 10 != 0"), 5)
    fit = top.where((F.col("q_id") % 4 != F.col("g_id") % 4) & (F.abs(F.col("q_id") - F.col("g_id")) <= 400) & (F.col("sim") >= 0.2))
    best = fit.groupBy("q_id").agg(F.min(F.struct("rank", "g_id", "sim")).alias("b"))
    return best.select("q_id", F.col("b.g_id").alias("g_id"), F.round("b.sim", 6).alias("sim"), F.col("b.rank").alias("rank"))


def dbscan_areas(s: SparkSession, d: str) -> DataFrame:
    """Frequent areas of each person: centre, count and dwell of their density clusters."""
    c = clustered(V.tracking_events(s, d).select("person", "id", "x", "y"), "person")
    return c.groupBy("person", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.round(F.count("*") * 0.1, 6).alias("dwell"))


def fit_homography(s: SparkSession, d: str) -> DataFrame:
    """A homography for each camera from all its image and world points, by least squares."""
    from trackmill.operators.calibrate import fitted
    from trackmill.operators.spatial import homographies, projected

    p = projected(V.tracking_events(s, d), homographies(s), "x", "y").select("camera", "x", "y", "wx", "wy")
    fit = fitted(p)
    return p.groupBy("camera").agg(F.count("*").alias("n")).join(fit, "camera").select("camera", "n", *[(F.round(c, 6) + 0.0).alias(f"h_{c}") for c in "abcdefghi"])


QUERIES = {f.__name__: f for f in (cross_camera_pairs, hungarian_match, matched_identities, buffer_match, conflict_resolve, shared_ids, registry_lookup, knn_handoff, dbscan_areas, fit_homography)}
E_, F_ = V.EVENTS_SQL, V.FRAMES_SQL
_up = lambda x: f"floor(({x}) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"
COSINE_SQL = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), sim AS (SELECT q.id AS q_id, g.id AS g_id, q.label AS q_label, g.label AS g_label, list_cosine_similarity(q.v, g.v) AS sim FROM emb q, emb g WHERE q.id % 10 = 0 AND g.id % 10 <> 0)"
SQL = {
    "cross_camera_pairs": f"WITH {F_}, j AS (SELECT env, frame, a.camera, b.camera AS b_camera, a.track, b.track AS b_track, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM fr a JOIN fr b USING (env, frame) WHERE a.camera < b.camera) SELECT env, frame, camera, b_camera, track, b_track, {_up('dist')} AS dist FROM j WHERE dist <= 12",
    "buffer_match": f"WITH {F_}, f AS (SELECT * FROM fr WHERE env = 'campus'), j AS (SELECT a.frame, a.camera, a.track, b.track AS b_track, b.camera AS b_camera, a.frame - b.frame AS age, {_up('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} AS dist FROM f a JOIN f b ON b.frame BETWEEN a.frame - 6 AND a.frame - 1 WHERE a.camera <> b.camera AND a.track <> b.track), r AS (SELECT *, row_number() OVER (PARTITION BY frame, camera, track ORDER BY dist, b_track, b_camera, age) AS k FROM j WHERE dist <= 20), c AS (SELECT *, row_number() OVER (PARTITION BY frame, b_track ORDER BY dist, track, camera) AS m FROM r WHERE k = 1) SELECT frame, camera, track, b_track, dist FROM c WHERE m = 1",
    "conflict_resolve": f"WITH {F_}, r AS (SELECT *, 'G' || (track % 20) AS gid, row_number() OVER (PARTITION BY env, frame, camera, track % 20 ORDER BY conf DESC, track) AS k FROM fr) SELECT env, frame, camera, track, CASE WHEN k = 1 THEN gid ELSE gid || '-' || track END AS gid FROM r",
    "shared_ids": f"WITH {E_} SELECT person, count(DISTINCT camera) AS cameras, count(DISTINCT (camera, track)) AS tracks FROM ev GROUP BY person HAVING count(DISTINCT camera) > 1",
    "registry_lookup": f"WITH {E_} SELECT id, CASE WHEN track % 3 <> 0 THEN 'P' || track END AS global_id FROM ev",
    "knn_handoff": f"WITH {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) AS rank FROM sim), f AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS k FROM r WHERE rank <= 5 AND q_id % 4 <> g_id % 4 AND abs(q_id - g_id) <= 400 AND sim >= 0.2::DOUBLE) SELECT q_id, g_id, round(sim, 6) AS sim, rank FROM f WHERE k = 1",
    "fit_homography": f"WITH {E_}, h(camera, a, b, c, d, e, f, g, h, i) AS (VALUES {V.values(V.HOMOGRAPHIES)}) SELECT camera, count(*) AS n, " + ", ".join(f"round(any_value(h.{c}), 6) AS h_{c}" for c in "abcdefghi") + " FROM ev JOIN h USING (camera) GROUP BY camera",
}
