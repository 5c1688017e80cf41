"""Spatial operators: zones, projection, boxes, and joins by place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions import geometry as G
from trackmill.functions.near import half_up as near_half_up
from trackmill.functions.near import near_pairs
from trackmill.operators.aggregates import half_up
from trackmill.sources import views as V

H = "abcdefghi"
#: Corners of a polygon zone.
POLYGON = ((10.0, 20.0), (80.0, 60.0), (95.0, 300.0), (40.0, 450.0), (5.0, 200.0))


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def projected(rows: DataFrame, homographies: DataFrame, x: str, y: str, bound: float = 2000.0) -> DataFrame:
    """World positions by each camera's homography (one row a camera); cameras without one are left out."""
    j = rows.join(homographies, "camera")
    wx, wy = G.project([F.col(f"h_{c}") for c in H], F.col(x), F.col(y))
    j = j.withColumn("wx", wx).withColumn("wy", wy).where("wx IS NOT NULL AND NOT isnan(wx) AND NOT isnan(wy)")
    inside = F.col("wx").between(-bound, bound) & F.col("wy").between(-bound, bound)
    return j.withColumn("quality", F.when(inside, 1.0).otherwise(0.5))


def homographies(spark: SparkSession) -> DataFrame:
    return V.literal(spark, V.HOMOGRAPHIES, "camera, " + ", ".join(f"h_{c}" for c in H))


def zones(spark: SparkSession) -> DataFrame:
    return V.literal(spark, [(i, *z) for i, z in enumerate(V.ZONES)], "z_id, zone, zx1, zy1, zx2, zy2")


def grid_join(a: DataFrame, b: DataFrame, x: str, y: str, cell: float, keys: list[str]) -> DataFrame:
    """Pairs of equal keys whose cells touch: a's rows go to nine cells, then an equi-join.
    b's columns are prefixed with b_."""
    at = lambda c: F.floor(F.col(c) / cell)
    near = F.array(*[F.struct((at(x) + i).alias("gx"), (at(y) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.withColumn("g", F.explode(near)).select("*", "g.gx", "g.gy").drop("g")
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], at(x).alias("b_gx"), at(y).alias("b_gy"))
    on = [left[k] == right[f"b_{k}"] for k in keys] + [left["gx"] == right["b_gx"], left["gy"] == right["b_gy"]]
    return left.join(right, on).drop("gx", "gy", "b_gx", "b_gy")


# --- queries

def bbox_geometry(s: SparkSession, d: str) -> DataFrame:
    b = box()
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return V.detections(s, d).select("id", half_up(cx).alias("cx"), half_up(cy).alias("cy"), half_up(G.area(*b)).alias("area"), half_up(F.col("y2")).alias("foot_y"), G.quadrant(cx, cy, 1000, 600).alias("quadrant"), half_up(cx / 1000).alias("nx"), half_up(G.distance(cx, cy, F.lit(500.0), F.lit(300.0))).alias("to_centre"), half_up(G.manhattan(cx, cy, F.lit(500.0), F.lit(300.0))).alias("manhattan"))


def bbox_iou(s: SparkSession, d: str) -> DataFrame:
    """IoU of detections of one frame and camera."""
    a = V.detections(s, d).select("camera", "frame", "id", "x1", "y1", "x2", "y2")
    b = a.select("camera", "frame", *[F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    j = a.join(b, ["camera", "frame"]).where("id < b_id").withColumn("iou", G.iou(box(), box("b_")))
    return j.where("iou > 0").select("id", "b_id", half_up(F.col("iou")).alias("iou"))


def ground_truth_match(s: SparkSession, d: str) -> DataFrame:
    """Best ground truth of each detection in its frame, if IoU exceeds 0.3."""
    det = V.detections(s, d).where("id % 2 = 0").select("camera", "frame", "id", "x1", "y1", "x2", "y2")
    gt = V.detections(s, d).where("id % 2 = 1").withColumn("frame", F.col("frame") - 1).withColumn("camera", F.concat(F.lit("c0"), (F.col("id") % 4).cast("string")))
    gt = gt.select("camera", "frame", *[F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    j = det.join(gt, ["camera", "frame"]).withColumn("iou", half_up(G.iou(box(), box("b_")))).where("iou > 0.3")
    best = j.groupBy("id").agg(F.max(F.struct("iou", (-F.col("b_id")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).alias("gt_id"), F.col("b.iou").alias("iou"))


def associated(a: pd.DataFrame, b: pd.DataFrame, cell: float = 100.0, first: tuple[float, float] = (25.0, 50.0)) -> pd.DataFrame:
    """The best of b for each of a (id, x1, y1, x2, y2) in touching cells of the foot points: most overlap, then nearest centre, then
    smallest id; poor and far pairs go. Equal boxes are told once. Smaller cells come first, and are enough where the overlap is
    more than any box beyond them can have."""
    at = ["x1", "y1", "x2", "y2"]
    u, who = np.unique(a[at].to_numpy(), axis=0, return_inverse=True)
    v, same = np.unique(b[at].to_numpy(), axis=0, return_inverse=True)
    least = np.full(len(v), np.iinfo(np.int64).max)
    np.minimum.at(least, same.ravel(), b["id"].to_numpy())
    foot = lambda x: ((x[:, 0] + x[:, 2]) / 2, x[:, 3])
    size = lambda x: (x[:, 2] - x[:, 0], x[:, 3] - x[:, 1])
    (wu, hu), (wv, hv) = size(u), size(v)
    best, far, whose = np.full(len(u), -1.0), np.full(len(u), np.inf), np.full(len(u), -1)
    enough = np.full(len(u), -1.0)
    # where all boxes have an area, overlaps along an axis bound that of the boxes
    steps = [(*first, True)] if min(wu.min(), hu.min(), wv.min(), hv.min()) > 0 else []
    for cx, cy, some in [*steps, (cell, cell, False)]:
        left = np.flatnonzero((best < enough) | (best < 0))
        for i, j in near_pairs(*(x[left] for x in foot(u)), *foot(v), cx, cy):
            i = left[i]
            p, q = u[i], v[j]
            dx, dy = (p[:, 0] + p[:, 2]) / 2 - (q[:, 0] + q[:, 2]) / 2, (p[:, 1] + p[:, 3]) / 2 - (q[:, 1] + q[:, 3]) / 2
            dist = near_half_up(np.sqrt(dx * dx + dy * dy))
            both = np.maximum(np.minimum(p[:, 2], q[:, 2]) - np.maximum(p[:, 0], q[:, 0]), 0.0) * np.maximum(np.minimum(p[:, 3], q[:, 3]) - np.maximum(p[:, 1], q[:, 1]), 0.0)
            union = wu[i] * hu[i] + wv[j] * hv[j] - both
            with np.errstate(invalid="ignore", divide="ignore"):
                iou = near_half_up(np.where(union > 0, both / union, 0.0))
            fit = (iou >= 0.1) | (dist <= 96)
            i, j, iou, dist = i[fit], j[fit], iou[fit], dist[fit]
            order = np.lexsort((least[j], dist, -iou, i))
            i, j, iou, dist = i[order], j[order], iou[order], dist[order]
            new = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, dtype=bool)
            best[i[new]], far[i[new]], whose[i[new]] = iou[new], dist[new], j[new]
        if some:
            wide, high = (wu + wv.max()) / 2, np.maximum(hu, hv.max())
            enough = np.maximum(np.maximum((wide - cx) / (wide + cx), (high - cy) / high), 0.0) + 1e-5
    who = who.ravel()
    found = whose[who] >= 0
    who = who[found]
    return pd.DataFrame({"id": a["id"].to_numpy()[found], "track_id": least[whose[who]], "iou": best[who], "dist": far[who]})


def grid_associate(s: SparkSession, d: str) -> DataFrame:
    """Detections to tracks by foot point: cells of 100 pixels, then IoU, centre distance and id; poor and far pairs go."""
    odd = F.col("id") % 2 != 0
    rows = V.detections(s, d).withColumn("slot", F.floor(F.col("us") / (6 * V.HOUR))).withColumn("camera", F.when(odd, F.concat(F.lit("c0"), (F.col("id") % 4).cast("string"))).otherwise(F.col("camera")))

    def one(key, x: pd.DataFrame) -> pd.DataFrame:
        even = x["id"] % 2 == 0
        if even.all() or not even.any():
            return pd.DataFrame({"id": [], "track_id": [], "iou": [], "dist": []})
        return associated(x[even], x[~even])

    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ("x1", "y1", "x2", "y2"))).select("camera", "slot", "id", "x1", "y1", "x2", "y2")
    return whole.groupBy("camera", "slot").applyInPandas(one, "id long, track_id long, iou double, dist double")


def zone_overlap(s: SparkSession, d: str) -> DataFrame:
    b = V.detections(s, d).select("id", *[(F.col(c) / k).alias(c) for c, k in (("x1", 10), ("y1", 1), ("x2", 10), ("y2", 1))])
    j = b.crossJoin(F.broadcast(zones(s))).withColumn("r", G.overlap_ratio(box(), box("z")))
    return j.where("r > 0").select("id", "zone", half_up(F.col("r")).alias("overlap"))


def handoff_trigger(s: SparkSession, d: str) -> DataFrame:
    """The first zone that holds a box's centre and half of its area."""
    b = V.detections(s, d).select("id", "camera", *[(F.col(c) / k).alias(c) for c, k in (("x1", 10), ("y1", 1), ("x2", 10), ("y2", 1))])
    j = b.crossJoin(F.broadcast(zones(s))).withColumn("r", G.overlap_ratio(box(), box("z")))
    cx, cy = G.clamp((F.col("x1") + F.col("x2")) / 2, 0.0, 100.0), G.clamp((F.col("y1") + F.col("y2")) / 2, 0.0, 500.0)
    hit = j.where(cx.between(F.col("zx1"), F.col("zx2")) & cy.between(F.col("zy1"), F.col("zy2")) & (F.col("r") >= 0.5))
    best = hit.groupBy("id", "camera").agg(F.min("z_id").alias("z_id"))
    rules = V.literal(s, [("c01", "c02"), ("c02", "c03"), ("c03", "c04")], "p, q")
    both = rules.select(F.col("p").alias("camera"), F.col("q").alias("to")).unionByName(rules.select(F.col("q").alias("camera"), F.col("p").alias("to")))
    cand = both.groupBy("camera").agg(F.concat_ws(",", F.array_sort(F.collect_list("to"))).alias("candidates"))
    return best.join(F.broadcast(zones(s)).select("z_id", "zone"), "z_id").join(cand, "camera", "left").select("id", "zone", "candidates")


def polygon_areas(s: SparkSession, d: str) -> DataFrame:
    """Area of the polygon through each person's first points."""
    p = V.points(s, d).where("n < 6").groupBy("person").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("v"))
    return p.select("person", half_up(G.polygon_area(F.transform("v", lambda q: q["x"]), F.transform("v", lambda q: q["y"]))).alias("area"))


def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    xs, ys = (F.array(*[F.lit(p[i]) for p in POLYGON]) for i in (0, 1))
    return V.tracking_events(s, d).withColumn("i", G.in_polygon(xs, ys, F.col("x"), F.col("y"))).groupBy("camera").agg(F.count_if("i").alias("inside"), F.count("*").alias("n"))


def project_world(s: SparkSession, d: str) -> DataFrame:
    return projected(V.tracking_events(s, d), homographies(s), "x", "y", bound=400.0).select("id", half_up(F.col("wx")).alias("wx"), half_up(F.col("wy")).alias("wy"), "quality")


def inverse_project(s: SparkSession, d: str) -> DataFrame:
    """World positions back to image positions: the error of the round trip by camera."""
    p = projected(V.tracking_events(s, d), homographies(s), "x", "y")
    ix, iy = G.project(G.inverse([F.col(f"h_{c}") for c in H]), F.col("wx"), F.col("wy"))
    return p.withColumn("err", G.distance(ix, iy, F.col("x"), F.col("y"))).groupBy("camera").agg(F.count("*").alias("n"), (F.max("err") < 1e-6).alias("exact"))


def project_to_others(s: SparkSession, d: str) -> DataFrame:
    """Each world point in the image of every other camera."""
    p = projected(V.tracking_events(s, d), homographies(s), "x", "y").select("id", F.col("camera").alias("own"), "wx", "wy")
    j = p.crossJoin(F.broadcast(homographies(s))).where("camera != own")
    ix, iy = G.project(G.inverse([F.col(f"h_{c}") for c in H]), F.col("wx"), F.col("wy"))
    return j.select("id", "camera", F.round(ix, 4).alias("ix"), F.round(iy, 4).alias("iy"))


def map_bounds(s: SparkSession, d: str) -> DataFrame:
    p = projected(V.tracking_events(s, d), homographies(s), "x", "y").groupBy("camera").agg(F.min("wx").alias("a"), F.max("wx").alias("b"))
    pad = F.greatest(F.lit(1.0), (F.col("b") - F.col("a")) * 0.1)
    return p.select("camera", F.round(F.col("a") - pad, 4).alias("low"), F.round(F.col("b") + pad, 4).alias("high"))


def roi_radius(s: SparkSession, d: str) -> DataFrame:
    return V.tracking_events(s, d).select("id", half_up(G.roi_radius(F.col("y") / 100, F.col("conf"))).alias("radius"))


def geometric_match(s: SparkSession, d: str) -> DataFrame:
    """Sources to candidates of the next camera in the same hour within a radius: none, one, or the closest of several."""
    f = V.frames(s, d)
    a = f.where("camera = 'c01'").select("env", "frame", "track", "x", "y", G.roi_radius(F.lit(30.0), F.col("conf")).alias("r"))
    b = f.where("camera = 'c02'").select("env", "frame", F.col("track").alias("b_track"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = a.join(b, ["env", "frame"], "left").withColumn("dist", half_up(G.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))))
    inside = F.when(F.col("dist") <= F.col("r") * 10, F.struct("dist", "b_track"))
    m = j.groupBy("env", "frame", "track").agg(F.count(inside).alias("n"), F.min(inside).alias("b"))
    kind = F.when(F.col("n") == 0, "no_match").when(F.col("n") == 1, "exact").otherwise("closest")
    return m.select("env", "frame", "track", kind.alias("kind"), F.col("b.b_track").alias("to_track"), F.col("b.dist").alias("dist"), half_up(G.match_confidence(kind, F.col("b.dist") / 100)).alias("confidence"))


def match_metrics(s: SparkSession, d: str) -> DataFrame:
    m = geometric_match(s, d)
    return m.groupBy("env").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "closest", "no_match")], F.round(F.avg("dist"), 4).alias("avg_dist"), F.round(F.min("dist"), 4).alias("min_dist"), F.round(F.max("dist"), 4).alias("max_dist"), F.round(F.median("dist"), 4).alias("median_dist"), F.count_if(F.col("confidence") >= 0.8).alias("high"))


def heatmap_zone_buckets(s: SparkSession, d: str) -> DataFrame:
    """Counts of each zone and six-hour bucket from the first day on, empty ones included."""
    e = V.tracking_events(s, d)
    start = F.broadcast(e.agg((F.floor(F.min("us") / V.DAY) * V.DAY).alias("t0"), F.max("us").alias("t1")))
    bucket = lambda us: F.floor((F.col(us) - F.col("t0")) / (6 * V.HOUR))
    p = e.crossJoin(start).withColumn("bucket", bucket("us"))
    z = F.broadcast(zones(s))
    hit = p.join(z, (F.col("x") >= F.col("zx1")) & (F.col("x") < F.col("zx2")) & (F.col("y") >= F.col("zy1")) & (F.col("y") < F.col("zy2"))).groupBy("zone", "bucket").agg(F.count("*").alias("n"))
    every = start.select(F.explode(F.sequence(F.lit(0).cast("long"), bucket("t1"))).alias("bucket")).crossJoin(F.broadcast(zones(s).select("zone")))
    return every.join(hit, ["zone", "bucket"], "left").select("zone", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def heatmap_overall(s: SparkSession, d: str) -> DataFrame:
    h = heatmap_zone_buckets(s, d)
    return h.agg(F.sum("n").alias("total"), F.round(F.sum("n") / F.count_distinct("zone"), 1).alias("avg_per_zone"), F.min(F.struct((-F.col("n")).alias("m"), "zone", "bucket")).alias("b")).select("total", "avg_per_zone", F.col("b.zone").alias("peak_zone"), F.col("b.bucket").alias("peak_bucket"))


QUERIES = {f.__name__: f for f in (
    bbox_geometry, bbox_iou, ground_truth_match, grid_associate, zone_overlap, handoff_trigger, polygon_areas, point_in_polygon, project_world, inverse_project, project_to_others, map_bounds, roi_radius,
    geometric_match, match_metrics, heatmap_zone_buckets, heatmap_overall,
)}
D_, E_, P_, F_ = V.DETECTIONS_SQL, V.EVENTS_SQL, V.POINTS_SQL, V.FRAMES_SQL
_up = lambda x: f"floor(({x}) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"
_MACRO_IOU = "(CASE WHEN u > 0 THEN i / u ELSE 0 END)"
_inter = lambda a, b: f"greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0)"
_area = lambda a: f"({a}x2 - {a}x1) * ({a}y2 - {a}y1)"
_iou = lambda a, b: f"(CASE WHEN {_area(a)} + {_area(b)} - {_inter(a, b)} > 0 THEN ({_inter(a, b)}) / ({_area(a)} + {_area(b)} - {_inter(a, b)}) ELSE 0 END)"
_HS = f"hom(camera, {', '.join('h_' + c for c in H)}) AS (VALUES {V.values(V.HOMOGRAPHIES)})"
_W = "(h_g * x + h_h * y + h_i)"
_PROJ = f"{E_}, {_HS}, pr AS (SELECT ev.*, hom.* EXCLUDE (camera), (h_a * x + h_b * y + h_c) / {_W} AS wx, (h_d * x + h_e * y + h_f) / {_W} AS wy FROM ev JOIN hom USING (camera))"
_INV = {"w": "((h_d * h_h - h_e * h_g) * wx + (h_b * h_g - h_a * h_h) * wy + (h_a * h_e - h_b * h_d))", "x": "((h_e * h_i - h_f * h_h) * wx + (h_c * h_h - h_b * h_i) * wy + (h_b * h_f - h_c * h_e))", "y": "((h_f * h_g - h_d * h_i) * wx + (h_a * h_i - h_c * h_g) * wy + (h_c * h_d - h_a * h_f))"}
_ZN = f"zn(z_id, zone, zx1, zy1, zx2, zy2) AS (VALUES {V.values([(i, *z) for i, z in enumerate(V.ZONES)])})"
_SMALL = f"{D_}, {_ZN}, sb AS (SELECT id, camera, x1 / 10 AS x1, y1, x2 / 10 AS x2, y2 FROM det), ov AS (SELECT *, {_inter('sb.', 'z')} / ({_area('sb.')}) AS r FROM sb, zn)"
_ROI = "greatest(0.5::DOUBLE, least(10::DOUBLE, (1.5::DOUBLE + 1.5::DOUBLE * greatest(0::DOUBLE, {t})) * (1 + (1 - greatest(0::DOUBLE, least(1::DOUBLE, {q}))))))"
_MATCH = f"""{F_}, a AS (SELECT env, frame, track, x, y, {_ROI.format(t='30::DOUBLE', q='conf')} AS r FROM fr WHERE camera = 'c01'), b AS (SELECT env, frame, track AS b_track, x AS bx, y AS by_ FROM fr WHERE camera = 'c02'),
  j AS (SELECT a.*, b_track, {_up('sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_))')} AS dist FROM a LEFT JOIN b USING (env, frame)),
  m AS (SELECT env, frame, track, count(*) FILTER (dist <= r * 10) AS n, arg_min(b_track, (dist, b_track)) FILTER (dist <= r * 10) AS to_track, min(dist) FILTER (dist <= r * 10) AS dist FROM j GROUP BY ALL),
  gm AS (SELECT env, frame, track, CASE n WHEN 0 THEN 'no_match' WHEN 1 THEN 'exact' ELSE 'closest' END AS kind, to_track, dist, CASE WHEN n > 0 THEN {_up("greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN n = 1 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END - 0.1::DOUBLE * (dist / 100)))")} END AS confidence FROM m)"""
_HEAT = f"{E_}, {_ZN}, t AS (SELECT min(us) // 86400000000 * 86400000000 AS t0 FROM ev), c AS (SELECT zone, (us - t0) // 21600000000 AS bucket, count(*) AS n FROM ev, t, zn WHERE x >= zx1 AND x < zx2 AND y >= zy1 AND y < zy2 GROUP BY ALL), hm AS (SELECT z.zone, b AS bucket, coalesce(c.n, 0) AS n FROM zn z CROSS JOIN (SELECT unnest(range(0, (max(us) - min(t0)) // 21600000000 + 1)) AS b FROM ev, t) r LEFT JOIN c ON c.zone = z.zone AND c.bucket = b)"
_POLY = " + ".join(f"(CASE WHEN (({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y)) AND x < ({x2}::DOUBLE - {x1}::DOUBLE) * (y - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))
SQL = {
    "bbox_geometry": f"WITH {D_}, c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det) SELECT id, {_up('cx')} AS cx, {_up('cy')} AS cy, {_up(_area(''))} AS area, {_up('y2')} AS foot_y, CASE WHEN cy < 300 AND cx < 500 THEN 'top_left' WHEN cy < 300 THEN 'top_right' WHEN cx < 500 THEN 'bottom_left' ELSE 'bottom_right' END AS quadrant, {_up('cx / 1000')} AS nx, {_up('sqrt((cx - 500) * (cx - 500) + (cy - 300) * (cy - 300))')} AS to_centre, {_up('abs(cx - 500) + abs(cy - 300)')} AS manhattan FROM c",
    "bbox_iou": f"WITH {D_}, j AS (SELECT a.id, b.id AS b_id, {_iou('a.', 'b.')} AS iou FROM det a JOIN det b USING (camera, frame) WHERE a.id < b.id) SELECT id, b_id, {_up('iou')} AS iou FROM j WHERE iou > 0",
    "ground_truth_match": f"WITH {D_}, g AS (SELECT 'c0' || (id % 4) AS camera, frame - 1 AS frame, id, x1, y1, x2, y2 FROM det WHERE id % 2 = 1), j AS (SELECT a.id, b.id AS gt_id, {_up(_iou('a.', 'b.'))} AS iou FROM det a JOIN g b USING (camera, frame) WHERE a.id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, gt_id) AS k FROM j WHERE iou > 0.3::DOUBLE) SELECT id, gt_id, iou FROM r WHERE k = 1",
    "grid_associate": f"WITH {D_}, q AS (SELECT CASE WHEN id % 2 = 0 THEN camera ELSE 'c0' || (id % 4) END AS camera, us // 21600000000 AS slot, id, x1, y1, x2, y2, floor((x1 + x2) / 2 / 100) AS gx, floor(y2 / 100) AS gy FROM det), j AS (SELECT a.id, b.id AS track_id, {_up(_iou('a.', 'b.'))} AS iou, {_up('sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) * ((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) * ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2))')} AS dist FROM q a JOIN q b ON a.camera = b.camera AND a.slot = b.slot AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 WHERE a.id % 2 = 0 AND b.id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, dist, track_id) AS k FROM j WHERE NOT (iou < 0.1::DOUBLE AND dist > 96)) SELECT id, track_id, iou, dist FROM r WHERE k = 1",
    "zone_overlap": f"WITH {_SMALL} SELECT id, zone, {_up('r')} AS overlap FROM ov WHERE r > 0",
    "handoff_trigger": f"WITH {_SMALL}, h AS (SELECT id, camera, min(z_id) AS z_id FROM ov WHERE r >= 0.5 AND greatest(0, least(100, (x1 + x2) / 2)) BETWEEN zx1 AND zx2 AND greatest(0, least(500, (y1 + y2) / 2)) BETWEEN zy1 AND zy2 GROUP BY ALL), c(camera, candidates) AS (VALUES ('c01', 'c02'), ('c02', 'c01,c03'), ('c03', 'c02,c04'), ('c04', 'c03')) SELECT id, zone, candidates FROM h JOIN zn USING (z_id) LEFT JOIN c USING (camera)",
    "polygon_areas": f"WITH {P_}, v AS (SELECT person, n, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM pt WHERE n < 6 WINDOW w AS (PARTITION BY person ORDER BY n)) SELECT person, {_up('abs(sum(x * y1 - x1 * y ORDER BY n)) / 2')} AS area FROM v GROUP BY person",
    "point_in_polygon": f"WITH {E_} SELECT camera, count(*) FILTER (({_POLY}) % 2 = 1) AS inside, count(*) AS n FROM ev GROUP BY camera",
    "project_world": f"WITH {_PROJ} SELECT id, {_up('wx')} AS wx, {_up('wy')} AS wy, CASE WHEN wx BETWEEN -400 AND 400 AND wy BETWEEN -400 AND 400 THEN 1 ELSE 0.5 END::DOUBLE AS quality FROM pr",
    "inverse_project": f"WITH {_PROJ} SELECT camera, count(*) AS n, max(sqrt(({_INV['x']} / {_INV['w']} - x) ** 2 + ({_INV['y']} / {_INV['w']} - y) ** 2)) < 1e-6::DOUBLE AS exact FROM pr GROUP BY camera",
    "project_to_others": f"WITH {_PROJ}, o AS (SELECT id, camera AS own, wx, wy FROM pr) SELECT id, camera, round({_INV['x']} / {_INV['w']}, 4) AS ix, round({_INV['y']} / {_INV['w']}, 4) AS iy FROM o, hom WHERE camera <> own",
    "map_bounds": f"WITH {_PROJ}, m AS (SELECT camera, min(wx) AS a, max(wx) AS b FROM pr GROUP BY camera) SELECT camera, round(a - greatest(1::DOUBLE, (b - a) * 0.1::DOUBLE), 4) AS low, round(b + greatest(1::DOUBLE, (b - a) * 0.1::DOUBLE), 4) AS high FROM m",
    "roi_radius": f"WITH {E_} SELECT id, {_up(_ROI.format(t='y / 100', q='conf'))} AS radius FROM ev",
    "geometric_match": f"WITH {_MATCH} SELECT * FROM gm",
    "match_metrics": f"WITH {_MATCH} SELECT env, count(*) AS n, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'closest') AS closest, count(*) FILTER (kind = 'no_match') AS no_match, round(avg(dist), 4) AS avg_dist, round(min(dist), 4) AS min_dist, round(max(dist), 4) AS max_dist, round(median(dist), 4) AS median_dist, count(*) FILTER (confidence >= 0.8::DOUBLE) AS high FROM gm GROUP BY env",
    "heatmap_zone_buckets": f"WITH {_HEAT} SELECT zone, bucket, n FROM hm",
    "heatmap_overall": f"WITH {_HEAT} SELECT sum(n)::BIGINT AS total, round(sum(n) / count(DISTINCT zone)::DOUBLE, 1) AS avg_per_zone, arg_min(zone, (-n, zone, bucket)) AS peak_zone, arg_min(bucket, (-n, zone, bucket)) AS peak_bucket FROM hm",
}
