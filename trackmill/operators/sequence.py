"""Operators over the ordered points of a track: one window by person, in time order, ties by id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.operators.scans import last_n
from trackmill.sources import views as V

TURN, PAUSE = math.pi / 4, 5.0


def _w(key: str = "person") -> Window:
    return Window.partitionBy(key).orderBy("n")


def steps(points: DataFrame) -> DataFrame:
    """Points with the step from the one before: dx, dy, dist, dt (seconds)."""
    w = _w()
    p = points.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w)).withColumn("dt", (F.col("us") - F.lag("us").over(w)) / 1e6)
    return p.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def wrapped(angle: Column) -> Column:
    """The size of a change of heading, at most pi."""
    a = F.abs(angle)
    return F.when(a > math.pi, 2 * math.pi - a).otherwise(a)


def velocities(points: DataFrame) -> DataFrame:
    """vx, vy: central difference, forward at the first point, backward at the last; zero where no time passes."""
    w = _w()
    around = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    p = points.withColumn("dt", around("us") / 1e6)
    v = lambda c: F.when(F.col("dt") > 0, around(c) / F.col("dt")).otherwise(F.lit(0.0))
    return p.withColumn("vx", v("x")).withColumn("vy", v("y"))


def turns(points: DataFrame) -> DataFrame:
    """Heading changes above a quarter of pi, over n - 1: steps of no length are left out, so that
    the heading before them is carried on."""
    st = steps(points)
    moving = st.where("dist > 0").withColumn("heading", F.atan2("dy", "dx"))
    change = wrapped(F.col("heading") - F.lag("heading").over(_w()))
    t = moving.withColumn("turn", change > TURN).groupBy("person").agg(F.count_if("turn").alias("turns"))
    n = points.groupBy("person").agg(F.count("*").alias("points"))
    return n.join(t, "person", "left").select("person", "points", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"), (F.coalesce("turns", F.lit(0)) / F.greatest(F.lit(1), F.col("points") - 1)).alias("complexity"))


def speeds(points: DataFrame) -> DataFrame:
    """Speed statistics of each person over steps that take time."""
    st = steps(points).where("dt > 0").withColumn("speed", F.col("dist") / F.col("dt"))
    return st.groupBy("person").agg(F.avg("speed").alias("mean"), F.median("speed").alias("median"), F.coalesce(F.stddev_samp("speed"), F.lit(0.0)).alias("std"), F.min("speed").alias("min"), F.max("speed").alias("max"), F.count("*").alias("n"))


def anomalies_of(points: DataFrame, least: int = 5) -> DataFrame:
    """Anomaly score: the mean of a speed factor and a turning factor, each if it applies; 0 with few points."""
    both = turns(points).join(speeds(points), "person", "left")
    f1 = F.when(F.col("std") > 0, F.least(F.col("max") / (F.col("mean") + F.col("std")) / 3, F.lit(1.0)))
    f2 = F.when(F.col("complexity") > 0.3, F.least(F.col("complexity") / 0.5, F.lit(1.0)))
    factors = F.filter(F.array(f1, f2), lambda x: x.isNotNull())
    mean = F.when(F.size(factors) > 0, F.aggregate(factors, F.lit(0.0), lambda a, x: a + x) / F.size(factors)).otherwise(F.lit(0.0))
    return both.withColumn("score", F.when(F.col("points") >= least, mean).otherwise(F.lit(0.0)))


def profiles(points: DataFrame, pause: float = PAUSE, least_s: float = 5.0) -> DataFrame:
    """Behaviour profile of each person that was tracked for least_s seconds."""
    st = steps(points)
    one = st.groupBy("person").agg(((F.max("us") - F.min("us")) / 1e6).alias("tracked_s"), F.sum(F.when(F.col("dist") < pause, F.col("dt")).otherwise(F.lit(0.0))).alias("dwell_s"), F.concat_ws(",", F.sort_array(F.collect_set("camera"))).alias("cameras"), F.coalesce(F.sum("dist"), F.lit(0.0)).alias("path"))
    return one.join(anomalies_of(points), "person").where(F.col("tracked_s") >= least_s)


def predicted(points: DataFrame, horizon: int = 30, last: int = 5) -> DataFrame:
    """Straight-line prediction from the last points' mean velocity, with falling confidence."""
    st = steps(last_n(points, ["person"], last))
    end = F.max(F.struct("n", "x", "y")).alias("e")
    v = st.groupBy("person").agg(F.count("*").alias("k"), F.avg(F.when(F.col("dt") > 0, F.col("dx") / F.col("dt"))).alias("vx"), F.avg(F.when(F.col("dt") > 0, F.col("dy") / F.col("dt"))).alias("vy"), end).where(F.col("k") >= last)
    rows = v.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("person", F.col("t").cast("long").alias("t"), (F.col("e.x") + zero("vx") * F.col("t")).alias("x"), (F.col("e.y") + zero("vy") * F.col("t")).alias("y"), F.greatest(F.lit(0.1), 1 - 0.8 * F.col("t") / horizon).alias("confidence"))


def smoothed(points: DataFrame, width: int = 5) -> DataFrame:
    """Centred moving average; the points near either end stay as they are."""
    half = width // 2
    w = _w()
    total = F.count("*").over(Window.partitionBy("person"))
    inner = (F.col("n") >= half) & (F.col("n") < total - half)
    mean = lambda c: F.when(inner, F.avg(c).over(w.rowsBetween(-half, half))).otherwise(F.col(c))
    return points.withColumn("sx", mean("x")).withColumn("sy", mean("y"))


def interpolated(points: DataFrame, seconds: float) -> DataFrame:
    """Points and, in each gap, those that a regular rate of one in `seconds` would add."""
    w = _w()
    p = points.withColumn("u1", F.lead("us").over(w)).withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).withColumn("c1", F.lead("conf").over(w))
    k = ((F.col("u1") - F.col("us")) / 1e6 / seconds).cast("long")
    gaps = p.withColumn("k", k).where("k > 1").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") - 1)))
    part = F.col("j") / F.col("k")
    between = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * part
    added = gaps.select("person", "n", "j", between("us", "u1").cast("long").alias("us"), between("x", "x1").alias("x"), between("y", "y1").alias("y"), F.least("conf", "c1").alias("conf"), F.lit(True).alias("interpolated"))
    return points.select("person", "n", F.lit(0).cast("long").alias("j"), "us", "x", "y", "conf", F.lit(False).alias("interpolated")).unionByName(added)


# --- queries

def speed_stats(s: SparkSession, d: str) -> DataFrame:
    r = speeds(V.points(s, d))
    return r.select("person", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


def dwell_motion(s: SparkSession, d: str) -> DataFrame:
    return steps(V.points(s, d)).groupBy("person").agg(F.round(F.sum(F.when(F.col("dist") < PAUSE, F.col("dt")).otherwise(F.lit(0.0))), 3).alias("dwell_s"), F.round((F.max("us") - F.min("us")) / 1e6, 3).alias("tracked_s"))


def path_complexity(s: SparkSession, d: str) -> DataFrame:
    return turns(V.points(s, d)).select("person", "points", "turns", F.round("complexity", 6).alias("complexity"))


def anomaly_score(s: SparkSession, d: str) -> DataFrame:
    return anomalies_of(V.points(s, d)).select("person", F.round("score", 6).alias("score"))


def behavior_profile(s: SparkSession, d: str) -> DataFrame:
    p = profiles(V.points(s, d))
    return p.select("person", "cameras", "turns", *[F.round(c, 4).alias(c) for c in ("tracked_s", "dwell_s", "path", "mean", "score")], (F.round("score", 6) > 0.7).alias("anomalous"))


def anomalies(s: SparkSession, d: str) -> DataFrame:
    """Anomalous persons among the active ones."""
    from trackmill.operators.scans import active

    now = active(V.tracking_events(s, d), V.DAY).select("person")
    p = V.points(s, d).join(now, "person", "left_semi")
    return anomalies_of(p).where(F.round("score", 6) > 0.6).select("person", F.round("score", 6).alias("score"))


def predict_path(s: SparkSession, d: str) -> DataFrame:
    return predicted(V.points(s, d)).select("person", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("confidence", 6).alias("confidence"))


def velocities_of_points(s: SparkSession, d: str) -> DataFrame:
    v = velocities(V.points(s, d))
    return v.select("id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"), F.round(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), 6).alias("speed"))


def smooth_track(s: SparkSession, d: str) -> DataFrame:
    return smoothed(V.points(s, d)).select("id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


def smoothness(s: SparkSession, d: str) -> DataFrame:
    """1 less the mean change of direction over pi; 1 for fewer than three points."""
    st = steps(V.points(s, d)).withColumn("h", F.atan2("dy", "dx")).withColumn("h0", F.lag("h").over(_w())).withColumn("d0", F.lag("dist").over(_w()))
    change = F.when(F.col("d0") > 0, wrapped(F.col("h") - F.col("h0")))
    return st.groupBy("person").agg(F.round(F.greatest(F.lit(0.0), 1 - F.coalesce(F.avg(change), F.lit(0.0)) / math.pi), 6).alias("smoothness"))


def completeness(s: SparkSession, d: str) -> DataFrame:
    r = V.points(s, d).groupBy("person").agg(F.count("*").alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("s"))
    want = (F.col("s") / 3600).cast("long")
    return r.select("person", F.round(F.when(want > 0, F.least(F.lit(1.0), F.col("n") / want)).otherwise(F.lit(1.0)), 6).alias("completeness"))


def interpolate_track(s: SparkSession, d: str) -> DataFrame:
    return interpolated(V.points(s, d), 3600.0).select("person", "n", "j", "us", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("x", "y", "conf")], "interpolated")


def path_length(s: SparkSession, d: str) -> DataFrame:
    st = steps(V.points(s, d))
    return st.groupBy("person").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("dist"), F.lit(0.0)), 4).alias("path"), F.round(F.max(F.when(F.col("dt") > 0, F.col("dist") / F.col("dt"))), 6).alias("max_speed"), F.round((F.max("us") - F.min("us")) / 1e6, 3).alias("seconds"))


def trail_last3(s: SparkSession, d: str) -> DataFrame:
    return last_n(V.tracking_events(s, d), ["camera", "track"], 3).select("camera", "track", F.col("back").alias("frame_offset"), "id", "x", "y")


def trail_expiry(s: SparkSession, d: str) -> DataFrame:
    """Trails whose newest point is not older than a span, with their sizes."""
    from trackmill.operators.scans import with_as_of

    t = with_as_of(V.tracking_events(s, d)).groupBy("camera", "track").agg(F.count("*").alias("n"), F.max("us").alias("us"), F.max("as_of").alias("as_of"))
    return t.where(F.col("us") >= F.col("as_of") - V.DAY).groupBy("camera").agg(F.count("*").alias("trails"), F.sum("n").alias("points"))


def camera_transitions(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("person").orderBy("us", "id")
    e = V.tracking_events(s, d).withColumn("from_camera", F.lag("camera").over(w)).withColumn("since", F.lag("us").over(w))
    return e.where("from_camera != camera").select("person", "id", "from_camera", F.col("camera").alias("to_camera"), "us", F.round((F.col("us") - F.col("since")) / 1e6, 6).alias("gap_s"))


def corridors(s: SparkSession, d: str) -> DataFrame:
    t = camera_transitions(s, d)
    return t.groupBy("from_camera", "to_camera").agg(F.count("*").alias("n"), F.round(F.avg("gap_s"), 4).alias("avg_gap_s"))


def zone_state(s: SparkSession, d: str) -> DataFrame:
    """Entry, stay and exit of a zone for each person."""
    inside = (F.col("x") < 50) & (F.col("y") < 125)
    p = V.points(s, d).withColumn("inside", inside).withColumn("was", F.coalesce(F.lag("inside").over(_w()), F.lit(False)))
    state = F.when(F.col("inside") & ~F.col("was"), "entry").when(F.col("inside"), "in_zone").when(F.col("was"), "exit")
    return p.withColumn("state", state).where("state IS NOT NULL").select("person", "id", "state")


def data_gaps(s: SparkSession, d: str) -> DataFrame:
    """Gaps above six hours at each camera, and days without any event of it."""
    w = Window.partitionBy("camera").orderBy("us", "id")
    g = V.tracking_events(s, d).withColumn("since", F.lag("us").over(w)).where(F.col("us") - F.col("since") > 6 * V.HOUR)
    return g.select("camera", "since", F.col("us").alias("until"), F.round((F.col("us") - F.col("since")) / 3.6e9, 6).alias("hours"))


def missing_days(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d).select("person", F.floor(F.col("us") / V.DAY).alias("day"))
    span = e.groupBy("person").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return span.select("person", F.explode(F.sequence("a", "b")).alias("day")).join(e.distinct(), ["person", "day"], "left_anti")


def available_ranges(s: SparkSession, d: str) -> DataFrame:
    return V.tracking_events(s, d).groupBy("env").agg(F.min("us").alias("earliest"), F.max("us").alias("latest"), F.count_distinct("session").alias("days"), (F.count("*") > 0).alias("has_data"))


def peak_bucket(s: SparkSession, d: str) -> DataFrame:
    h = V.tracking_events(s, d).groupBy("camera", F.floor(F.col("us") / V.HOUR).alias("hour")).agg(F.count("*").alias("n"))
    best = h.groupBy("camera").agg(F.min(F.struct((-F.col("n")).alias("m"), "hour")).alias("b"))
    return best.select("camera", F.col("b.hour").alias("hour"), (-F.col("b.m")).alias("n"))


def alerts_episodes(s: SparkSession, d: str) -> DataFrame:
    """Episodes of values above a threshold: raised, rows while open, cleared, duration."""
    w = Window.partitionBy("person").orderBy("n")
    p = V.points(s, d).withColumn("high", F.col("x") >= 60).withColumn("new", (F.col("high") & ~F.coalesce(F.lag("high").over(w), F.lit(False))).cast("long")).withColumn("episode", F.sum("new").over(w)).where("episode > 0")
    clear = F.min(F.when(~F.col("high"), F.col("us"))).alias("cleared")
    g = p.groupBy("person", "episode").agg(F.min("us").alias("raised"), F.count_if("high").alias("updates"), clear, F.max("x").alias("worst"))
    return g.select("person", "episode", "raised", "updates", "cleared", "worst", F.round((F.col("cleared") - F.col("raised")) / 1e6, 6).alias("seconds"))


def session_activity(s: SparkSession, d: str) -> DataFrame:
    """Sessions of a person: a gap above six hours begins a new one."""
    w = Window.partitionBy("person").orderBy("n")
    p = V.points(s, d).withColumn("k", F.sum((F.coalesce(F.col("us") - F.lag("us").over(w) > 6 * V.HOUR, F.lit(True))).cast("long")).over(w))
    return p.groupBy("person", "k").agg(F.count("*").alias("n"), F.min("us").alias("start"), F.max("us").alias("end"))


def focus_state(s: SparkSession, d: str) -> DataFrame:
    """Field-wise latest values that are not null, and the time since the first."""
    w = Window.partitionBy("person").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    p = V.points(s, d).withColumn("mark", F.when(F.col("id") % 5 == 0, F.col("event_type")))
    return p.select("id", F.last("mark", ignorenulls=True).over(w).alias("mark"), F.round((F.col("us") - F.min("us").over(w)) / 1e6, 3).alias("since_s"))


QUERIES = {f.__name__: f for f in (
    speed_stats, dwell_motion, path_complexity, anomaly_score, behavior_profile, anomalies, predict_path, velocities_of_points, smooth_track, smoothness, completeness, interpolate_track, path_length, trail_last3,
    trail_expiry, camera_transitions, corridors, zone_state, data_gaps, missing_days, available_ranges, peak_bucket, alerts_episodes, session_activity, focus_state,
)}
P_, E_ = V.POINTS_SQL, V.EVENTS_SQL
_STEPS = P_ + """, s0 AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, (us - lag(us) OVER w) / 1e6 AS dt FROM pt WINDOW w AS (PARTITION BY person ORDER BY n)),
  st AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM s0)"""
_TURNS = _STEPS + f""", mv AS (SELECT person, atan2(dy, dx) - lag(atan2(dy, dx)) OVER (PARTITION BY person ORDER BY n) AS c FROM st WHERE dist > 0),
  tn AS (SELECT person, count(*) FILTER (CASE WHEN abs(c) > pi() THEN 2 * pi() - abs(c) ELSE abs(c) END > pi() / 4) AS turns FROM mv GROUP BY person),
  tu AS (SELECT p.person, points, coalesce(turns, 0) AS turns, coalesce(turns, 0) / greatest(1, points - 1)::DOUBLE AS complexity FROM (SELECT person, count(*) AS points FROM pt GROUP BY person) p LEFT JOIN tn USING (person)),
  sp AS (SELECT person, avg(dist / dt) AS mean, median(dist / dt) AS median, coalesce(stddev_samp(dist / dt), 0) AS std, min(dist / dt) AS min, max(dist / dt) AS max, count(*) AS n FROM st WHERE dt > 0 GROUP BY person),
  ff AS (SELECT tu.*, sp.mean, CASE WHEN std > 0 THEN least(max / (mean + std) / 3, 1) END AS f1, CASE WHEN complexity > 0.3::DOUBLE THEN least(complexity / 0.5::DOUBLE, 1) END AS f2 FROM tu LEFT JOIN sp USING (person)),
  an AS (SELECT *, CASE WHEN points < 5 THEN 0 ELSE coalesce((coalesce(f1, 0) + coalesce(f2, 0)) / nullif((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT, 0), 0) END::DOUBLE AS score FROM ff)"""
_TRANS = f"{E_}, tr AS (SELECT person, id, lag(camera) OVER w AS from_camera, camera AS to_camera, us, round((us - lag(us) OVER w) / 1e6, 6) AS gap_s FROM ev WINDOW w AS (PARTITION BY person ORDER BY us, id))"
SQL = {
    "speed_stats": f"WITH {_TURNS} SELECT person, n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max FROM sp",
    "dwell_motion": f"WITH {_STEPS} SELECT person, round(coalesce(sum(dt) FILTER (dist < 5), 0), 3)::DOUBLE AS dwell_s, round((max(us) - min(us)) / 1e6, 3) AS tracked_s FROM st GROUP BY person",
    "path_complexity": f"WITH {_TURNS} SELECT person, points, turns, round(complexity, 6) AS complexity FROM tu",
    "anomaly_score": f"WITH {_TURNS} SELECT person, round(score, 6) AS score FROM an",
    "behavior_profile": f"WITH {_TURNS}, o AS (SELECT person, (max(us) - min(us)) / 1e6 AS tracked_s, coalesce(sum(dt) FILTER (dist < 5), 0) AS dwell_s, array_to_string(list_sort(list_distinct(list(camera))), ',') AS cameras, coalesce(sum(dist), 0) AS path FROM st GROUP BY person) SELECT person, cameras, turns, round(tracked_s, 4) AS tracked_s, round(dwell_s, 4)::DOUBLE AS dwell_s, round(path, 4) AS path, round(mean, 4) AS mean, round(score, 4) AS score, round(score, 6) > 0.7::DOUBLE AS anomalous FROM o JOIN an USING (person) WHERE tracked_s >= 5",
    "anomalies": f"WITH {_TURNS} SELECT person, round(score, 6) AS score FROM an WHERE round(score, 6) > 0.6::DOUBLE AND person IN (SELECT person FROM ev GROUP BY person HAVING max(us) >= (SELECT max(us) FROM ev) - 86400000000)",
    "predict_path": f"WITH {P_}, l AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY us DESC, id DESC) AS r FROM pt), q AS (SELECT person, n, x, y, us, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, (us - lag(us) OVER w) / 1e6 AS dt FROM l WHERE r <= 5 WINDOW w AS (PARTITION BY person ORDER BY n)), v AS (SELECT person, coalesce(avg(dx / dt) FILTER (dt > 0), 0) AS vx, coalesce(avg(dy / dt) FILTER (dt > 0), 0) AS vy, arg_max(x, n) AS ex, arg_max(y, n) AS ey FROM q GROUP BY person HAVING count(*) >= 5) SELECT person, t, round(ex + vx * t, 6) AS x, round(ey + vy * t, 6) AS y, round(greatest(0.1::DOUBLE, 1 - 0.8::DOUBLE * t / 30), 6) AS confidence FROM v, range(1, 31) r(t)",
    "velocities_of_points": "WITH " + P_ + """, nb AS (SELECT *, lag(us) OVER w AS u0, lead(us) OVER w AS u1, lag(x) OVER w AS x0, lead(x) OVER w AS x1, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY person ORDER BY n)),
  v AS (SELECT id, (coalesce(u1, us) - coalesce(u0, us)) / 1e6 AS dt, coalesce(x1, x) - coalesce(x0, x) AS dx, coalesce(y1, y) - coalesce(y0, y) AS dy FROM nb), q AS (SELECT id, CASE WHEN dt > 0 THEN dx / dt ELSE 0 END AS vx, CASE WHEN dt > 0 THEN dy / dt ELSE 0 END AS vy FROM v) SELECT id, round(vx, 6) AS vx, round(vy, 6) AS vy, round(sqrt(vx * vx + vy * vy), 6) AS speed FROM q""",
    "smooth_track": f"WITH {P_}, m AS (SELECT *, count(*) OVER (PARTITION BY person) AS c, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM pt WINDOW w AS (PARTITION BY person ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT id, round(CASE WHEN n >= 2 AND n < c - 2 THEN mx ELSE x END, 6) AS sx, round(CASE WHEN n >= 2 AND n < c - 2 THEN my ELSE y END, 6) AS sy FROM m",
    "smoothness": f"WITH {_STEPS}, h AS (SELECT person, lag(dist) OVER w AS d0, abs(atan2(dy, dx) - lag(atan2(dy, dx)) OVER w) AS c FROM st WINDOW w AS (PARTITION BY person ORDER BY n)) SELECT person, round(greatest(0::DOUBLE, 1 - coalesce(avg(CASE WHEN c > pi() THEN 2 * pi() - c ELSE c END) FILTER (d0 > 0), 0) / pi()), 6) AS smoothness FROM h GROUP BY person",
    "completeness": f"WITH {E_}, r AS (SELECT person, count(*) AS n, floor((max(us) - min(us)) / 1e6 / 3600)::BIGINT AS want FROM ev GROUP BY person) SELECT person, round(CASE WHEN want > 0 THEN least(1::DOUBLE, n / want::DOUBLE) ELSE 1 END, 6)::DOUBLE AS completeness FROM r",
    "interpolate_track": f"WITH {P_}, l AS (SELECT *, lead(us) OVER w AS u1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(conf) OVER w AS c1 FROM pt WINDOW w AS (PARTITION BY person ORDER BY n)), g AS (SELECT *, floor((u1 - us) / 1e6 / 3600)::BIGINT AS k FROM l), a AS (SELECT *, unnest(range(1, k)) AS j FROM g WHERE k > 1) SELECT person, n, 0::BIGINT AS j, us, floor(x * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS x, floor(y * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS y, floor(conf * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS conf, false AS interpolated FROM pt UNION ALL SELECT person, n, j, floor(us + (u1 - us) * (j / k::DOUBLE))::BIGINT, floor((x + (x1 - x) * (j / k::DOUBLE)) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE, floor((y + (y1 - y) * (j / k::DOUBLE)) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE, floor(least(conf, c1) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE, true FROM a",
    "path_length": f"WITH {_STEPS} SELECT person, count(*) AS n, round(coalesce(sum(dist), 0), 4) AS path, round(max(dist / dt) FILTER (dt > 0), 6) AS max_speed, round((max(us) - min(us)) / 1e6, 3) AS seconds FROM st GROUP BY person",
    "trail_last3": f"WITH {E_}, l AS (SELECT *, row_number() OVER (PARTITION BY camera, track ORDER BY us DESC, id DESC) AS r FROM ev) SELECT camera, track, 1 - r AS frame_offset, id, x, y FROM l WHERE r <= 3",
    "trail_expiry": f"WITH {E_}, t AS (SELECT camera, track, count(*) AS n, max(us) AS us FROM ev GROUP BY ALL) SELECT camera, count(*) AS trails, sum(n)::BIGINT AS points FROM t WHERE us >= (SELECT max(us) FROM ev) - 86400000000 GROUP BY camera",
    "camera_transitions": f"WITH {_TRANS} SELECT * FROM tr WHERE from_camera <> to_camera",
    "corridors": f"WITH {_TRANS} SELECT from_camera, to_camera, count(*) AS n, round(avg(gap_s), 4) AS avg_gap_s FROM tr WHERE from_camera <> to_camera GROUP BY ALL",
    "zone_state": f"WITH {P_}, z AS (SELECT *, x < 50 AND y < 125 AS i, coalesce(lag(x < 50 AND y < 125) OVER (PARTITION BY person ORDER BY n), false) AS w FROM pt) SELECT person, id, CASE WHEN i AND NOT w THEN 'entry' WHEN i THEN 'in_zone' ELSE 'exit' END AS state FROM z WHERE i OR w",
    "data_gaps": f"WITH {E_}, g AS (SELECT camera, lag(us) OVER (PARTITION BY camera ORDER BY us, id) AS since, us FROM ev) SELECT camera, since, us AS until, round((us - since) / 3.6e9, 6) AS hours FROM g WHERE us - since > 21600000000",
    "missing_days": f"WITH {E_}, e AS (SELECT DISTINCT person, us // 86400000000 AS day FROM ev), a AS (SELECT person, unnest(range(min(day), max(day) + 1)) AS day FROM e GROUP BY person) SELECT * FROM a ANTI JOIN e USING (person, day)",
    "available_ranges": f"WITH {E_} SELECT env, min(us) AS earliest, max(us) AS latest, count(DISTINCT session) AS days, count(*) > 0 AS has_data FROM ev GROUP BY env",
    "peak_bucket": f"WITH {E_}, h AS (SELECT camera, us // 3600000000 AS hour, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY n DESC, hour) AS k FROM h) SELECT camera, hour, n FROM r WHERE k = 1",
    "alerts_episodes": f"WITH {P_}, a AS (SELECT *, x >= 60 AS high, (x >= 60 AND NOT coalesce(lag(x >= 60) OVER (PARTITION BY person ORDER BY n), false))::BIGINT AS new FROM pt), e AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY n)::BIGINT AS episode FROM a) SELECT person, episode, min(us) AS raised, count(*) FILTER (high) AS updates, min(us) FILTER (NOT high) AS cleared, max(x) AS worst, round((min(us) FILTER (NOT high) - min(us)) / 1e6, 6) AS seconds FROM e WHERE episode > 0 GROUP BY ALL",
    "session_activity": f"WITH {P_}, a AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY person ORDER BY n) > 21600000000, true)::BIGINT AS new FROM pt), e AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY n)::BIGINT AS k FROM a) SELECT person, k, count(*) AS n, min(us) AS start, max(us) AS \"end\" FROM e GROUP BY ALL",
    "focus_state": f"WITH {P_} SELECT id, last_value(CASE WHEN id % 5 = 0 THEN event_type END IGNORE NULLS) OVER w AS mark, round((us - min(us) OVER w) / 1e6, 3) AS since_s FROM pt WINDOW w AS (PARTITION BY person ORDER BY n ROWS UNBOUNDED PRECEDING)",
}
