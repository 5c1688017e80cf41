"""Configuration, registries and buffers: dimension tables as JSON, guarded upserts, last-N buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.operators.evaluate import ranked, retrieval
from trackmill.operators.identity import camera_pairs
from trackmill.sources import views as V
from trackmill.sources.tables import table

#: Playback: frames of a recording. Handoff: pairs of cameras that are configured.
FRAMES, RULES = 1000, (("c01", "c02"), ("c02", "c03"), ("c03", "c04"))


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Of each key the last n rows by order (descending), with the number that a buffer of n has
    dropped before them: the oldest go first."""
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("place", r.cast("long")).withColumn("dropped", F.greatest(F.count("*").over(w) - n, F.lit(0)).cast("long")).where(F.col("place") <= n)


def guarded(commands: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What becomes of each command (column op: create, update or delete) on its key: ok, duplicate
    for a create of what exists, missing for the others on what does not."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # whatever came of them, after a create the key exists, and after a delete it does not
    exists = F.coalesce(F.last(F.when(F.col("op") != "update", F.col("op")), ignorenulls=True).over(before) == "create", F.lit(False))
    return commands.withColumn("status", F.when((F.col("op") == "create") & exists, "duplicate").when((F.col("op") != "create") & ~exists, "missing").otherwise("ok"))


def playback(commands: DataFrame, key: str, order: list[str], frames: int) -> DataFrame:
    """What becomes of playback commands (op: pause, resume or seek; frame): a seek beyond the end is
    an error and changes nothing; a pause while paused and a resume while playing do nothing."""
    upto = Window.partitionBy(key).orderBy(*order)
    turn = F.when(F.col("op") != "seek", F.col("op"))
    was = F.coalesce(F.last(turn, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit("resume"))
    now = F.when(F.col("op") == "seek", was).otherwise(F.col("op"))
    status = F.when((F.col("op") == "seek") & (F.col("frame") >= frames), "error").when(F.col("op") == was, "unchanged").otherwise("ok")
    return commands.withColumn("status", status).withColumn("state", F.when(now == "pause", "paused").otherwise("playing"))


# --- queries

def positioned_events(s: SparkSession, d: str) -> DataFrame:
    return V.tracking_events(s, d).where("x IS NOT NULL AND y IS NOT NULL").select("id", "camera", "x", "y")


def environment_list(s: SparkSession, d: str) -> DataFrame:
    """Active environments of two types, numbered by name within their type, with their active cameras."""
    cameras = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("s_acctbal") > 0).alias("active"), F.count("*").alias("cameras"))
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name").isin("ASIA", "EUROPE")).join(cameras, "n_nationkey").where("active > 0")
    place = F.row_number().over(Window.partitionBy("r_name").orderBy("n_name"))
    return rows.select(F.col("r_name").alias("kind"), F.col("n_name").alias("name"), place.cast("long").alias("place"), "active", "cameras")


def environment_config(s: SparkSession, d: str) -> DataFrame:
    """Environments saved as JSON, one document each, and loaded into a table of their cameras again."""
    nation = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    camera = F.struct(F.col("n_nationkey").cast("long").alias("camera_id"), F.col("n_name").alias("name"))
    saved = nation.groupBy("r_name").agg(F.to_json(F.struct(F.col("r_name").alias("environment_id"), F.array_sort(F.collect_list(camera)).alias("cameras"))).alias("json"))  # a few dozen cameras
    loaded = saved.select(F.from_json("json", "environment_id string, cameras array<struct<camera_id: bigint, name: string>>").alias("c"))
    return loaded.select("c.environment_id", F.explode("c.cameras").alias("x")).select("environment_id", "x.camera_id", "x.name")


def environment_upserts(s: SparkSession, d: str) -> DataFrame:
    """Creates, updates and deletes of environments: how many took effect, whether the environment
    exists in the end and when it was last changed."""
    op = F.when(F.col("id") % 5 == 0, "create").when(F.col("id") % 5 == 4, "delete").otherwise("update")
    c = guarded(V.tracking_events(s, d).select("id", "us", F.concat_ws("-", "env", (F.col("track") % 50).cast("string")).alias("key"), op.alias("op")), ["key"], ["us", "id"])
    last = F.max_by("op", F.struct("us", "id")).alias("x")
    turns = c.where("op != 'update'").groupBy("key").agg(last).select("key", (F.col("x") == "create").alias("exists"))
    g = c.groupBy("key").agg(F.count_if(F.col("status") == "ok").alias("done"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "missing").alias("missing"), F.max(F.when(F.col("status") == "ok", F.col("us"))).alias("last_us"))
    return g.join(turns, "key", "left").select("key", "done", "duplicates", "missing", "last_us", F.coalesce("exists", F.lit(False)).alias("exists"))


def pair_performance(s: SparkSession, d: str) -> DataFrame:
    """Matches of each pair of cameras: how many, how far apart, and what share is close."""
    p = camera_pairs(V.frames(s, d))
    return p.groupBy("camera", "b_camera").agg(F.count("*").alias("matches"), F.round(F.avg("dist"), 6).alias("mean_dist"), F.round(F.max("dist"), 6).alias("max_dist"), F.round(F.avg((F.col("dist") <= 6).cast("double")), 6).alias("close"))


def handoff_validation(s: SparkSession, d: str) -> DataFrame:
    """Moves between cameras that no handoff rule allows, and how often they happen."""
    w = Window.partitionBy("person").orderBy("us", "id")
    moves = V.tracking_events(s, d).select("camera", F.lead("camera").over(w).alias("next_camera")).where("next_camera != camera")
    n = moves.groupBy("camera", "next_camera").agg(F.count("*").alias("moves"))
    rules = V.literal(s, [*RULES, *((b, a) for a, b in RULES)], "camera, next_camera")
    return n.join(F.broadcast(rules), ["camera", "next_camera"], "left_anti").select("camera", "next_camera", "moves")


def world_points(s: SparkSession, d: str) -> DataFrame:
    """Points of tracks, and of detections that no track of their camera, hour and person covers; those have an empty track."""
    e = V.tracking_events(s, d).withColumn("frame", F.floor(F.col("us") / V.HOUR))
    tracks, rest = e.where("id % 2 = 0"), e.where("id % 2 = 1")
    keys = ["camera", "frame", "person"]
    rest = rest.join(tracks.select(*keys).distinct(), keys, "left_anti")
    point = lambda df, track: df.select("id", "camera", "frame", track.alias("track_id"), "x", "y")
    return point(tracks, F.col("track").cast("string")).unionByName(point(rest, F.lit("")))


def box_arrays(s: SparkSession, d: str) -> DataFrame:
    """Detections as arrays x1, y1, x2, y2, confidence, class, and back: width, height, confidence and class."""
    a = V.detections(s, d).select("id", F.array("x1", "y1", "x2", "y2", "conf", (F.col("track") % 3).cast("double")).alias("a"))
    at = lambda i: F.element_at("a", i)
    return a.select("id", F.size("a").cast("long").alias("n"), (at(3) - at(1)).alias("width"), (at(4) - at(2)).alias("height"), at(5).alias("conf"), at(6).cast("long").alias("kind"))


def pseudo_tracks(s: SparkSession, d: str) -> DataFrame:
    """Tracks when tracking is off: one for each detection, without a number and a global id."""
    return V.detections(s, d).select("id", "camera", "frame", F.lit(-1).cast("long").alias("track_id"), F.lit(None).cast("string").alias("global_id"), "conf")


def seek_commands(s: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("id") % 3 == 0, "pause").when(F.col("id") % 3 == 1, "resume").otherwise("seek")
    c = V.tracking_events(s, d).select("id", "us", "track", op.alias("op"), (F.col("id") * 37 % 1200).alias("frame"))
    return playback(c, "track", ["us", "id"], FRAMES).select("id", "op", "status", "state")


def matched_results(s: SparkSession, d: str) -> DataFrame:
    """The five nearest gallery rows of each query that has a match, right ones marked, beside its average precision."""
    return retrieval(ranked(s, d)).select("q_id", F.round("ap", 6).alias("ap"), "nearest")


def metric_points(s: SparkSession, d: str) -> DataFrame:
    """Metric points with labels: of each metric and set of labels how many, and the latest."""
    labels = F.create_map(F.lit("camera"), F.col("camera"), F.lit("env"), F.col("env"))
    p = V.tracking_events(s, d).select(F.col("event_type").alias("metric"), "us", "id", F.col("y").alias("value"), labels.alias("labels"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return p.groupBy("metric", text.alias("labels")).agg(F.count("*").alias("points"), F.max_by("value", F.struct("us", "id")).alias("latest"))


def reduce_ranks(s: SparkSession, d: str) -> DataFrame:
    """Values gathered from each rank (camera) by key, and their sum and mean over the ranks."""
    one = V.tracking_events(s, d).groupBy("camera", F.col("event_type").alias("key")).agg(F.count("*").alias("v"))
    return one.groupBy("key").agg(F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("ranks"), F.min_by("v", "camera").alias("first_rank"))


def pending_buffer(s: SparkSession, d: str) -> DataFrame:
    """A buffer of ten pending updates for each track, of which the oldest go first."""
    rows = last_n(V.tracking_events(s, d).select("id", "us", "track"), ["track"], [F.desc("us"), F.desc("id")], 10)
    return rows.select("track", "id", "place", "dropped")


def latest_frames(s: SparkSession, d: str) -> DataFrame:
    """A queue of two frames for each camera and hour: a new frame drops the oldest."""
    rows = V.tracking_events(s, d).select("id", "us", "camera", F.floor(F.col("us") / V.HOUR).alias("hour"))
    return last_n(rows, ["camera", "hour"], [F.desc("us"), F.desc("id")], 2).select("camera", "hour", "id", "place", "dropped")


QUERIES = {f.__name__: f for f in (
    positioned_events, environment_list, environment_config, environment_upserts, pair_performance, handoff_validation, world_points, box_arrays, pseudo_tracks, seek_commands, matched_results, metric_points, reduce_ranks, pending_buffer, latest_frames,
)}
from trackmill.operators.evaluate import _RET  # noqa: E402

E_, D_ = V.EVENTS_SQL, V.DETECTIONS_SQL
_PAIRS = V.FRAMES_SQL + ", pairs AS (SELECT a.camera, b.camera AS b_camera, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM fr a JOIN fr b USING (env, frame) WHERE a.camera < b.camera AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 12)"
_LAST = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY us DESC, id DESC) AS place, greatest(count(*) OVER (PARTITION BY {k}) - {n}, 0) AS dropped FROM {t}"
SQL = {
    "positioned_events": f"WITH {E_} SELECT id, camera, x, y FROM ev WHERE x IS NOT NULL AND y IS NOT NULL",
    "environment_list": "WITH c AS (SELECT s_nationkey AS n_nationkey, count(*) FILTER (s_acctbal > 0) AS active, count(*) AS cameras FROM supplier GROUP BY 1) SELECT r_name AS kind, n_name AS name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS place, active, cameras FROM nation JOIN region ON n_regionkey = r_regionkey JOIN c USING (n_nationkey) WHERE r_name IN ('ASIA', 'EUROPE') AND active > 0",
    "environment_config": "SELECT r_name AS environment_id, n_nationkey::BIGINT AS camera_id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "environment_upserts": f"WITH {E_}, c AS (SELECT id, us, env || '-' || (track % 50) AS key, CASE WHEN id % 5 = 0 THEN 'create' WHEN id % 5 = 4 THEN 'delete' ELSE 'update' END AS op FROM ev), b AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'create', false) AS was FROM c), t AS (SELECT *, CASE WHEN op = 'create' AND was THEN 'duplicate' WHEN op <> 'create' AND NOT was THEN 'missing' ELSE 'ok' END AS status FROM b) SELECT key, count(*) FILTER (status = 'ok') AS done, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'missing') AS missing, max(us) FILTER (status = 'ok') AS last_us, coalesce(arg_max(op, (us, id)) FILTER (op <> 'update') = 'create', false) AS exists FROM t GROUP BY key",
    "pair_performance": f"WITH {_PAIRS} SELECT camera, b_camera, count(*) AS matches, round(avg(dist), 6) AS mean_dist, round(max(dist), 6) AS max_dist, round(avg((dist <= 6)::INT), 6) AS close FROM pairs GROUP BY ALL",
    "handoff_validation": f"WITH {E_}, m AS (SELECT camera, lead(camera) OVER (PARTITION BY person ORDER BY us, id) AS next_camera FROM ev) SELECT camera, next_camera, count(*) AS moves FROM m WHERE next_camera <> camera AND abs(right(camera, 1)::INT - right(next_camera, 1)::INT) <> 1 GROUP BY ALL",
    "world_points": f"WITH {E_}, e AS (SELECT *, us // 3600000000 AS frame FROM ev) SELECT id, camera, frame, track::VARCHAR AS track_id, x, y FROM e WHERE id % 2 = 0 UNION ALL SELECT id, camera, frame, '', x, y FROM e WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e t WHERE t.id % 2 = 0 AND t.camera = e.camera AND t.frame = e.frame AND t.person = e.person)",
    "box_arrays": f"WITH {D_} SELECT id, 6::BIGINT AS n, x2 - x1 AS width, y2 - y1 AS height, conf, track % 3 AS kind FROM det",
    "pseudo_tracks": f"WITH {D_} SELECT id, camera, frame, -1::BIGINT AS track_id, NULL::VARCHAR AS global_id, conf FROM det",
    "seek_commands": f"WITH {E_}, c AS (SELECT id, us, track, CASE id % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' ELSE 'seek' END AS op, id * 37 % 1200 AS frame FROM ev), b AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'seek' THEN op END IGNORE NULLS) OVER (PARTITION BY track ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'resume') AS was FROM c) SELECT id, op, CASE WHEN op = 'seek' AND frame >= 1000 THEN 'error' WHEN op = was THEN 'unchanged' ELSE 'ok' END AS status, CASE WHEN CASE WHEN op = 'seek' THEN was ELSE op END = 'pause' THEN 'paused' ELSE 'playing' END AS state FROM b",
    "matched_results": f"WITH {_RET}, f AS (SELECT q_id, string_agg(g_id || CASE WHEN hit THEN '+' ELSE '-' END, ',' ORDER BY rank) AS nearest FROM rh WHERE rank <= 5 GROUP BY q_id) SELECT q_id, round(ap, 6) AS ap, nearest FROM re JOIN f USING (q_id)",
    "metric_points": f"WITH {E_} SELECT event_type AS metric, 'camera=' || camera || ',env=' || env AS labels, count(*) AS points, arg_max(y, (us, id)) AS latest FROM ev GROUP BY ALL",
    "reduce_ranks": f"WITH {E_}, o AS (SELECT camera, event_type AS key, count(*) AS v FROM ev GROUP BY ALL) SELECT key, sum(v)::BIGINT AS total, round(avg(v), 6) AS mean, count(*) AS ranks, arg_min(v, camera) AS first_rank FROM o GROUP BY key",
    "pending_buffer": f"WITH {E_}, l AS ({_LAST.format(k='track', n=10, t='ev')}) SELECT track, id, place, dropped FROM l WHERE place <= 10",
    "latest_frames": f"WITH {E_}, h AS (SELECT *, us // 3600000000 AS hour FROM ev), l AS ({_LAST.format(k='camera, hour', n=2, t='h')}) SELECT camera, hour, id, place, dropped FROM l WHERE place <= 2",
}
