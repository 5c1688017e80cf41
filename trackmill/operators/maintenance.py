"""Retention, upserts, set operations, sampling, and joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.operators.aggregates import half_up
from trackmill.operators.scans import latest, with_as_of
from trackmill.sources import views as V
from trackmill.sources.tables import materialise, table

#: A multiplicative mix of ids for sampling that any engine can compute: (id * A + seed) mod M.
MIX, MODULUS = 48271, 2147483647
#: Parts into which the persons of a set of cameras are dealt.
DEALT = 16


def mixed(x: Column, seed: int = 0) -> Column:
    """A pseudo-random number below MODULUS from an id."""
    return ((x % MODULUS) * MIX + seed) % MODULUS


def classified(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Retention class of each row by its environment's policy, or the default one, and its whole days of age."""
    p = rows.join(F.broadcast(policies), "env", "left").crossJoin(F.broadcast(policies.where("env = 'default'").select(*[F.col(c).alias(f"d_{c}") for c in ("del", "arc", "com")])))
    age = F.floor((F.col("as_of") - F.col("us")) / V.DAY)
    over = lambda c: age >= F.coalesce(c, f"d_{c}")
    return p.withColumn("class", F.when(over("del"), "delete").when(over("arc"), "archive").when(over("com"), "compress").otherwise("keep"))


def balanced(rows: DataFrame, key: str, ids: int, each: int, seed: int) -> DataFrame:
    """P identities, K instances of each: the smallest mixed numbers of both."""
    k = rows.select(key).distinct().withColumn("m", mixed(F.col(key), seed)).orderBy("m", key).limit(ids).select(key)
    w = Window.partitionBy(key).orderBy(mixed(F.col("id"), seed), "id")
    return rows.join(F.broadcast(k), key).withColumn("r", F.row_number().over(w)).where(F.col("r") <= each)


# --- queries

def retention_classify(s: SparkSession, d: str) -> DataFrame:
    """Ages as of 80 days after the newest event."""
    e = with_as_of(V.tracking_events(s, d)).withColumn("as_of", F.col("as_of") + 80 * V.DAY)
    c = classified(e, V.literal(s, V.POLICIES, "env, del, arc, com"))
    return c.groupBy("env", "class").agg(F.count("*").alias("n"), F.min("us").alias("oldest"))


def retention_delete(s: SparkSession, d: str) -> DataFrame:
    """Rows older than ten days go; the rest is written anew by day, and counts are returned."""
    e = with_as_of(V.tracking_events(s, d)).withColumn("old", F.col("us") < F.col("as_of") - 10 * V.DAY)
    kept, _ = materialise(e.where("NOT old").select("id", "session"))
    return e.agg(F.count_if("old").alias("deleted")).crossJoin(kept.agg(F.count("*").alias("kept"), F.count_distinct("session").alias("days")))


def storage_stats(s: SparkSession, d: str) -> DataFrame:
    """Rows and files by day of a table that is partitioned by day and compressed anew."""
    _, path = materialise(s.range(1))
    V.tracking_events(s, d).select("id", "x", "y", "session").repartition("session").write.option("compression", "zstd").partitionBy("session").parquet(path + "-days")
    t = s.read.parquet(path + "-days").select(F.col("session").cast("string").alias("session"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size"))
    return t.groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("f").alias("files"), (F.max("size") > 0).alias("has_bytes"))


def upsert_identity(s: SparkSession, d: str) -> DataFrame:
    """Later rows of a person replace earlier ones; others stay."""
    e = V.tracking_events(s, d).select("person", "us", "id", "camera")
    old, new = latest(e.where("id % 2 = 0"), ["person"]), latest(e.where("id % 3 = 0"), ["person"])
    return latest(old.unionByName(new), ["person"]).select("person", "us", "id", "camera")


def union_distinct(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d).select("person", "camera")
    return e.where("person < 'P3'").union(e.where("person > 'P2'")).distinct()


def set_difference(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d)
    return e.where("event_type = 'view'").select("person", "camera").exceptAll(e.where("event_type = 'click'").select("person", "camera"))


def camera_sets(s: SparkSession, d: str) -> DataFrame:
    """Merge guard: persons of one day whose sets of cameras don't overlap."""
    c = V.tracking_events(s, d).where("session = '2024-01-05'").groupBy("person").agg(F.sort_array(F.collect_set("camera")).alias("a"))
    # persons of one set meet those of sets without a common camera; a set's persons are dealt out, as there are few sets
    sets = c.groupBy("a").count().select("a")
    apart = sets.crossJoin(F.broadcast(sets.select(F.col("a").alias("b")))).where(~F.arrays_overlap("a", "b")).withColumn("cameras", F.size(F.array_union("a", "b")).cast("long"))
    deal = F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))
    left = c.join(F.broadcast(apart), "a").select("person", "b", "cameras", F.pmod(F.xxhash64("person"), F.lit(DEALT)).alias("part"))
    right = c.select(F.col("person").alias("other"), F.col("a").alias("b"), F.explode(deal).alias("part"))
    return left.join(right, ["b", "part"]).where("person < other").select("person", "other", "cameras")


def dataset_union(s: SparkSession, d: str) -> DataFrame:
    """Train, query and gallery as one, ids prefixed, junk left out."""
    e = V.tracking_events(s, d)
    part = lambda name, cond: e.where(cond).select(F.concat_ws("_", F.lit(name), "track").alias("pid"), "id")
    u = part("train", "id % 10 > 4 AND track % 10 != 0").unionByName(part("query", "id % 10 = 0 AND track % 10 != 0")).unionByName(part("gallery", "id % 10 BETWEEN 1 AND 4 AND track % 10 != 0"))
    return u.groupBy("pid").agg(F.count("*").alias("n"))


def cumulative_offset(s: SparkSession, d: str) -> DataFrame:
    """Batches in order as one sequence of frames."""
    b = V.tracking_events(s, d).groupBy("camera", "session").agg(F.count("*").alias("n"))
    w = Window.partitionBy("camera").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def events_join_detections(s: SparkSession, d: str) -> DataFrame:
    e, t = V.tracking_events(s, d), V.detections(s, d).where("conf >= 0.3")
    j = e.join(t.select("id", "frame", "x1"), "id", "left")
    return j.groupBy("camera").agg(F.count("*").alias("n"), F.count("x1").alias("matched"), half_up(F.sum("x1")).alias("x1"))


def camera_environment(s: SparkSession, d: str) -> DataFrame:
    m = V.literal(s, [("c01", "north"), ("c02", "north"), ("c03", "south")], "camera, site")
    return V.tracking_events(s, d).join(F.broadcast(m), "camera", "left").groupBy(F.coalesce("site", F.lit("default")).alias("site")).agg(F.count("*").alias("n"))


def frame_offset_join(s: SparkSession, d: str) -> DataFrame:
    """Truth and predictions by frame, the predictions' numbers shifted to the first frame of the truth. Both sides are counted by
    frame and camera before they meet."""
    t = V.detections(s, d)
    truth = t.where("id % 2 = 0").select((F.col("frame") + 5000).alias("frame"), "camera")
    first = F.broadcast(truth.agg((F.min("frame") - 1).alias("shift")))
    p = t.where("id % 2 = 1").crossJoin(first).select((F.col("frame") + F.col("shift")).alias("frame"), F.col("camera").alias("p_camera"))
    a, b = truth.groupBy("frame", "camera").agg(F.count("*").alias("a")), p.groupBy("frame", "p_camera").agg(F.count("*").alias("b"))
    return a.join(b, "frame").groupBy("camera", "p_camera").agg(F.sum(F.col("a") * F.col("b")).alias("n"))


def weighted_sample(s: SparkSession, d: str) -> DataFrame:
    """A hundred rows, by class: the mixed number times the class's size, smallest first."""
    e = V.tracking_events(s, d)
    n = F.broadcast(e.groupBy("event_type").agg(F.count("*").alias("n")))
    return e.join(n, "event_type").select("event_type", "id", (mixed(F.col("id"), 7) * F.col("n")).alias("key")).orderBy("key", "id").limit(100).select("event_type", "id")


def balanced_sample(s: SparkSession, d: str) -> DataFrame:
    return balanced(V.tracking_events(s, d), "track", 16, 4, 3).select("track", "id")


def identity_chunks(s: SparkSession, d: str) -> DataFrame:
    """Each identity's shuffled rows, four at a time; what doesn't fill a chunk is left out."""
    w = Window.partitionBy("track").orderBy(mixed(F.col("id"), 5), "id")
    e = V.tracking_events(s, d).withColumn("r", F.row_number().over(w) - 1).withColumn("c", F.count("*").over(Window.partitionBy("track")))
    return e.where("r < (c div 4) * 4").select("track", F.expr("r div 4").alias("chunk"), "id")


def shards(s: SparkSession, d: str) -> DataFrame:
    """Every row to one of four shards by its place in a shuffle (interleaved) and by id (contiguous)."""
    e = V.tracking_events(s, d)
    top = F.broadcast(e.agg((F.max("id") + 1).alias("all")))
    return e.crossJoin(top).groupBy((mixed(F.col("id"), 1) % 4).alias("shard"), F.expr("id * 4 div all").alias("part")).agg(F.count("*").alias("n"))


def per_key_cap(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("camera").orderBy("us", "id")
    return V.tracking_events(s, d).withColumn("r", F.row_number().over(w)).where("r <= 500").groupBy("camera").agg(F.count("*").alias("n"), F.max("us").alias("until"))


def explode_tracks(s: SparkSession, d: str) -> DataFrame:
    """Track lists of a frame to rows; tracks without a global id go, boxes default to zero."""
    f = V.detections(s, d).groupBy("camera", "frame").agg(F.collect_list(F.struct(F.when(F.col("id") % 6 != 0, F.col("person")).alias("gid"), F.when(F.col("id") % 5 != 0, F.col("x1")).alias("x1"))).alias("tracks"))
    t = f.select("camera", "frame", F.explode("tracks").alias("t")).where("t.gid IS NOT NULL")
    return t.groupBy("camera").agg(F.count("*").alias("n"), half_up(F.sum(F.coalesce("t.x1", F.lit(0.0)))).alias("x1"))


def focus_tracks(s: SparkSession, d: str) -> DataFrame:
    """One person's tracks, with a placeholder for each camera where it has none."""
    e = V.tracking_events(s, d)
    own = e.where("person = 'P5' AND session < '2024-01-04'").groupBy("camera").agg(F.count("*").alias("n"))
    return e.select("camera").distinct().join(own, "camera", "left").select("camera", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("placeholder"))


def frame_sync(s: SparkSession, d: str) -> DataFrame:
    """Frames whose cameras' times spread over too much are dropped; a single camera passes."""
    f = V.tracking_events(s, d).groupBy("env", F.floor(F.col("us") / (6 * V.HOUR)).alias("frame"), "camera").agg(F.min("us").alias("us"))
    g = f.groupBy("env", "frame").agg(F.count("*").alias("cameras"), (F.max("us") - F.min("us")).alias("spread"))
    return g.where((F.col("cameras") == 1) | (F.col("spread") <= V.HOUR))


def circuit_breaker(s: SparkSession, d: str) -> DataFrame:
    """State after each camera's events in order: an ordered fold, in time parts of a day that each start closed.
    Open after five failures without three successes in a row while open."""
    e = V.tracking_events(s, d).groupBy("camera", "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "id", (F.col("event_type") == "error").alias("bad")))), lambda x: x["bad"]).alias("a"))
    start = F.struct(F.lit(0).alias("fails"), F.lit(0).alias("good"), F.lit(False).alias("open"))

    def step(st, bad):
        fails = F.when(bad, st["fails"] + 1).otherwise(st["fails"])
        good = F.when(bad, F.lit(0)).when(st["open"], st["good"] + 1).otherwise(F.lit(0))
        close = st["open"] & (good >= 3)
        return F.struct(F.when(close, 0).otherwise(fails).alias("fails"), F.when(close, 0).otherwise(good).alias("good"), F.when(close, False).otherwise(st["open"] | (fails >= 5)).alias("open"))

    return e.select("camera", "session", F.aggregate("a", start, step).alias("s")).select("camera", "session", F.col("s.open").alias("open"), F.col("s.fails").cast("long").alias("fails"))


def flatten_metrics(s: SparkSession, d: str) -> DataFrame:
    """Nested metrics to paths and values."""
    m = V.tracking_events(s, d).groupBy("camera", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))
    kv = F.map_from_arrays(F.array(F.lit("n"), F.lit("conf")), F.array(F.col("n").cast("double"), F.col("conf")))
    return m.select("camera", "event_type", F.explode(kv).alias("k", "value")).select(F.concat_ws("/", "camera", "event_type", "k").alias("path"), "value")


def tpch_pricing(s: SparkSession, d: str) -> DataFrame:
    """Generic aggregation over the line items: filters and columns reach the scan."""
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"), F.round(F.sum(net.cast("double")), 1).alias("net"))


def customer_orders(s: SparkSession, d: str) -> DataFrame:
    """Generic joins: orders and value by nation."""
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("double")), 1).alias("value"))


QUERIES = {f.__name__: f for f in (
    retention_classify, retention_delete, storage_stats, upsert_identity, union_distinct, set_difference, camera_sets, dataset_union, cumulative_offset, events_join_detections, camera_environment, frame_offset_join,
    weighted_sample, balanced_sample, identity_chunks, shards, per_key_cap, explode_tracks, focus_tracks, frame_sync, circuit_breaker, flatten_metrics, tpch_pricing, customer_orders,
)}
E_, D_ = V.EVENTS_SQL, V.DETECTIONS_SQL
_mix = lambda x, seed=0: f"((({x} % {MODULUS}) * {MIX} + {seed}) % {MODULUS})"
SQL = {
    "retention_classify": f"WITH {E_}, a AS (SELECT ev.env, us, ((SELECT max(us) FROM ev) + 80 * 86400000000 - us) // 86400000000 AS age, p.* EXCLUDE (env) FROM ev JOIN (VALUES {V.values(V.POLICIES)}) p(env, d, a, c) ON ev.env = p.env) SELECT env, CASE WHEN age >= d THEN 'delete' WHEN age >= a THEN 'archive' WHEN age >= c THEN 'compress' ELSE 'keep' END AS class, count(*) AS n, min(us) AS oldest FROM a GROUP BY ALL",
    "retention_delete": f"WITH {E_}, o AS (SELECT *, us < (SELECT max(us) FROM ev) - 864000000000 AS old FROM ev) SELECT count(*) FILTER (old) AS deleted, count(*) FILTER (NOT old) AS kept, count(DISTINCT session) FILTER (NOT old) AS days FROM o",
    "storage_stats": f"WITH {E_} SELECT session, count(*) AS n, 1::BIGINT AS files, true AS has_bytes FROM ev GROUP BY session",
    "upsert_identity": f"WITH {E_}, l AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY us DESC, id DESC) AS r FROM ev WHERE id % 2 = 0 OR id % 3 = 0) SELECT person, us, id, camera FROM l WHERE r = 1",
    "union_distinct": f"WITH {E_} SELECT person, camera FROM ev WHERE person < 'P3' UNION SELECT person, camera FROM ev WHERE person > 'P2'",
    "set_difference": f"WITH {E_} SELECT person, camera FROM ev WHERE event_type = 'view' EXCEPT ALL SELECT person, camera FROM ev WHERE event_type = 'click'",
    "camera_sets": f"WITH {E_}, c AS (SELECT person, list_distinct(list(camera)) AS a FROM ev WHERE session = '2024-01-05' GROUP BY person) SELECT p.person, q.person AS other, len(list_distinct(list_concat(p.a, q.a)))::BIGINT AS cameras FROM c p JOIN c q ON p.person < q.person WHERE NOT list_has_any(p.a, q.a)",
    "dataset_union": f"WITH {E_} SELECT CASE WHEN id % 10 = 0 THEN 'query' WHEN id % 10 < 5 THEN 'gallery' ELSE 'train' END || '_' || track AS pid, count(*) AS n FROM ev WHERE track % 10 <> 0 GROUP BY 1",
    "cumulative_offset": f"WITH {E_}, b AS (SELECT camera, session, count(*) AS n FROM ev GROUP BY ALL) SELECT *, coalesce(sum(n) OVER (PARTITION BY camera ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM b",
    "events_join_detections": f"WITH {D_} SELECT camera, count(*) AS n, count(*) FILTER (conf >= 0.3::DOUBLE) AS matched, floor(sum(x1) FILTER (conf >= 0.3::DOUBLE) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS x1 FROM det GROUP BY camera",
    "camera_environment": f"WITH {E_} SELECT CASE camera WHEN 'c01' THEN 'north' WHEN 'c02' THEN 'north' WHEN 'c03' THEN 'south' ELSE 'default' END AS site, count(*) AS n FROM ev GROUP BY 1",
    "frame_offset_join": f"WITH {D_}, t AS (SELECT frame + 5000 AS frame, camera FROM det WHERE id % 2 = 0), p AS (SELECT frame + (SELECT min(frame) - 1 FROM t) AS frame, camera AS p_camera FROM det WHERE id % 2 = 1) SELECT camera, p_camera, count(*) AS n FROM t JOIN p USING (frame) GROUP BY ALL",
    "weighted_sample": f"WITH {E_} SELECT event_type, id FROM ev JOIN (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) USING (event_type) ORDER BY {_mix('id', 7)} * n, id LIMIT 100",
    "balanced_sample": f"WITH {E_}, k AS (SELECT DISTINCT track FROM ev ORDER BY {_mix('track', 3)}, track LIMIT 16), r AS (SELECT track, id, row_number() OVER (PARTITION BY track ORDER BY {_mix('id', 3)}, id) AS r FROM ev JOIN k USING (track)) SELECT track, id FROM r WHERE r <= 4",
    "identity_chunks": f"WITH {E_}, r AS (SELECT track, id, row_number() OVER (PARTITION BY track ORDER BY {_mix('id', 5)}, id) - 1 AS r, count(*) OVER (PARTITION BY track) AS c FROM ev) SELECT track, r // 4 AS chunk, id FROM r WHERE r < c // 4 * 4",
    "shards": f"WITH {E_} SELECT {_mix('id', 1)} % 4 AS shard, id * 4 // (SELECT max(id) + 1 FROM ev) AS part, count(*) AS n FROM ev GROUP BY ALL",
    "per_key_cap": f"WITH {E_}, r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY us, id) AS r FROM ev) SELECT camera, count(*) AS n, max(us) AS until FROM r WHERE r <= 500 GROUP BY camera",
    "explode_tracks": f"WITH {D_} SELECT camera, count(*) AS n, floor(sum(CASE WHEN id % 5 <> 0 THEN x1 ELSE 0 END) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS x1 FROM det WHERE id % 6 <> 0 GROUP BY camera",
    "focus_tracks": f"WITH {E_} SELECT camera, count(*) FILTER (person = 'P5' AND session < '2024-01-04') AS n, count(*) FILTER (person = 'P5' AND session < '2024-01-04') = 0 AS placeholder FROM ev GROUP BY camera",
    "frame_sync": f"WITH {E_}, f AS (SELECT env, us // 21600000000 AS frame, camera, min(us) AS us FROM ev GROUP BY ALL) SELECT env, frame, count(*) AS cameras, max(us) - min(us) AS spread FROM f GROUP BY ALL HAVING count(*) = 1 OR max(us) - min(us) <= 3600000000",
    "circuit_breaker": f"WITH RECURSIVE {E_}, o AS (SELECT camera, session, event_type = 'error' AS bad, row_number() OVER (PARTITION BY camera, session ORDER BY us, id) AS r FROM ev), st AS (SELECT DISTINCT camera, session, 0::BIGINT AS r, 0 AS fails, 0 AS good, false AS open FROM ev UNION ALL SELECT camera, session, r, CASE WHEN open AND g >= 3 THEN 0 ELSE f END, CASE WHEN open AND g >= 3 THEN 0 ELSE g END, CASE WHEN open AND g >= 3 THEN false ELSE open OR f >= 5 END FROM (SELECT st.camera, st.session, o.r, st.open, CASE WHEN bad THEN fails + 1 ELSE fails END AS f, CASE WHEN bad THEN 0 WHEN st.open THEN good + 1 ELSE 0 END AS g FROM st JOIN o ON o.camera = st.camera AND o.session = st.session AND o.r = st.r + 1) n) SELECT camera, session, arg_max(open, r) AS open, arg_max(fails, r)::BIGINT AS fails FROM st GROUP BY ALL",
    "flatten_metrics": f"WITH {E_}, m AS (SELECT camera, event_type, count(*)::DOUBLE AS n, round(avg(conf), 6) AS conf FROM ev GROUP BY ALL) SELECT camera || '/' || event_type || '/n' AS path, n AS value FROM m UNION ALL SELECT camera || '/' || event_type || '/conf', conf FROM m",
    "tpch_pricing": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity::DOUBLE), 2) AS quantity, round(sum((l_extendedprice * (1 - l_discount))::DOUBLE), 1) AS net FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL",
    "customer_orders": "SELECT n_name, count(*) AS orders, round(sum(o_totalprice::DOUBLE), 1) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}
