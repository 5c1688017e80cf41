"""Aggregations over events, detections and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions.order import placed
from trackmill.operators.scans import latest, with_as_of
from trackmill.sources import views as V

#: Upper limits of dwell classes in seconds.
DWELL_CLASSES = (60, 300, 900)


def at_places(rows: DataFrame, key: str, value: str, places: dict[str, float | None], exact: bool = True) -> DataFrame:
    """A row for each key: of the n sorted values that at int(n * share), for each name and share of places; None is the
    upper median, at n div 2. exact=False sketches them in one pass."""
    if not exact:
        return rows.groupBy(key).agg(*[F.percentile_approx(value, 0.5 if x is None else x, 100_000).alias(name) for name, x in places.items()])
    n = rows.groupBy(key).agg(F.count(value).alias("n"))
    at = lambda x: F.floor(F.col("n") / 2) if x is None else F.least((F.col("n") * F.lit(x)).cast("long"), F.col("n") - 1)
    asked = n.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(x).alias("place")) for name, x in places.items()])).alias("x")).select(key, "x.*")
    return placed(rows, key, value, asked).groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in places])


def half_up(x: Column) -> Column:
    """x to six places, as binary arithmetic has it: alike in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def hundredths(x: Column) -> Column:
    """x to two places; a trifle is added first, so that sums of another order give the same."""
    return F.floor(x * 100 + 0.5 + 1e-7) / 100


def dwell(events: DataFrame) -> DataFrame:
    """First and last time of each person at each camera, with the seconds between."""
    r = events.groupBy("camera", "person").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))
    return r.withColumn("dwell_s", F.greatest(F.lit(0.0), (F.col("last_us") - F.col("first_us")) / 1e6))


def dwell_summary(intervals: DataFrame, exact: bool = True) -> DataFrame:
    """Per camera: mean, upper median, least, most, and shares of the dwell classes."""
    lo, parts = 0, []
    for i, hi in enumerate((*DWELL_CLASSES, None)):
        inside = (F.col("dwell_s") >= lo) & (F.col("dwell_s") < hi if hi else F.lit(True))
        parts += [F.count_if(inside).alias(f"n_class{i}"), F.round(F.count_if(inside) * 100.0 / F.count("*"), 4).alias(f"pct_class{i}")]
        lo = hi
    median = at_places(intervals, "camera", "dwell_s", {"median_s": None}, exact).select("camera", F.round("median_s", 6).alias("median_s"))
    return intervals.groupBy("camera").agg(F.count("*").alias("persons"), F.round(F.avg("dwell_s"), 6).alias("avg_s"), F.round(F.min("dwell_s"), 6).alias("min_s"), F.round(F.max("dwell_s"), 6).alias("max_s"), *parts).join(median, "camera")


def bucket_totals(events: DataFrame, size: int = V.HOUR) -> DataFrame:
    """Totals of each bucket, environment and camera, and of all cameras together (`__all__`)."""
    rows = events.withColumn("bucket", F.floor(F.col("us") / size) * size)
    out = rows.groupingSets([["bucket", "env", "camera"], ["bucket", "env"]], "bucket", "env", "camera").agg(F.count("*").alias("detections"), F.count_distinct("person").alias("persons"), F.sum("conf").alias("conf_sum"), F.count("conf").alias("conf_n"), F.grouping("camera").alias("g"))
    return out.withColumn("camera", F.when(F.col("g") == 1, F.lit("__all__")).otherwise(F.col("camera"))).drop("g")


def merged_totals(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive upsert: rows of equal keys become one with the sums."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def weighted_upsert(samples: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of all samples of a key, and the sum of their weights."""
    return samples.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))


def identities(events: DataFrame) -> DataFrame:
    """Roll-up of each person: first and last sight, cameras in the order of first sight, counts, last confidence."""
    seen = events.groupBy("person", "camera").agg(F.min(F.struct("us", "id")).alias("f"), F.max(F.struct("us", "id", "conf")).alias("l"), F.count("*").alias("n"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("f", "camera"))), lambda x: x["camera"])
    one = seen.groupBy("person").agg(F.min(F.struct("f", "camera")).alias("a"), F.max(F.struct("l", "camera")).alias("b"), F.sum("n").alias("detections"), order.alias("o"))
    return one.select("person", F.col("a.f.us").alias("first_seen"), F.col("a.camera").alias("first_camera"), F.col("b.l.us").alias("last_seen"), F.col("b.camera").alias("last_camera"), "detections", F.concat_ws(",", "o").alias("cameras"), F.col("b.l.conf").alias("last_conf"))


def with_zeros(rows: DataFrame, low: Column, high: Column, step: int, keys: list[str]) -> DataFrame:
    """Buckets from low to high for each key."""
    return rows.groupBy(*keys).agg(F.explode(F.sequence(low, high, F.lit(step))).alias("bucket"))


# --- queries

def detection_stats(s: SparkSession, d: str) -> DataFrame:
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return V.tracking_events(s, d).agg(F.count("*").alias("n"), zero(F.avg("conf")).alias("avg_conf"), zero(F.min("conf")).alias("min_conf"), zero(F.max("conf")).alias("max_conf"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def person_stats(s: SparkSession, d: str) -> DataFrame:
    p = with_as_of(identities(V.tracking_events(s, d)).withColumn("us", F.col("last_seen")))
    return p.agg(F.count("*").alias("persons"), F.count_if(F.col("us") >= F.col("as_of") - V.DAY).alias("active"), F.round(F.avg("detections"), 6).alias("avg_detections"), F.round(F.avg((F.col("last_seen") - F.col("first_seen")) / 1e6), 3).alias("avg_seconds"), F.round(F.avg("last_conf"), 6).alias("avg_conf"))


def dwell_intervals(s: SparkSession, d: str) -> DataFrame:
    return dwell(V.tracking_events(s, d)).select("camera", "person", "first_us", "last_us", "n", F.round("dwell_s", 6).alias("dwell_s"))


def dwell_by_camera(s: SparkSession, d: str) -> DataFrame:
    return dwell_summary(dwell(V.tracking_events(s, d)))


def session_rollup(s: SparkSession, d: str) -> DataFrame:
    return V.tracking_events(s, d).groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("camera").alias("cameras"), F.count_distinct("person").alias("persons"), F.round((F.max("us") - F.min("us")) / 1e6, 3).alias("seconds"))


def identity_rollup(s: SparkSession, d: str) -> DataFrame:
    return identities(V.tracking_events(s, d))


def hourly_totals(s: SparkSession, d: str) -> DataFrame:
    return bucket_totals(V.tracking_events(s, d)).where("camera != '__all__'").select("bucket", "env", "camera", "detections", F.round("conf_sum", 6).alias("conf_sum"))


def hourly_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return bucket_totals(V.tracking_events(s, d)).select("bucket", "env", "camera", "detections", "persons", F.round("conf_sum", 6).alias("conf_sum"), "conf_n")


def totals_upsert(s: SparkSession, d: str) -> DataFrame:
    """Totals of two deliveries, added up."""
    e = V.tracking_events(s, d)
    one = lambda x: bucket_totals(x, V.DAY).drop("persons")
    m = merged_totals(one(e.where("id % 2 = 0")), one(e.where("id % 2 = 1")), ["bucket", "env", "camera"], ["detections", "conf_sum", "conf_n"])
    return m.withColumn("conf_sum", F.round("conf_sum", 6))


def window_totals(s: SparkSession, d: str) -> DataFrame:
    t = bucket_totals(V.tracking_events(s, d)).where((F.col("camera") == "__all__") & F.col("bucket").between(1704412800000000, 1705276800000000))
    return t.groupBy("env").agg(F.sum("detections").alias("detections"), F.round(F.coalesce(F.try_divide(F.sum("conf_sum"), F.sum("conf_n")), F.lit(0.0)), 6).alias("avg_conf"))


def camera_breakdown(s: SparkSession, d: str) -> DataFrame:
    t = bucket_totals(V.tracking_events(s, d)).where("camera != '__all__'").groupBy("camera").agg(F.sum("detections").alias("detections"), F.sum("persons").alias("unique_entities_sum"), F.round(F.try_divide(F.sum("conf_sum"), F.sum("conf_n")), 6).alias("avg_conf"))
    u = V.tracking_events(s, d).groupBy("camera").agg(F.count_distinct("person").alias("unique_persons"))
    return t.join(u, "camera").orderBy("camera")


def bucket_series(s: SparkSession, d: str) -> DataFrame:
    t = bucket_totals(V.tracking_events(s, d), 6 * V.HOUR).where("camera = '__all__' AND env = 'campus'")
    return t.select("bucket", "detections", F.round(F.try_divide("conf_sum", "conf_n"), 6).alias("avg_conf")).orderBy("bucket")


def uptime_daily(s: SparkSession, d: str) -> DataFrame:
    """Share of the day's hours with events at each camera, a weighted mean over hours, last 7 days."""
    h = with_as_of(V.tracking_events(s, d).withColumn("hour", F.floor(F.col("us") / V.HOUR))).where(F.floor(F.col("us") / V.DAY) > F.floor(F.col("as_of") / V.DAY) - 7)
    sample = h.groupBy("camera", F.floor(F.col("us") / V.DAY).alias("day"), "hour").agg((F.least(F.count("*"), F.lit(5)) * 20.0).alias("uptime"), F.count("*").alias("samples"))
    return weighted_upsert(sample, ["day", "camera"], "uptime", "samples").withColumn("uptime", F.round("uptime", 6))


def traffic_flow(s: SparkSession, d: str) -> DataFrame:
    from trackmill.operators.sequence import velocities

    v = velocities(V.points(s, d))
    return v.groupBy("camera", "person").agg(F.round(F.coalesce(F.avg("vx"), F.lit(0.0)), 6).alias("avg_vx"), F.round(F.coalesce(F.avg("vy"), F.lit(0.0)), 6).alias("avg_vy"), F.count("*").alias("n"), F.max("us").alias("last_us"))


def traffic_by_camera(s: SparkSession, d: str) -> DataFrame:
    t = traffic_flow(s, d)
    sq = F.col("avg_vx") * F.col("avg_vx") + F.col("avg_vy") * F.col("avg_vy")
    return t.groupBy("camera").agg(F.count("*").alias("persons"), F.round(F.avg(sq), 4).alias("avg_speed_sq"), F.round(F.avg(F.sqrt(sq)), 4).alias("avg_speed"), F.expr("count(*) div 2").alias("entrances"))


def throughput(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("person").orderBy("us", "id")
    e = V.tracking_events(s, d).withColumn("gap", (F.col("us") - F.lag("us").over(w)) / 1e6).withColumn("moved", F.lag("camera").over(w) != F.col("camera"))
    return e.agg(F.count_if("moved").alias("transitions"), F.round(F.avg(F.when(F.col("moved"), F.col("gap"))), 3).alias("avg_transition_s"))


def environment_summary(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d)
    top = lambda c: e.groupBy("env", c).agg(F.count("*").alias("n")).groupBy("env").agg(F.max_by(c, F.struct("n", c)).alias(f"top_{c}"), F.max("n").alias(f"top_{c}_n"))
    one = e.groupBy("env").agg(F.count("*").alias("n"), F.count_distinct("person").alias("persons"), F.count_distinct("camera").alias("cameras"))
    return one.join(top("camera"), "env").join(top("person"), "env")


def camera_loads(s: SparkSession, d: str) -> DataFrame:
    last = latest(with_as_of(V.tracking_events(s, d)), ["person"]).where(F.col("us") >= F.col("as_of") - V.DAY)
    return last.groupBy("camera").agg(F.count("*").alias("active_persons"))


def realtime_snapshot(s: SparkSession, d: str) -> DataFrame:
    e = with_as_of(V.tracking_events(s, d))
    within = lambda h: F.col("us") >= F.col("as_of") - h * V.HOUR
    return e.agg(F.count_distinct(F.when(within(24), F.col("person"))).alias("active"), F.round(F.count_if(within(1)) / 60.0, 6).alias("per_minute"), F.round(F.coalesce(F.avg(F.when(within(5), F.col("conf"))), F.lit(0.0)), 6).alias("avg_conf"))


def performance_report(s: SparkSession, d: str) -> DataFrame:
    snap = V.tracking_events(s, d).groupBy(F.floor(F.col("us") / V.HOUR).alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("person").alias("persons"), F.avg("conf").alias("conf"))
    rows = snap.orderBy(F.desc("hour")).limit(1000)
    return rows.agg(F.round(F.avg("n"), 6).alias("mean_rate"), F.round(F.avg("persons"), 6).alias("mean_persons"), F.max("persons").alias("peak_persons"), F.round(F.avg("conf"), 6).alias("mean_conf"))


def dashboard_summary(s: SparkSession, d: str) -> DataFrame:
    """Day by day and environment: totals, mean confidence, and the change against the day before."""
    t = bucket_totals(V.tracking_events(s, d), V.DAY).where("camera = '__all__'")
    prev = F.lag("detections").over(Window.partitionBy("env").orderBy("bucket"))
    return t.select("env", "bucket", "detections", "persons", hundredths(F.try_divide("conf_sum", "conf_n") * 100).alias("conf_pct"), (F.col("detections") - prev).alias("delta"), hundredths(F.try_divide((F.col("detections") - prev) * 100.0, prev)).alias("delta_pct"))


def percentile_exact(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d)
    # the interpolated one lies between two neighbours
    near = (F.col("n") - 1) * 0.95
    two = e.groupBy("camera").agg(F.count("y").alias("n")).select("camera", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), f(near).cast("long").alias("place")) for c, f in (("low", F.floor), ("high", F.ceil))])).alias("x")).select("camera", "x.*")
    two = placed(e, "camera", "y", two).groupBy("camera").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in ("low", "high")])
    g = e.groupBy("camera").agg(F.avg("y").alias("mean"), F.count("y").alias("n")).join(at_places(e, "camera", "y", {"p95": 0.95, "p99": 0.99}), "camera").join(two, "camera")
    between = F.col("low") + (near - F.floor(near)) * (F.col("high") - F.col("low"))
    return g.select("camera", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "p99")], F.round(between, 6).alias("p95_interpolated"))


def running_mean(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("person").orderBy("us", "id")
    last = w.rowsBetween(-4, 0)
    e = V.tracking_events(s, d)
    e = e.withColumn("a", F.array_sort(F.collect_list("y").over(last)))
    middle = (F.element_at("a", F.expr("(size(a) + 1) div 2").cast("int")) + F.element_at("a", F.expr("size(a) div 2 + 1").cast("int"))) / 2
    return e.select("id", F.round(F.avg("y").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("mean"), half_up(F.avg("y").over(last)).alias("avg5"), half_up(middle).alias("median5"), F.col("y").alias("latest"))


def ema_metric(s: SparkSession, d: str) -> DataFrame:
    """Exponential moving average of each day's counts: an ordered fold over at most as many values as days."""
    t = V.tracking_events(s, d).groupBy("env", F.floor(F.col("us") / V.DAY).alias("day")).agg(F.count("*").cast("double").alias("n"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"])
    g = t.groupBy("env").agg(arr.alias("a"))
    return g.select("env", F.size("a").cast("long").alias("days"), F.round(F.aggregate(F.slice("a", 2, 100_000), F.element_at("a", 1), lambda acc, x: F.lit(0.1) * x + F.lit(0.9) * acc), 6).alias("ema"))


def success_rates(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d).groupBy("camera").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return e.select("camera", F.round(F.coalesce(F.try_divide(F.greatest(F.col("total") - F.col("failed"), F.lit(0)), "total"), F.lit(0.0)), 6).alias("success_rate"))


def dataset_summary(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d).withColumn("subset", F.when(F.col("id") % 10 == 0, "query").when(F.col("id") % 10 < 5, "gallery").otherwise("train"))
    return e.groupBy("subset").agg(F.count_distinct("track").alias("ids"), F.count("*").alias("images"), F.count_distinct("camera").alias("cameras"))


def weighted_accuracy(s: SparkSession, d: str) -> DataFrame:
    b = V.tracking_events(s, d).groupBy((F.col("id") / 64).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("conf") >= 0.5).alias("right"))
    return b.agg(F.round(F.sum("right") / F.sum("n"), 8).alias("top1"), F.count("*").alias("batches"))


def playback_transitions(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("person").orderBy("us", "id")
    e = V.tracking_events(s, d).withColumn("before", F.lag("event_type").over(w)).where("before IS NOT NULL")
    return e.groupBy("before", "event_type").agg(F.count("*").alias("n"))


def scalar_histogram(s: SparkSession, d: str) -> DataFrame:
    """Equal-width histogram of 20 bins from the least to the largest value, with sums."""
    e = V.tracking_events(s, d)
    one = F.broadcast(e.agg(F.min("y").alias("lo"), F.max("y").alias("hi")))
    b = e.crossJoin(one).withColumn("bin", F.least(F.floor((F.col("y") - F.col("lo")) * 20 / (F.col("hi") - F.col("lo"))), F.lit(19)).cast("long"))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"), F.round(F.sum(F.col("y") * F.col("y")), 2).alias("squares"))


def health_rollup(s: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    last = latest(V.tracking_events(s, d), ["env", "camera"]).withColumn("rank", rank)
    return last.groupBy("env").agg(F.coalesce(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.max("rank") + 1), F.lit("unhealthy")).alias("status"))


def error_stats(s: SparkSession, d: str) -> DataFrame:
    e = V.tracking_events(s, d).where("event_type IN ('error', 'purchase')")
    w = Window.partitionBy("camera").orderBy(F.desc("us"), F.desc("id"))
    ten = e.where("event_type = 'error'").withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("camera").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string"))).alias("last_ids"))
    one = e.groupBy("camera").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.try_divide(F.count_if(F.col("event_type") == "purchase"), F.count("*")), 6).alias("recovery"))
    return one.join(ten, "camera")


def source_priority(s: SparkSession, d: str) -> DataFrame:
    """The first source in order that has a row for a key."""
    e = V.tracking_events(s, d)
    cache = e.where("id % 5 = 0").groupBy("person").agg(F.max("us").alias("us")).select("person", F.lit(0).alias("p"), "us", F.lit("cache").alias("source"))
    stored = e.groupBy("person").agg(F.min("us").alias("us")).select("person", F.lit(1).alias("p"), "us", F.lit("db").alias("source"))
    best = cache.unionByName(stored).groupBy("person").agg(F.min(F.struct("p", "us", "source")).alias("b"))
    return best.select("person", F.col("b.us").alias("us"), F.col("b.source").alias("source"))


def metric_history(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("us"), F.desc("id"))
    return V.tracking_events(s, d).withColumn("r", F.row_number().over(w)).where("r <= 100").select("event_type", F.col("r").cast("long").alias("r"), "id", "y")


def resource_status(s: SparkSession, d: str) -> DataFrame:
    """Health by thresholds of 70 and 90 per cent, and keyword severity of messages."""
    e = V.tracking_events(s, d)
    level = F.when(F.col("conf") >= 0.9, "critical").when(F.col("conf") >= 0.7, "warning").otherwise("healthy")
    text = F.concat_ws(" ", "event_type", "camera")
    severity = F.when(text.rlike("error|fatal"), "high").when(text.rlike("signup|purchase"), "medium").otherwise("low")
    return e.groupBy(level.alias("level"), severity.alias("severity")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    detection_stats, person_stats, dwell_intervals, dwell_by_camera, session_rollup, identity_rollup, hourly_totals, hourly_grouping_sets, totals_upsert, window_totals, camera_breakdown, bucket_series, uptime_daily,
    traffic_flow, traffic_by_camera, throughput, environment_summary, camera_loads, realtime_snapshot, performance_report, dashboard_summary, percentile_exact, running_mean, ema_metric, success_rates,
    dataset_summary, weighted_accuracy, playback_transitions, scalar_histogram, health_rollup, error_stats, source_priority, metric_history, resource_status,
)}
E_ = V.EVENTS_SQL
_DWELL = f"{E_}, dw AS (SELECT camera, person, min(us) AS first_us, max(us) AS last_us, count(*) AS n, greatest(0::DOUBLE, (max(us) - min(us)) / 1e6) AS dwell_s FROM ev GROUP BY ALL)"
_TOT = E_ + ", tot AS (SELECT us // {size} * {size} AS bucket, env, coalesce(camera, '__all__') AS camera, count(*) AS detections, count(DISTINCT person) AS persons, sum(conf) AS conf_sum, count(conf) AS conf_n FROM ev GROUP BY GROUPING SETS ((us // {size} * {size}, env, camera), (us // {size} * {size}, env)))"
_tot = lambda size: _TOT.replace("{size}", str(size))
_VEL = V.POINTS_SQL + """, nb AS (SELECT *, lag(us) OVER w AS u0, lead(us) OVER w AS u1, lag(x) OVER w AS x0, lead(x) OVER w AS x1, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY person ORDER BY us, id)),
  ve AS (SELECT *, (coalesce(u1, us) - coalesce(u0, us)) / 1e6 AS dt, coalesce(x1, x) - coalesce(x0, x) AS dx, coalesce(y1, y) - coalesce(y0, y) AS dy FROM nb),
  vel AS (SELECT *, CASE WHEN dt > 0 THEN dx / dt ELSE 0 END AS vx, CASE WHEN dt > 0 THEN dy / dt ELSE 0 END AS vy FROM ve)"""
_FLOW = f"{_VEL}, fl AS (SELECT camera, person, round(coalesce(avg(vx), 0), 6) AS avg_vx, round(coalesce(avg(vy), 0), 6) AS avg_vy, count(*) AS n, max(us) AS last_us FROM vel GROUP BY ALL)"
_NEWEST = "row_number() OVER (PARTITION BY {k} ORDER BY us DESC, id DESC)"
SQL = {
    "detection_stats": f"WITH {E_} SELECT count(*) AS n, round(coalesce(avg(conf), 0), 6) AS avg_conf, coalesce(min(conf), 0)::DOUBLE AS min_conf, coalesce(max(conf), 0)::DOUBLE AS max_conf, min(us) AS first_us, max(us) AS last_us FROM ev",
    "person_stats": f"WITH {E_}, p AS (SELECT person, min(us) AS a, max(us) AS b, count(*) AS n, arg_max(conf, (us, id)) AS c FROM ev GROUP BY person) SELECT count(*) AS persons, count(*) FILTER (b >= (SELECT max(us) FROM ev) - 86400000000) AS active, round(avg(n), 6) AS avg_detections, round(avg((b - a) / 1e6), 3) AS avg_seconds, round(avg(c), 6) AS avg_conf FROM p",
    "dwell_intervals": f"WITH {_DWELL} SELECT camera, person, first_us, last_us, n, round(dwell_s, 6) AS dwell_s FROM dw",
    "dwell_by_camera": f"WITH {_DWELL} SELECT camera, count(*) AS persons, round(avg(dwell_s), 6) AS avg_s, round(list_sort(list(dwell_s))[count(*) // 2 + 1], 6) AS median_s, round(min(dwell_s), 6) AS min_s, round(max(dwell_s), 6) AS max_s, "
    + ", ".join(f"count(*) FILTER ({c}) AS n_class{i}, round(count(*) FILTER ({c}) * 100.0::DOUBLE / count(*), 4) AS pct_class{i}" for i, c in enumerate(("dwell_s < 60", "dwell_s >= 60 AND dwell_s < 300", "dwell_s >= 300 AND dwell_s < 900", "dwell_s >= 900")))
    + " FROM dw GROUP BY camera",
    "session_rollup": f"WITH {E_} SELECT session, count(*) AS n, count(DISTINCT camera) AS cameras, count(DISTINCT person) AS persons, round((max(us) - min(us)) / 1e6, 3) AS seconds FROM ev GROUP BY session",
    "identity_rollup": f"WITH {E_}, c AS (SELECT person, camera, min((us, id)) AS f FROM ev GROUP BY ALL), o AS (SELECT person, string_agg(camera, ',' ORDER BY f) AS cameras FROM c GROUP BY person) SELECT person, min(us) AS first_seen, arg_min(camera, (us, id)) AS first_camera, max(us) AS last_seen, arg_max(camera, (us, id)) AS last_camera, count(*) AS detections, any_value(cameras) AS cameras, arg_max(conf, (us, id)) AS last_conf FROM ev JOIN o USING (person) GROUP BY person",
    "hourly_totals": f"WITH {E_} SELECT us // 3600000000 * 3600000000 AS bucket, env, camera, count(*) AS detections, round(sum(conf), 6) AS conf_sum FROM ev GROUP BY ALL",
    "hourly_grouping_sets": f"WITH {_tot(V.HOUR)} SELECT bucket, env, camera, detections, persons, round(conf_sum, 6) AS conf_sum, conf_n FROM tot",
    "totals_upsert": f"WITH {_tot(V.DAY)} SELECT bucket, env, camera, detections, round(conf_sum, 6) AS conf_sum, conf_n FROM tot",
    "window_totals": f"WITH {E_} SELECT env, count(*) AS detections, round(coalesce(sum(conf) / count(conf), 0), 6) AS avg_conf FROM ev WHERE us // 3600000000 * 3600000000 BETWEEN 1704412800000000 AND 1705276800000000 GROUP BY env",
    "camera_breakdown": f"WITH {_tot(V.HOUR)} SELECT t.camera, sum(detections)::BIGINT AS detections, sum(persons)::BIGINT AS unique_entities_sum, round(sum(conf_sum) / sum(conf_n), 6) AS avg_conf, any_value(u.n) AS unique_persons FROM tot t JOIN (SELECT camera, count(DISTINCT person) AS n FROM ev GROUP BY camera) u ON t.camera = u.camera GROUP BY t.camera",
    "bucket_series": f"WITH {E_} SELECT us // 21600000000 * 21600000000 AS bucket, count(*) AS detections, round(sum(conf) / count(conf), 6) AS avg_conf FROM ev WHERE env = 'campus' GROUP BY ALL",
    "uptime_daily": f"WITH {E_}, h AS (SELECT camera, us // 86400000000 AS day, us // 3600000000 AS hour, least(count(*), 5) * 20.0::DOUBLE AS u, count(*) AS n FROM ev WHERE us // 86400000000 > (SELECT max(us) FROM ev) // 86400000000 - 7 GROUP BY ALL) SELECT day, camera, round(sum(u * n) / sum(n), 6) AS uptime, sum(n)::BIGINT AS samples FROM h GROUP BY ALL",
    "traffic_flow": f"WITH {_FLOW} SELECT * FROM fl",
    "traffic_by_camera": f"WITH {_FLOW} SELECT camera, count(*) AS persons, round(avg(avg_vx * avg_vx + avg_vy * avg_vy), 4) AS avg_speed_sq, round(avg(sqrt(avg_vx * avg_vx + avg_vy * avg_vy)), 4) AS avg_speed, count(*) // 2 AS entrances FROM fl GROUP BY camera",
    "throughput": f"WITH {E_}, l AS (SELECT camera, lag(camera) OVER w AS c0, (us - lag(us) OVER w) / 1e6 AS gap FROM ev WINDOW w AS (PARTITION BY person ORDER BY us, id)) SELECT count(*) AS transitions, round(avg(gap), 3) AS avg_transition_s FROM l WHERE c0 <> camera",
    "environment_summary": f"WITH {E_}, c AS (SELECT env, camera, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT env, person, count(*) AS n FROM ev GROUP BY ALL), tc AS (SELECT env, arg_max(camera, (n, camera)) AS top_camera, max(n) AS top_camera_n FROM c GROUP BY env), tp AS (SELECT env, arg_max(person, (n, person)) AS top_person, max(n) AS top_person_n FROM p GROUP BY env) SELECT env, count(*) AS n, count(DISTINCT person) AS persons, count(DISTINCT camera) AS cameras, any_value(top_camera) AS top_camera, any_value(top_camera_n) AS top_camera_n, any_value(top_person) AS top_person, any_value(top_person_n) AS top_person_n FROM ev JOIN tc USING (env) JOIN tp USING (env) GROUP BY env",
    "camera_loads": f"WITH {E_}, l AS (SELECT camera, us, {_NEWEST.format(k='person')} AS r FROM ev) SELECT camera, count(*) AS active_persons FROM l WHERE r = 1 AND us >= (SELECT max(us) FROM ev) - 86400000000 GROUP BY camera",
    "realtime_snapshot": f"WITH {E_}, m AS (SELECT max(us) AS a FROM ev) SELECT count(DISTINCT CASE WHEN us >= a - 86400000000 THEN person END) AS active, round(count(*) FILTER (us >= a - 3600000000) / 60.0::DOUBLE, 6) AS per_minute, round(coalesce(avg(conf) FILTER (us >= a - 18000000000), 0), 6) AS avg_conf FROM ev, m",
    "performance_report": f"WITH {E_}, h AS (SELECT us // 3600000000 AS hour, count(*) AS n, count(DISTINCT person) AS persons, avg(conf) AS conf FROM ev GROUP BY ALL ORDER BY hour DESC LIMIT 1000) SELECT round(avg(n), 6) AS mean_rate, round(avg(persons), 6) AS mean_persons, max(persons) AS peak_persons, round(avg(conf), 6) AS mean_conf FROM h",
    "dashboard_summary": f"WITH {_tot(V.DAY)}, p AS (SELECT *, lag(detections) OVER (PARTITION BY env ORDER BY bucket) AS d0 FROM tot WHERE camera = '__all__') SELECT env, bucket, detections, persons, floor(conf_sum / conf_n * 100 * 100 + 0.5::DOUBLE + 1e-7::DOUBLE) / 100 AS conf_pct, detections - d0 AS delta, floor((detections - d0) * 100.0::DOUBLE / d0 * 100 + 0.5::DOUBLE + 1e-7::DOUBLE) / 100 AS delta_pct FROM p",
    "percentile_exact": f"WITH {E_}, l AS (SELECT camera, list_sort(list(y)) AS a, avg(y) AS m, quantile_cont(y, 0.95) AS q FROM ev GROUP BY camera) SELECT camera, round(m, 6) AS mean, round(a[least(floor(len(a) * 0.95::DOUBLE)::BIGINT, len(a) - 1) + 1], 6) AS p95, round(a[least(floor(len(a) * 0.99::DOUBLE)::BIGINT, len(a) - 1) + 1], 6) AS p99, round(q, 6) AS p95_interpolated FROM l",
    "running_mean": f"WITH {E_} SELECT id, round(avg(y) OVER w, 9) AS mean, floor(avg(y) OVER f * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS avg5, floor(median(y) OVER f * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS median5, y AS latest FROM ev WINDOW w AS (PARTITION BY person ORDER BY us, id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY person ORDER BY us, id ROWS 4 PRECEDING)",
    "ema_metric": f"WITH RECURSIVE {E_}, t AS (SELECT env, row_number() OVER (PARTITION BY env ORDER BY us // 86400000000) AS r, count(*)::DOUBLE AS n FROM ev GROUP BY env, us // 86400000000), e AS (SELECT env, r, n AS v FROM t WHERE r = 1 UNION ALL SELECT t.env, t.r, 0.1::DOUBLE * t.n + 0.9::DOUBLE * e.v FROM e JOIN t ON t.env = e.env AND t.r = e.r + 1) SELECT env, max(r) AS days, round(arg_max(v, r), 6) AS ema FROM e GROUP BY env",
    "success_rates": f"WITH {E_} SELECT camera, round(greatest(count(*) - count(*) FILTER (event_type = 'error'), 0) / count(*)::DOUBLE, 6) AS success_rate FROM ev GROUP BY camera",
    "dataset_summary": f"WITH {E_} SELECT CASE WHEN id % 10 = 0 THEN 'query' WHEN id % 10 < 5 THEN 'gallery' ELSE 'train' END AS subset, count(DISTINCT track) AS ids, count(*) AS images, count(DISTINCT camera) AS cameras FROM ev GROUP BY 1",
    "weighted_accuracy": f"WITH {E_} SELECT round(count(*) FILTER (conf >= 0.5::DOUBLE) / count(*)::DOUBLE, 8) AS top1, count(DISTINCT id // 64) AS batches FROM ev",
    "playback_transitions": f"WITH {E_}, l AS (SELECT event_type, lag(event_type) OVER (PARTITION BY person ORDER BY us, id) AS before FROM ev) SELECT before, event_type, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY ALL",
    "scalar_histogram": f"WITH {E_}, m AS (SELECT min(y) AS lo, max(y) AS hi FROM ev) SELECT least(floor((y - lo) * 20 / (hi - lo)), 19)::BIGINT AS bin, count(*) AS n, round(sum(y), 4) AS total, round(sum(y * y), 2) AS squares FROM ev, m GROUP BY 1",
    "health_rollup": f"WITH {E_}, l AS (SELECT *, {_NEWEST.format(k='env, camera')} AS r FROM ev) SELECT env, ['healthy', 'degraded', 'unhealthy'][max(CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) + 1] AS status FROM l WHERE r = 1 GROUP BY env",
    "error_stats": f"WITH {E_}, l AS (SELECT *, {_NEWEST.format(k='camera')} AS r FROM ev WHERE event_type = 'error'), t AS (SELECT camera, string_agg(id::VARCHAR, ',' ORDER BY r) AS last_ids FROM l WHERE r <= 10 GROUP BY camera) SELECT camera, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 6) AS recovery, any_value(last_ids) AS last_ids FROM ev JOIN t USING (camera) WHERE event_type IN ('error', 'purchase') GROUP BY camera",
    "source_priority": f"WITH {E_} SELECT person, coalesce(max(us) FILTER (id % 5 = 0), min(us)) AS us, CASE WHEN count(*) FILTER (id % 5 = 0) > 0 THEN 'cache' ELSE 'db' END AS source FROM ev GROUP BY person",
    "metric_history": f"WITH {E_}, l AS (SELECT event_type, {_NEWEST.format(k='event_type')} AS r, id, y FROM ev) SELECT * FROM l WHERE r <= 100",
    "resource_status": f"WITH {E_} SELECT CASE WHEN conf >= 0.9::DOUBLE THEN 'critical' WHEN conf >= 0.7::DOUBLE THEN 'warning' ELSE 'healthy' END AS level, CASE WHEN event_type = 'error' THEN 'high' WHEN event_type IN ('signup', 'purchase') THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM ev GROUP BY ALL",
}
