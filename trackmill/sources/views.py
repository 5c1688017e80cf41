"""Canonical views of the driver's tables, as DataFrames and as SQL.

Times are epoch microseconds (`us`), so that no session time zone matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.sources.tables import table

HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(ts: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def tracking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking events: person, track, camera, environment, position, confidence and session."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), micros("ts").alias("us"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("person"), F.col("user_id").alias("track"),
        F.concat(F.lit("c0"), (F.col("event_id") % 4 + 1).cast("string")).alias("camera"), F.when(F.col("user_id") % 2 == 0, F.lit("campus")).otherwise(F.lit("factory")).alias("env"),
        "event_type", k.alias("x"), F.col("value").alias("y"), (k / 100).alias("conf"), F.date_format("ts", "yyyy-MM-dd").alias("session"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: frame number and box in pixels, beside what the event has."""
    e = tracking_events(spark, sf_dir)
    x1, y1 = F.col("x") * 10, F.col("y")
    return e.select("id", "us", "person", "track", "camera", "env", "conf", (F.col("id") % 1000).alias("frame"), x1.alias("x1"), y1.alias("y1"), (x1 + 40 + F.col("id") % 20).alias("x2"), (y1 + 100 + F.col("track") % 30).alias("y2"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each person in time order, numbered from 0 (column n)."""
    from pyspark.sql import Window

    w = Window.partitionBy("person").orderBy("us", "id")
    return tracking_events(spark, sf_dir).withColumn("n", (F.row_number().over(w) - 1).cast("long"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position for each environment, hour, camera and track: that of the largest id."""
    e = tracking_events(spark, sf_dir).withColumn("frame", F.floor(F.col("us") / HOUR))
    best = F.max_by(F.struct("id", "x", "y", "conf", "person"), "id").alias("b")
    return e.groupBy("env", "frame", "camera", "track").agg(best).select("env", "frame", "camera", "track", "b.*")


#: Zones of the campus: name and rectangle.
ZONES = (("gate", 0.0, 0.0, 50.0, 125.0), ("hall", 50.0, 0.0, 100.0, 125.0), ("yard", 0.0, 125.0, 50.0, 500.0), ("dock", 50.0, 125.0, 100.0, 500.0))
#: Retention: environment, days to delete, to archive, to compress.
POLICIES = (("default", 90, 30, 7), ("campus", 180, 60, 14), ("factory", 60, 15, 3))
#: Homographies image to world, row by row, for each camera.
HOMOGRAPHIES = (
    ("c01", 1.0, 0.1, 5.0, 0.05, 1.1, -3.0, 0.0001, 0.0002, 1.0), ("c02", 0.9, -0.1, 12.0, 0.02, 1.2, 4.0, 0.0002, 0.0001, 1.0),
    ("c03", 1.2, 0.05, -7.0, -0.03, 0.95, 9.0, 0.0001, 0.0001, 1.0), ("c04", 1.05, 0.0, 0.0, 0.1, 1.0, 2.0, 0.0003, 0.00005, 1.0),
)


def literal(spark: SparkSession, rows, names: str) -> DataFrame:
    """A few literal rows as a local relation."""
    return spark.sql(f"SELECT * FROM VALUES {values(rows)} AS t({names})")


def values(rows) -> str:
    """Literal rows in SQL that both engines read alike."""
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


EVENTS_SQL = """ev AS (
  SELECT event_id AS id, epoch_us(ts) AS us, 'P' || user_id AS person, user_id AS track, 'c0' || (event_id % 4 + 1) AS camera,
    CASE WHEN user_id % 2 = 0 THEN 'campus' ELSE 'factory' END AS env, event_type,
    json_extract_string(props, '$.k')::DOUBLE AS x, value AS y, json_extract_string(props, '$.k')::DOUBLE / 100 AS conf, strftime(ts, '%Y-%m-%d') AS session
  FROM events)"""
DETECTIONS_SQL = EVENTS_SQL + """, det AS (
  SELECT id, us, person, track, camera, env, conf, id % 1000 AS frame, x * 10 AS x1, y AS y1, x * 10 + 40 + id % 20 AS x2, y + 100 + track % 30 AS y2 FROM ev)"""
POINTS_SQL = EVENTS_SQL + """, pt AS (
  SELECT *, row_number() OVER (PARTITION BY person ORDER BY us, id) - 1 AS n FROM ev)"""
FRAMES_SQL = EVENTS_SQL + """, fr AS (
  SELECT env, us // 3600000000 AS frame, camera, track, max(id) AS id, max_by(x, id) AS x, max_by(y, id) AS y, max_by(conf, id) AS conf, max_by(person, id) AS person
  FROM ev GROUP BY ALL)"""
