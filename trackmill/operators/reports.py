"""Reports of an environment: figures, and the sentences and advice that rules draw from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.operators.sequence import SQL as SEQUENCE_SQL
from trackmill.operators.sequence import profiles
from trackmill.sources import views as V

#: Below these, a summary advises.
LOW_CONFIDENCE, SHORT_TRACKING = 0.7, 30
TYPES = ("summary", "behavior", "performance")
# What users of the reports look for, word by word.
UNSURE = "Consider adjusting detection thresholds to improve accuracy"
SHORT = "Short tracking times may indicate tracking issues"
BEHAVIOR_ADVICE = "Monitor high-anomaly score persons for security concerns; Optimize camera placement based on frequently visited areas"
PERFORMANCE_ADVICE = "Monitor system performance during peak hours; Consider load balancing for high-traffic periods"
SENTENCES = {
    "summary": "Total detections: %d; Average confidence: %.2f; Total persons tracked: %d; Average tracking time: %.1fs",
    "behavior": "Analyzed %d behavior profiles; Detected %d anomalies",
    "performance": "Average detection rate: %.2f detections/sec; Average confidence: %.2f; Peak concurrent persons: %d",
}


def facts(events: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each environment: detections, conf, persons, seconds (mean of last less first time of a person),
    profiles, anomalies, speed, dwell, rate (detections a second, mean of hours), hour_conf, peak (persons in an hour)."""
    one = events.groupBy("env", "person").agg(F.count("*").alias("n"), F.sum("conf").alias("c"), ((F.max("us") - F.min("us")) / 1e6).alias("s"))
    who = one.groupBy("env").agg(F.sum("n").alias("detections"), (F.sum("c") / F.sum("n")).alias("conf"), F.count("*").alias("persons"), F.avg("s").alias("seconds"))
    p = profiles(points).join(one.select("person", "env"), "person")
    how = p.groupBy("env").agg(F.count("*").alias("profiles"), F.count_if(F.round("score", 6) > 0.7).alias("anomalies"), F.avg("mean").alias("speed"), F.avg("dwell_s").alias("dwell"))
    hour = events.groupBy("env", F.floor(F.col("us") / V.HOUR).alias("hour")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.count_distinct("person").alias("persons"))
    when = hour.groupBy("env").agg((F.avg("n") / 3600).alias("rate"), F.avg("c").alias("hour_conf"), F.max("persons").alias("peak"))
    return who.join(how, "env", "left").join(when, "env").fillna(0, ["profiles", "anomalies"])


def reports(figures: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(report_type, env, insights, recommendations) for each environment and type; a type that isn't known gives
    no row. An environment without figures of a kind has no sentence about it."""
    say = lambda kind, *c: F.format_string(SENTENCES[kind], *c)
    advice = {
        "summary": F.concat_ws("; ", F.when(F.col("conf") < LOW_CONFIDENCE, UNSURE), F.when(F.col("seconds") < SHORT_TRACKING, SHORT)),
        "behavior": F.lit(BEHAVIOR_ADVICE), "performance": F.lit(PERFORMANCE_ADVICE),
    }
    said = {"summary": say("summary", "detections", "conf", "persons", "seconds"), "behavior": say("behavior", "profiles", "anomalies"), "performance": say("performance", "rate", "hour_conf", "peak")}
    one = lambda kind: F.struct(F.lit(kind).alias("report_type"), said[kind].alias("insights"), advice[kind].alias("recommendations"))
    known: list[Column] = [one(x) for x in types if x in TYPES]
    if not known:
        return figures.where("false").select(F.lit("").alias("report_type"), "env", F.lit("").alias("insights"), F.lit("").alias("recommendations"))
    return figures.select("env", F.explode(F.array(*known)).alias("r")).select("r.report_type", "env", "r.insights", "r.recommendations")


# --- queries

def analytics_reports(s: SparkSession, d: str) -> DataFrame:
    return reports(facts(V.tracking_events(s, d), V.points(s, d)))


def report_figures(s: SparkSession, d: str) -> DataFrame:
    f = facts(V.tracking_events(s, d), V.points(s, d))
    return f.select("env", "detections", "persons", "profiles", "anomalies", "peak", *[F.round(c, 4).alias(c) for c in ("conf", "seconds", "speed", "dwell", "rate", "hour_conf")])


QUERIES = {f.__name__: f for f in (analytics_reports, report_figures)}
_FACTS = f"""WITH {V.EVENTS_SQL}, bp AS ({SEQUENCE_SQL["behavior_profile"]}),
one AS (SELECT env, person, count(*) AS n, sum(conf) AS c, (max(us) - min(us)) / 1e6 AS s FROM ev GROUP BY env, person),
who AS (SELECT env, sum(n)::BIGINT AS detections, sum(c) / sum(n) AS conf, count(*) AS persons, avg(s) AS seconds FROM one GROUP BY env),
how AS (SELECT env, count(*) AS profiles, count(*) FILTER (anomalous) AS anomalies, avg(mean) AS speed, avg(dwell_s) AS dwell FROM bp JOIN one USING (person) GROUP BY env),
hour AS (SELECT env, us // 3600000000 AS h, count(*) AS n, avg(conf) AS c, count(DISTINCT person) AS persons FROM ev GROUP BY 1, 2),
pace AS (SELECT env, avg(n) / 3600 AS rate, avg(c) AS hour_conf, max(persons) AS peak FROM hour GROUP BY env)"""
SQL = {
    "analytics_reports": _FACTS + f""" SELECT 'summary' AS report_type, env, printf('{SENTENCES["summary"]}', detections, conf, persons, seconds) AS insights,
  concat_ws('; ', CASE WHEN conf < 0.7::DOUBLE THEN '{UNSURE}' END, CASE WHEN seconds < 30 THEN '{SHORT}' END) AS recommendations FROM who
UNION ALL SELECT 'behavior', env, printf('{SENTENCES["behavior"]}', profiles, anomalies), '{BEHAVIOR_ADVICE}' FROM how
UNION ALL SELECT 'performance', env, printf('{SENTENCES["performance"]}', rate, hour_conf, peak), '{PERFORMANCE_ADVICE}' FROM pace""",
    "report_figures": _FACTS + " SELECT env, detections, persons, profiles, anomalies, peak, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("conf", "seconds", "speed", "dwell", "rate", "hour_conf")) + " FROM who JOIN how USING (env) JOIN pace USING (env)",
}
