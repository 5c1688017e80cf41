from trackmill.operators import reports

NAMES = "env string, detections long, conf double, persons long, seconds double, profiles long, anomalies long, speed double, dwell double, rate double, hour_conf double, peak long"


def test_rules_and_types(spark):
    f = spark.createDataFrame([("a", 12, 0.654, 3, 29.96, 0, 0, None, None, 0.126, 0.5, 2), ("b", 1, 0.7, 1, 30.0, 1, 1, 2.0, 3.0, 1.0, 0.7, 1)], NAMES)
    got = {(r["report_type"], r["env"]): (r["insights"], r["recommendations"]) for r in reports.reports(f, ("summary", "performance", "unheard of")).collect()}
    assert set(got) == {(t, e) for t in ("summary", "performance") for e in "ab"}
    assert got["summary", "a"] == ("Total detections: 12; Average confidence: 0.65; Total persons tracked: 3; Average tracking time: 30.0s", f"{reports.UNSURE}; {reports.SHORT}")
    assert got["summary", "b"][1] == "" and got["performance", "a"][0].startswith("Average detection rate: 0.13 ")
    assert reports.reports(f, ("unheard of",)).count() == 0
    assert reports.reports(f).count() == 6 and reports.reports(f.where("false")).count() == 0
