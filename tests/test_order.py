import random

import pytest

from trackmill.functions import order
from trackmill.operators.aggregates import at_places


@pytest.mark.parametrize("stretches", [1, 4, 1024])
def test_places_against_sorted_lists(spark, monkeypatch, stretches):
    monkeypatch.setattr(order, "STRETCHES", stretches)
    pick = random.Random(stretches)
    data = {"a": [pick.gauss(0, 9) for _ in range(300)], "ties": [float(pick.randrange(4)) for _ in range(200)], "one": [7.5], "far": [0.0] * 50 + [1e12], "same": [3.0] * 40}
    rows = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("a", None), ("none", None)], "k string, v double")
    asked = [(k, f"p{p}", p) for k, x in data.items() for p in {0, len(x) // 3, len(x) - 1, len(x), -1}] + [("none", "p0", 0), ("missing", "p0", 0)]
    got = {(r["k"], r["name"]): r["value"] for r in order.placed(rows, "k", "v", spark.createDataFrame(asked, "k string, name string, place long")).collect()}
    assert got == {(k, n): sorted(data[k])[p] for k, n, p in asked if k in data and 0 <= p < len(data[k])}


def test_shares_and_the_upper_median(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40)] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: (r["mid"], r["top"]) for r in at_places(rows, "k", "v", {"mid": None, "top": 0.99}).collect()}
    assert got == {"a": (30.0, 40.0), "b": (5.0, 5.0)}
    assert at_places(rows.where("false"), "k", "v", {"mid": None}).count() == 0
