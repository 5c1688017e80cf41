"""Queries on tables with larger keys, equal vectors and crowded frames, against their SQL."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_queries import DATA, plain
from trackmill.operators import identity, mot, slabs, supplements
from trackmill.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def against(spark, folder, name, **tables):
    """The rows of a query over tables given as SQL over the smallest tables, after they were held against its SQL."""
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW small_{t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        con.execute(f"COPY ({tables.get(t, f'SELECT * FROM small_{t}')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rows = catalogue.QUERIES[name](spark, str(folder)).collect()
    if name in catalogue.SQL:
        found = con.execute(catalogue.SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, r)) for r in found.fetchall())
    return rows


def test_identities_of_five_digits(spark, tmp_path):
    rows = against(spark, tmp_path, "reid_paths", events="SELECT * REPLACE (user_id + 12340 AS user_id) FROM small_events")
    assert {r["pid"] for r in rows} == {12340 + k for k in range(15) if k % 10}


#: Vectors of a few kinds, so that most meet equal ones, in an order that isn't that of their ids.
EQUAL = "SELECT a.vec_id, b.embedding, a.label FROM small_embeddings a JOIN small_embeddings b ON b.vec_id = (a.vec_id * 7 + a.vec_id // 100) % 23"
RANKED = ("reid_distance_topk", "submission_topk", "knn_handoff", "lambda_sweep", "rerank", "reid_map", "reid_by_query", "reid_cmc", "reid_roc", "recall_at_k", "matched_results", "reid_sampled_gallery", "query_expansion")


@pytest.mark.parametrize("name", RANKED)
def test_equal_vectors_in_small_slabs(spark, tmp_path, monkeypatch, name):
    for part, size in (("QUERIES_", 20), ("GALLERY", 70), ("BLOCK", (3, 50)), ("RANKED", 5000)):
        monkeypatch.setattr(slabs, part, size)
    against(spark, tmp_path, name, embeddings=EQUAL)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", RANKED)
def test_no_row_for_each_pair(spark, tmp_path, name):
    """Pairs of queries and gallery rows are compared in blocks within a task, and don't pass from operator to operator."""
    read = plan_of(catalogue.QUERIES[name](spark, DATA))
    assert "zip_with" not in read or name == "reid_sampled_gallery"


def test_rows_without_a_number_or_a_vector():
    u, none = slabs.unpacked(pa.array([[3.0, 4.0], None, [0.0, 0.0], [4.0, 3.0]]))
    assert none.tolist() == [False, True, False, False]
    r, c, x = slabs.nearest(u, u, 4, none, none)
    assert [(int(a), int(b)) for a, b in zip(r, c)][:4] == [(0, 2), (0, 0), (0, 3), (0, 1)]  # as ORDER BY sim DESC has them
    assert x[1] == 1.0 and x[2] == 0.96 and np.isposinf(x[0]) and np.isneginf(x[3])


#: Events that fall on few hours and places, so that frames are crowded and distances are equal.
CROWDED = "SELECT event_id + 1000 * k AS event_id, date_trunc('day', ts) + INTERVAL (event_id % 3) HOUR AS ts, user_id + 15 * k AS user_id, event_type, floor(value / 8) * (1 + k % 2) AS value, props FROM small_events, range(0, 4) r(k)"


@pytest.mark.parametrize("name", ["buffer_match", "buffer_claims", "frame_offset_join"])
def test_crowded_frames(spark, tmp_path, monkeypatch, name):
    from trackmill.operators import buffers

    monkeypatch.setattr(buffers, "BLOCK", 7)
    assert against(spark, tmp_path, name, events=CROWDED)
    assert plan_of(catalogue.QUERIES[name](spark, str(tmp_path))).count("Join Inner") == (name == "frame_offset_join")


def test_frames_are_counted_before_they_meet(spark):
    plan = plan_of(catalogue.QUERIES["frame_offset_join"](spark, DATA))
    assert plan.split("Join Inner, (frame")[-1].count("Aggregate") >= 2


def test_identities_of_many_tracks(spark):
    n = 100_000  # a matrix of them would have 80 GB
    pairs = spark.range(n).select(F.lit("c").alias("camera"), F.col("id").alias("track"), F.explode(F.array(F.col("id"), F.col("id") + n * (F.col("id") % 3 == 0).cast("int"))).alias("hyp"), (1 + F.col("id") % 5).alias("n")).distinct()
    counts = spark.createDataFrame([("c", n, n)], "camera string, truths long, hyps long")
    assert supplements.identity_f1(pairs, counts).first()["idtp"] == sum(1 + i % 5 for i in range(n))


def test_trees_against_the_assignment():
    pick = random.Random(6)
    for _ in range(200):
        a, b = [0], [0]
        for _ in range(pick.randrange(9)):  # each new node hangs on one of the other side
            if pick.random() < 0.5:
                a, b = [*a, max(a) + 1], [*b, pick.choice(b)]
            else:
                a, b = [*a, pick.choice(a)], [*b, max(b) + 1]
        n = np.array([pick.randrange(1, 9) for _ in a])
        cost = np.zeros((max(a) + 1, max(b) + 1))
        cost[a, b] = -n
        assert mot.most_in_tree(np.array(a), np.array(b), n) == -sum(cost[i, j] for i, j in identity.assign(cost))


def test_sets_of_cameras_meet_by_their_sets(spark, tmp_path):
    few = "SELECT event_id * 2 + (user_id + event_id // 97) % 2 AS event_id, TIMESTAMP '2024-01-05 01:00:00' AS ts, event_id // 3 AS user_id, event_type, value, props FROM small_events"
    assert len(against(spark, tmp_path, "camera_sets", events=few)) > 1000
    plan = catalogue.QUERIES["camera_sets"](spark, DATA)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    pairs = [x for x in plan.splitlines() if "Join" in x and "person" in x]
    assert pairs and all("NestedLoop" not in x and "Cartesian" not in x for x in pairs)


def test_boxes_of_crowded_slots(spark, tmp_path):
    assert len(against(spark, tmp_path, "grid_associate", events=CROWDED)) > 500
    plan = plan_of(catalogue.QUERIES["grid_associate"](spark, DATA))
    assert "Join" not in plan and "Generate" not in plan


def test_persons_without_a_vector_keep_their_ids(spark, tmp_path):
    rows = against(spark, tmp_path, "stream_reid_ids", embeddings="SELECT * FROM small_embeddings WHERE vec_id % 3 = 0")
    assert len(rows) > 900


def test_vectors_are_not_moved_with_each_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slabs, "GALLERY", 100)
    against(spark, tmp_path, "jaccard_blend")
    assert "zip_with" not in plan_of(catalogue.QUERIES["jaccard_blend"](spark, DATA))
