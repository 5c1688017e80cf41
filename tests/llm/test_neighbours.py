import numpy as np

from trackmill.llm import neighbours


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(v, dtype=float) - np.array(x, dtype=float)) ** 2).sum())), i) for i, x in rows if i != q)
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 24))
    x = (centre[rng.integers(20, size=1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, score int")
    asked = df.where("vec_id % 50 = 0")
    got = sorted(map(tuple, neighbours.nearest_neighbours(df, asked).collect()))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert len(got) == len(want)
    assert len({g[::2][:2] for g in got} & {w[::2][:2] for w in want}) >= 0.9 * len(want)
    for g in got:
        assert abs(g[3] - np.linalg.norm(x[g[0]].astype(float) - x[g[2]].astype(float))) < 1e-12
    by = {}
    for g in sorted(got, key=lambda g: g[:2]):
        by.setdefault(g[0], []).append((g[3], g[2]))
    assert all(v == sorted(v) and len(v) == 10 for v in by.values())


def test_ties_copies_and_unusable_rows(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(5, [1.0, 0.0, 0.0]), (100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 0.0]), (103, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0]), (104, []), (105, [1.0, 0.0]), (106, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest_neighbours(df, df.where("vec_id in (0, 100, 101, 105, 106)"), k=3).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0), (106, 1, 0, 2.0), (106, 2, 1, 2.0), (106, 3, 2, 2.0)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1.0, -2.5])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.nearest_neighbours(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert neighbours.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_hadamard_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)


def test_hot_codes_are_cut_on_both_sides(spark, monkeypatch):
    # half of the rows lie in one small cluster, and so do most queries
    monkeypatch.setattr(neighbours, "SLAB", 50)
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    x = np.concatenate((one + 0.01 * rng.normal(size=(400, 16)), rng.normal(size=(400, 16))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id < 120 OR vec_id % 50 = 0")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(df, asked).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, [r for r in rows if r[0] < 120 or r[0] % 50 == 0], 10)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_codes_grow_with_the_rows_and_queries_meet_a_smaller_share():
    assert [neighbours.code_bits(n) for n in (0, 1, 2000, 10_000, 50_000, 10**9)] == [7, 7, 12, 13, 14, 20]
    assert neighbours.axes(64, 12) == [64, 16] and neighbours.axes(64, 14) == [64, 64] and neighbours.axes(64, 15) == [64, 64, 1]
    rng = np.random.default_rng(6)
    shares = []
    for n in (1000, 8000):
        x = rng.normal(size=(n, 64))
        own = neighbours.codes(x, 6, neighbours.code_bits(n), 1)[:, :, 0]
        asked = neighbours.codes(x[:20], 6, neighbours.code_bits(n), neighbours.PROBES)
        shares.append(np.mean([(own[:, t, None] == asked[i, t]).any(axis=1).mean() for i in range(20) for t in range(6)]))
    assert shares[1] < 0.7 * shares[0]
