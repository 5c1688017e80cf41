import numpy as np
import pytest

from trackmill.llm import simhash


def brute(rows, radius=4):
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    label = {k: k for k in range(len(fps))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                label[root(a)] = root(b)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(root(k), []).append(fps[k][0])
    return sorted((fps[k][0], f"{fps[k][1]:016x}", min(groups[root(k)])) for k in range(len(fps)))


def test_fingerprint_known_hash():
    import xxhash

    assert simhash.fingerprint("One\tTWO") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("É a b c d") != simhash.fingerprint("é a b c d")  # only A-Z are lower-cased


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.integers(500)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(200))] = "x"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (1003, "one"), (1004, "a b " * 20000)]
    df = spark.createDataFrame([(i, t, i * 2, "z") for i, t in rows], "doc_id long, text string, fp long, k_id string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    assert got == brute(rows)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in got}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_large_group_is_split(n):
    rng = np.random.default_rng(5)
    base = np.uint64(0x123456789ABCDEF0)
    fp = np.unique(np.array([int(base) ^ sum(1 << int(b) for b in rng.choice(40, int(rng.integers(0, 7)), replace=False)) for _ in range(n)], dtype=np.uint64))
    a, b = simhash._links(np.zeros(len(fp), dtype=int), fp, np.arange(len(fp)), 4)
    label = simhash._forest(len(fp), a, b)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    # links are kept as a forest over each component: its edges join places of one component, not always within the radius
    assert np.array_equal(label, simhash._forest(len(fp), i, j))


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rng = np.random.default_rng(6)
    x, y, z = (" ".join(f"w{n}" for n in rng.integers(500, size=100)) for _ in range(3))
    rows = [(5, x), (9, x), (5, y), (1, y), (None, z), (None, z), (None, x)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, x), (1, y), (None, z)], key=str)
