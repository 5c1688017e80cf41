import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.llm import toxicity

DATA = "/root/testdata/sf0.1"


def corpus(n=240, seed=5):
    """Texts of made-up words; every fourth holds some of four words that mark it, among the others."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(20, 200)))
        if i % 4 == 0:
            for _ in range(2 + len(text) // 25):
                text.insert(rng.integers(len(text)), rng.choice(["zorgle", "zorgling", "quamp", "VILOX"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    return docs, labels


def run(spark, docs, labels, **more):
    d = spark.createDataFrame([(*r, 0.5, "clash") for r in docs], "doc_id long, text string, score double, y string")
    x = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, toxic int, text int")
    return toxicity.score_toxicity(d, x, F.coalesce(toxicity.fold(F.col("doc_id")) != 0, F.lit(False)), **more).collect()


def test_held_out(spark):
    docs, labels = corpus()
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    found = {r["doc_id"]: r for r in run(spark, docs, labels)}
    assert len(found) == len(docs)
    right = [(found[i]["score"] >= 0.5) == bool(y) for i, y in labels if i in held]
    assert np.mean(right) > 0.95
    assert all(e["doc_id"] not in held and -1e-9 <= e["cosine"] <= 1 + 1e-9 for r in found.values() for e in r["evidence"])
    # labels of held-out rows have no part
    other = {r["doc_id"]: r["score"] for r in run(spark, docs, [(i, 1 - y if i in held else y) for i, y in labels])}
    assert other == {i: r["score"] for i, r in found.items()}


def test_edges(spark):
    docs, labels = corpus(120)
    more = [(None, "zorgle quamp vilox zorgle"), (None, None), (1000, ""), (1001, " \n 12 --"), (1002, "zorgle " * 300_000), (1003, "x" * 3_000_000), (1004, None), (3, docs[3][1]), (3, docs[3][1])]
    found = run(spark, docs + more, labels + [(None, 1), (7, None), (8, 5), (8, 0), (9, 1), (99999, 1)])
    assert len(found) == len(docs) + len(more)
    assert all(0 <= r["score"] <= 1 for r in found)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[3]) == 1 and len(by[None]) == 2
    assert by[1000] == by[1001] == by[1004] and next(iter(by[1002])) > 0.5 > next(iter(by[1003]))


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(40)], [(i, 1) for i in range(40)]])
def test_no_or_one_label(spark, labels):
    docs, _ = corpus(40)
    found = {round(r["score"], 6) for r in run(spark, docs, labels)}
    assert found == {1.0 if any(y for _, y in labels) else 0.0}
    assert run(spark, [], labels) == []


def test_nearest_against_all_cosines():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(700):
        at = sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist()) + [30]
        rows.append((at, rng.integers(1, 9, len(at)).tolist(), int(rng.integers(2)), i))
    rows += rows[:50]
    weight = rng.uniform(1, 5, 31)
    index = toxicity.build(rows, weight, {0: 1.0, 1: 1.0})
    dense = index.postings.T
    for b in range(index.bound.shape[1]):
        assert (dense[b * toxicity.BLOCK : (b + 1) * toxicity.BLOCK].max(axis=0) == index.bound[:, b]).all()
    assert np.allclose((dense**2).sum(axis=1), 1) and index.mass.sum() == len(rows)
    opened = 0
    for at, counts, *_ in rows[:200]:
        at, v = index.unit(at, counts)
        cosines = dense[:, at] @ v
        near, best, n = index.nearest(at, v)
        opened += n
        assert np.allclose(best, np.sort(cosines)[::-1][: len(best)], atol=1e-12) and np.allclose(cosines[near], best, atol=1e-12)
    assert opened < 200 * index.bound.shape[1]


def test_pieces_cut_no_word():
    text = "ab cde " * 50 + "y" * 40 + " f"
    assert "".join(toxicity.pieces(text, 7)) == text
    whole = toxicity._WORD.findall(text)
    assert [w for p in toxicity.pieces(text, 7) for w in toxicity._WORD.findall(p)] == whole


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_accuracy_on_given_tables(spark):
    found = toxicity.op13_toxicity(spark, DATA).where("held_out")
    both = found.join(spark.read.parquet(f"{DATA}/labels.parquet").where("toxic IS NOT NULL"), "doc_id").select("predicted", "toxic").toPandas()
    right = (both["predicted"] == both["toxic"]).mean()
    hit = both.loc[both["toxic"] == 1, "predicted"].mean()
    assert right > 0.97 and hit > 0.9
