import hashlib
from collections import Counter

import numpy as np
import pytest

from trackmill.llm import repeats


def brute(rows, least, keep="none"):
    texts = [(t or "").encode() for _, t in rows]
    places = {}
    for d in sorted(range(len(rows)), key=lambda d: (rows[d][0] is not None, rows[d][0] or 0)):
        for i in range(len(texts[d]) - least + 1):
            places.setdefault(texts[d][i : i + least], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found[keep == "first" :]:
                gone[d][i : i + least] = True
    out = []
    for (doc, _), t, g in zip(rows, texts, gone):
        runs = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        out.append((doc, len(t), int(g.sum()), runs, hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdeé \n"), size=n))
    shared = [text(150) for _ in range(4)]
    rows = [(i, text(int(rng.integers(0, 400)))) for i in range(20)]
    for i in range(20, 60):
        s = shared[i % 4]
        lo = int(rng.integers(0, 60))
        rows.append((i, text(int(rng.integers(0, 80))) + s[lo : lo + int(rng.integers(50, 150))] + text(int(rng.integers(0, 80)))))
    rows += [(60, None), (61, ""), (62, "a" * 300), (63, "ab" * 120), (64, rows[3][1]), (65, "short"), (66, "short"), (67, text(90) + rows[5][1]), (68, shared[0] * 3)]
    return rows


@pytest.mark.parametrize("keep, split", [("none", 2000), ("none", 2), ("first", 2000), ("first", 2)])
def test_against_brute_force(spark, keep, split):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, k string, a int")
    got = repeats.remove_repeats(df, least=40, gram=8, keep=keep, split=split).collect()
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(got) == sorted(brute(rows, 40, keep))


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "xyz" * 30), (1, "qrs" * 2 + "long text without an end, to the end"), (None, "qrs" * 2 + "long text without an end, to the end"), (None, "t"), (2, "same row twice, the same row twice, same"), (2, "same row twice, the same row twice, same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove_repeats(df, least=30, gram=8).collect())
    assert got == Counter(brute(rows, 30))
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_anchors_in_parts(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 100, size=5000, dtype=np.uint8))
    whole = [np.concatenate(x) for x in zip(*repeats.anchors(data, 50, 8))]
    assert whole[3].sum() == len(data) - 49 and (np.diff(whole[2]) == whole[3][:-1]).all()
    monkeypatch.setattr(repeats, "PART", 700)
    parts = [np.concatenate(x) for x in zip(*repeats.anchors(data, 50, 8))]
    assert parts[3].sum() == len(data) - 49
    at = lambda x: dict(zip(x[2].tolist(), x[0].tolist()))
    assert all(at(parts).get(k, v) == v for k, v in at(whole).items())


def test_a_row_repeated_many_times_gives_each_range_once(spark):
    text = "some words that stand here, over and over again, in every one of these rows; " * 3
    df = spark.createDataFrame([(1, text)] * 50 + [(2, "x" + text)] * 50, "doc_id long, text string")
    got = repeats.remove_repeats(df, least=30, gram=8).collect()
    assert len(got) == 100 and len({(r.doc_id, bytes(r.kept)) for r in got}) == 2
    ranges = repeats.repeated(df, "doc_id", "text", 30, 8, "none", 2000)
    assert ranges.distinct().groupBy("k", "t").count().agg({"count": "max"}).first()[0] <= len(text)
