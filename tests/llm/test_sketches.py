import hashlib
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackmill.llm import sketches


def brute_sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    chain = lambda hs: __import__("functools").reduce(lambda seed, h: xxhash.xxh64_intdigest(struct.pack("<Q", h), seed), hs, 42)
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    s = [chain(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [chain(h)] if h else []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted({signed(x) for x in s if x < 1 << 61} | ({signed(min(s))} if s else set()))


def brute(rows):
    signed = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    out = []
    like = lambda a, b: len(set(a) & set(b)) / min(len(a), len(b)) if min(len(a), len(b)) else float(len(a) == len(b))
    text = lambda s: ".".join(f"{x % (1 << 64):016x}" for x in s)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(a, b), like(a, c)))
    return out


@pytest.mark.parametrize("size, many", [(500, 2000), (3, 4)])
def test_against_brute_force(spark, tmp_path, monkeypatch, size, many):
    monkeypatch.setattr(sketches, "RANGE", size)
    monkeypatch.setattr(sketches, "RANGES", many)
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(rng.choice(["The", "été", "x", "日本", "word", "\n"], size=rng.integers(1, 200)))) for i in np.r_[rng.permutation(60), 10**12, 10**12 + 5]]
    rows += [(70, None), (71, ""), (72, "one"), (73, "one two"), (73, "one two"), (73, "other"), (None, "a b c d e f"), (None, None), (None, "zzz"), (-(2**62), "low"), (74, "long text " * 30000)]
    spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, k_text string, h int").write.parquet(f"{tmp_path}/documents.parquet")
    got = list(map(tuple, sketches.op8_fingerprints(spark, str(tmp_path)).collect()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_one_and_none(spark, tmp_path):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = sketches.fingerprints(one).first()
    assert r.edited == "a b c d e f a b" and r.sketch == r.next_sketch
    assert sketches.fingerprints(one.limit(0)).count() == 0


def test_merge_is_the_sketch_of_the_whole(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    r = df.select(sketches.merged(F.col("a"), F.col("b")).alias("m"), sketches.containment(F.col("b"), sketches.merged(F.col("a"), F.col("b"))).alias("c"), "a", "b").first()
    assert r.m == sorted(x for x in {*r.a, *r.b} if 0 <= x < 1 << 61) and r.c > 0


def test_short_texts_merge_to_the_sketch_of_their_shingles(spark):
    # few shingles, most above the threshold on both sides: the unsigned smallest counts
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], size=int(n))) for n in rng.integers(0, 12, size=120)]
    pairs = list(zip(texts[::2], texts[1::2]))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", sketches.merged(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("m")).collect()

    def every(text):  # all shingle hashes, unsigned
        words = text.split()
        chain = lambda hs: __import__("functools").reduce(lambda seed, h: xxhash.xxh64_intdigest(struct.pack("<Q", h), seed), hs, 42)
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        return {chain(h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {chain(h)} if h else set()

    high = 0
    for r in got:
        union = every(r.a) | every(r.b)
        below = {x for x in union if x < 1 << 61}
        want = below or ({min(union)} if union else set())
        high += not below
        assert {x % (1 << 64) for x in r.m} == want
    assert high > 10


def test_skewed_ids_spread(spark, monkeypatch):
    # a third of the rows have one id, a third none, and one id lies far off
    monkeypatch.setattr(sketches, "RANGE", 20)
    rows = [(7, f"text {i}") for i in range(400)] + [(None, f"none {i}") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(400)] + [(2**62, "far")]
    df = spark.createDataFrame(rows, "k_id long, k_text string").withColumn("h", F.xxhash64("k_text"))
    bucket, n = sketches._buckets(df.select("k_id", "h"))
    sizes = df.withColumn("bucket", bucket).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) < 60 and all(0 <= r.bucket < n for r in sizes)
    order = df.withColumn("bucket", bucket).collect()
    order = sorted(order, key=lambda r: (r.k_id is not None, r.k_id or 0, r.h))
    assert [r.bucket for r in order] == sorted(r.bucket for r in order)


def test_one_row_repeated_often(spark, monkeypatch):
    """A row that is most of the table is held once; every copy but the last is followed by its like."""
    monkeypatch.setattr(sketches, "COPIES", 700)
    rows = [(5, "the row that is there again and again é")] * 10_000 + [(i, f"text {i} " * 9) for i in range(20)] + [(None, "none")] * 3 + [(5, "another"), (5, None), (5, "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, copies string")
    got = [(r.doc_id, r.n_chars, r.edited, r.sketch == r.next_sketch) for r in sketches.fingerprints(df).collect()]
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = []
    for a, b in zip(order, order[1:] + order[:1]):
        cut = len(a.t) // 4
        want.append((a.doc_id, len(a.t), a.t[: len(a.t) - cut] + b.t[:cut]))
    assert sorted(map(repr, want)) == sorted(repr(r[:3]) for r in got)
    assert sum(r[3] for r in got if r[0] == 5 and r[1] == len(rows[0][1])) == 9_999
