import zlib

import numpy as np
from pyspark.sql import functions as F

from trackmill.llm import langid

WORDS = {"aa": ["kivo", "laru", "mepi", "sota"], "bb": ["ghurt", "strand", "blix", "quorn"], "cc": ["éclo", "ñaze", "çoul", "été"]}


def rows(n=240, seed=0):
    rng = np.random.default_rng(seed)
    kinds = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[kinds[i % 3]], size=int(rng.integers(3, 60)))), kinds[i % 3], "s") for i in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    data = rows() + [(1000, None, "aa", None), (1001, "", "bb", None), (1002, "12 34 !!", "cc", None), (1003, "日本語の文章です。" * 20, None, None), (None, "laru kivo mepi", None, None), (5, "kivo " * 200000, None, None), (5, "kivo " * 200000, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = langid.learned(docs)
    assert model.labels == ["aa", "bb", "cc"]
    got = langid.predict(docs.select("doc_id", "text", "lang", F.lit("x").alias("known")), model).collect()
    assert len(got) == len(data) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "known", "accepted"}
    for r in got:
        if not r.text or not langid.has_letter(r.text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        elif r.doc_id == 1003:
            assert r.lang_pred in model.labels and not r.accepted
        else:
            assert r.lang_pred == (r.lang or "aa") and r.accepted and 0.5 < r.score <= 1


def test_never_learns_from_the_held_out_fold(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    out = [r[0] for r in data if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    got = docs.where(langid.remainder() == 2)
    assert sorted(r.doc_id for r in got.collect()) == sorted(out)
    noise = docs.withColumn("lang", F.when(langid.remainder() == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.learned(docs), langid.learned(noise)
    assert a.labels == b.labels and np.array_equal(a.table, b.table) and a.temperature == b.temperature


def test_empty_and_stage(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.predict(empty, langid.learned(empty)).count() == 0
    one = spark.createDataFrame([(1, "abc", None, None, 3)], empty.schema)
    assert langid.predict(one, langid.learned(one)).first().lang_pred == "und"
    docs = spark.createDataFrame([(*r[:3], r[3], len(r[1])) for r in rows()] + [(999, "123", "aa", "s", 3)], empty.schema)
    kept = langid.identify_language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 240


def test_subwords_in_parts_are_the_same():
    text = "the Quick, brown 12 fox é " * 50
    whole = np.sort(np.concatenate(list(langid.subwords(text))))
    parts = np.sort(np.concatenate(list(langid.subwords(text, step=64))))
    assert np.array_equal(whole, parts)


def test_training_on_repeated_long_and_many_rows(spark, monkeypatch):
    # a row that is repeated often takes one place of the sample; texts beyond the bytes are left out whole
    data = rows(120) + [(5000, "kivo laru " * 30, "aa", "s")] * 400 + [(6000, "quorn blix " * 40000, "bb", "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = langid.train(docs, F.lit(True), per_language=60)
    plain = langid.train(docs.distinct(), F.lit(True), per_language=60)
    assert model.labels == ["aa", "bb", "cc"] and np.array_equal(model.bias, plain.bias)
    few = langid.train(docs, F.lit(True), per_language=60, sample_bytes=4000)
    assert few.labels == ["aa", "bb", "cc"]
    monkeypatch.setattr(langid, "PARTS", 1)
    one = langid.train(docs, F.lit(True), per_language=60, sample_bytes=4000)
    assert np.array_equal(one.bias, few.bias)


def test_labels_take_turns():
    sizes = [{"label": y, "h": h, "t": h, "size": 100 if y == "a" else 30} for y in "abc" for h in range(5)]
    got = langid.in_turn(sizes, 400)
    assert got[:3] == [("a", 0, 0), ("b", 0, 0), ("c", 0, 0)]
    assert [x[1] for x in got if x[0] == "b"] == [0, 1, 2] == [x[1] for x in got if x[0] == "c"]
    assert [x[1] for x in got if x[0] == "a"] == [0, 1]  # 80 bytes are left where its third comes
    assert {x[0] for x in langid.in_turn(sizes, 1)} == {"a", "b", "c"} and langid.in_turn([], 9) == []
