import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackmill.llm import bpe, packing

PATH = public_tokenizers.path(bpe.TOKENIZER)
ODD = [
    None, "", " \n\t", "x" * 5000, "word, (word). I'M don't we’ll 1234 ½ ② _a_", "İstanbul ΣΑΣ ǅ Å", "a\x1cb ́x \xa0y　z​q",
    "<|ENDOFTEXT|> x A<|EndOfText|>, a " * 3, "<|endoftext|>a<|startoftext|> <|END <|endof" + "text|>" * 90, "日本語テキスト" * 300, "é" * 1000, "हिन्दी 👩‍👩‍👧 " * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = np.random.default_rng(2)
    shared = " ".join(f"word{i}, Next" for i in range(300))
    return ODD + [" ".join(map(str, rng.integers(1000, size=rng.integers(400)))) + shared for _ in range(20)]


@pytest.mark.parametrize("bits", [3, 9])
def test_same_ids_as_the_library(library, bits):
    e = bpe.Encoder(PATH)
    for _ in range(2):  # the second time from what is remembered
        want = [library.encode(x or "", add_special_tokens=False).ids for x in texts()]
        got = [x.tolist() for x in e.encode(texts(), bits)]
        assert got == want == [x.tolist() for x in e.encode_plain(texts())]
        e.most_words = e.most_chunks = 10
    assert [e.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_cuts_follow_content():
    a = ("lorem ipsum é dolor " * 7 + "".join(chr(97 + i * i % 26) for i in range(9000))).encode()
    b = b"something else in front " + a
    chunks = lambda x: {x[i:j] for i, j in zip([0, *bpe.cuts(x)], bpe.cuts(x))}
    assert len(chunks(a) & chunks(b)) >= len(chunks(a)) - 2
    assert all(c.decode() is not None for c in chunks(a))


def test_query_columns(spark, library, tmp_path):
    rows = [(i, t, "x", 3) for i, t in enumerate(texts())] + [(None, "a", "y", 1), (3, "x y", None, None), (3, "x y", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, k_id int").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, bpe.op6_bpe(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
    packed = packing.op10_packing(spark, str(tmp_path)).collect()
    check_packing(packed, {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows[: len(texts())] if r[0] != 3})


def check_packing(rows, ids, length=4096):
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, want in ids.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(want)
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return sum(r.length for r in rows) / (length * len(windows))


def test_little_padding(spark, library):
    rng = np.random.default_rng(3)
    rows = [(i, "the " * int(n)) for i, n in enumerate(rng.lognormal(5.5, 1.2, size=1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(df, PATH).withColumn("ids_crc32", packing.crc32("ids")).collect()
    assert check_packing(got, {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}) > 0.97


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH).count() == packing.pack(df, PATH).count() == 0


def test_packer_never_overfills():
    rng = np.random.default_rng(4)
    p, fill = packing.Packer(100, 4, 5), {}
    for n in rng.integers(1, 250, size=400):
        at = 0
        for w, o, s, m in p.place(int(n)):
            assert s == at and o == fill.get(w, 0)
            at, fill[w] = at + m, o + m
            assert fill[w] <= 100
        assert at == n and len(p.open) <= 4
    assert all(fill[w] > 95 - 5 for w in p.closed) and not {w for _, w in p.open} & set(p.closed)


def test_words_that_are_met_again_are_kept():
    e = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER))
    e.most_words = 60
    often = "the quick brown fox"
    learned, library = [], e._library
    e._library = lambda words: (learned.extend(words), library(words))[1]
    for i in range(20):
        text = often + " " + " ".join(f"w{chr(97 + i)}{chr(97 + j)}x" for j in range(20))
        got = e.encode_plain([text])[0].tolist()
        assert got == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(e.hash) <= 60
    assert learned.count("quick") == 1
