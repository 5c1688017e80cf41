import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from trackmill.llm import bpe, simhash


def words(rng, kind, n):
    parts = {"aa": ["ki", "vo", "la", "ru", "me"], "bb": ["gh", "str", "bl", "qu", "orn"]}[kind]
    return " ".join("".join(rng.choice(parts, size=rng.integers(2, 7))) for _ in range(n))


def test_against_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = {i: words(rng, "ab"[i % 2] * 2, int(rng.integers(60, 300))) for i in range(120)}
    passage = words(rng, "aa", 60)
    text[30] += " " + passage
    text[31] = passage + " " + text[31]
    rows = [(i, t, "ab"[i % 2] * 2) for i, t in text.items()]
    rows += [(200, text[4], "aa"), (201, text[7] + " end", "bb"), (202, "1234 5678", "aa"), (203, None, "bb"), (5, text[5], "bb")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    # what should be left: no text without letters, no copies, the second passage cut
    want = dict(text)
    want[31] = want[31].removeprefix(passage + " ")
    fp = {i: simhash.fingerprint(t) for i, t in text.items()}
    assert all((fp[a] ^ fp[b]).bit_count() > 4 for a in fp for b in fp if a < b)
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    got = {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in want.items()}


def test_each_stage_keeps_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
