"""License scan: exact set-similarity join of text blocks and license templates.

Words are ordered by their frequency in the whole corpus, rarest first. A template T and a
threshold t ask for a = ceil(t * |T|) common words, so that one of T's first |T| - a + 1
words occurs in every block that meets it (prefix filter); only blocks with such a word go
on. A pair is examined at its first common word only, must have enough distinct words
(length filter) and enough words left on both sides after that place (positional filter),
and is then verified exactly. Phrases are templates with threshold 1 whose words must also
stand consecutively.

Blocks are runs of STRIDE words, longer by the longest template less one word, so that each
place of a phrase starts in exactly one block and lies in it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm.urlfilter import LOWER, UPPER
from trackmill.sources.tables import materialise, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE = 64
THRESHOLD = 0.8
#: Phrases: words and label; their places are counted.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices: words, label; found by containment.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(text: Column, stride: int, width: int) -> Column:
    """array<struct<at, words>>; a text without words has one empty block."""
    last = lambda w: F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / stride).cast("int")
    return _bound(words_of(text), lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda k: F.struct(k.alias("at"), F.slice(w, k * stride + 1, width).alias("words"))))


def _array(values) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> list[dict]:
    """The templates as plain rows; the licence texts of a job are its parameters, not data."""
    rows = [{"words": p.split(), "label": label, "t": 1.0, "phrase": True} for p, label in phrases]
    return rows + [{"words": p.split(), "label": label, "t": threshold, "phrase": False} for p, label in notices]


def scan_licenses(docs: DataFrame, templates: list[dict], id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE) -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all phrases; first_word and last_word are their smallest and
    largest start (null if none). labels has those of phrases and of notices whose distinct
    words are contained in a block to their threshold; score is the largest containment that
    met its threshold, 0 without one. A null or empty text has no words: zero counts, empty
    labels. Repeated rows give repeated results, a null id stays null, an empty table gives no
    rows, and columns other than id and text are ignored. At most 62 different labels.
    """
    spark = docs.sparkSession
    width = stride + max([len(x["words"]) for x in templates] or [1]) - 1
    vocab = sorted({w for x in templates for w in x["words"]})
    labels = sorted({x["label"] for x in templates})
    if len(labels) > 62:
        raise ValueError("at most 62 different labels")
    base = docs.select(F.col(id_col).alias("k_id"), F.col(text_col).cast("string").alias("k_text"))

    # corpus frequency of the templates' words, over all documents
    seen = base.select(F.explode(F.array_intersect(F.array_distinct(words_of(F.col("k_text"))), _array(vocab))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    count = {r["w"]: r["n"] for r in seen.collect()}  # a row for each word of the templates at most
    order = sorted(vocab, key=lambda w: (count.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    rows, prefixes = [], set()
    for n, x in enumerate(templates):
        inside = sorted(set(x["words"]), key=place.get)
        need = max(1, -int(-(x["t"] * len(inside) - 1e-9) // 1))
        for i, w in enumerate(inside[: len(inside) - need + 1]):
            prefixes.add(w)
            rows.append((w, n, i, need, inside, x["words"], bool(x["phrase"]), 1 << labels.index(x["label"])))
    quote = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    listed = lambda ws: "array(" + ", ".join(map(quote, ws)) + ")"
    if not rows:
        rows = [("", 0, 0, 1, [""], [""], False, 0)]
    probe = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(w)}, {n}, {i}, {need}, {listed(inside)}, {listed(words)}, {str(ph).lower()}, {bit}L)" for w, n, i, need, inside, words, ph, bit in rows) + " AS t(t_word, t_no, t_i, t_need, t_set, t_words, t_phrase, t_bit)")

    block = base.select("k_id", F.xxhash64("k_text").alias("k_hash"), F.explode(_blocks(F.col("k_text"), stride, width)).alias("b")).select("k_id", "k_hash", F.col("b.at").alias("at"), F.col("b.words").alias("words"))
    own = F.least(F.size("words"), F.lit(stride))
    # place 0 has no word and joins nothing: one row for each block, by which words and copies are counted
    hits = F.when(F.arrays_overlap(F.col("words"), _array(sorted(prefixes))), F.array_intersect(F.col("words"), _array(sorted(prefixes)))).otherwise(F.array().cast("array<string>"))
    wide = block.withColumn("own", own).select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), hits)).alias("p", "w"))
    pair = wide.join(probe, F.col("w") == F.col("t_word"), "left")
    first = ~F.arrays_overlap(F.slice("t_set", 1, F.col("t_i")), F.col("words")) | (F.col("t_i") == 0)
    left_t = F.size("t_set") - F.col("t_i")
    present = F.array_intersect(_array(order), F.col("words"))  # the block's words of the vocabulary, in the global order
    left_b = F.size(present) - F.array_position(present, F.col("w")).cast("int") + 1
    common = F.size(F.array_intersect("t_set", "words"))
    met = F.col("w").isNotNull() & F.col("t_no").isNotNull() & first & (F.size("words") >= F.col("t_need")) & (F.least(left_t, left_b) >= F.col("t_need")) & (common >= F.col("t_need"))
    starts = F.filter(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.slice(F.col("words"), i + 1, F.size("t_words")) == F.col("t_words"))
    none = F.array().cast("array<int>")
    pair = pair.withColumn("met", met).withColumn("starts", F.when(F.col("met") & F.col("t_phrase"), starts).otherwise(none))
    counts = F.size("starts")
    is_base = F.col("met") & F.col("t_phrase") & (counts > 0)
    is_notice = F.col("met") & ~F.col("t_phrase")
    shift = (F.col("at") * stride).cast("long")
    grouped = pair.groupBy("k_id", "k_hash").agg(
        F.sum(F.when(F.col("p") == 0, F.col("own"))).alias("words"), F.count_if((F.col("p") == 0) & (F.col("at") == 0)).alias("copies"),
        F.sum(F.when(is_base, counts)).alias("places"), F.min(F.when(is_base, shift + F.array_min("starts"))).alias("first_word"), F.max(F.when(is_base, shift + F.array_max("starts"))).alias("last_word"),
        F.bit_or(F.when(is_base, F.col("t_bit"))).alias("base_bits"), F.bit_or(F.when(is_base | is_notice, F.col("t_bit"))).alias("bits"),
        F.max(F.when(is_base, F.lit(1.0)).when(is_notice, common / F.size("t_set"))).alias("score"),
    )
    named = lambda bits: F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(x)) for i, x in enumerate(labels)] or [F.lit(None).cast("string")]), lambda x: x.isNotNull()), ",")
    one = grouped.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    each = lambda c: F.coalesce((F.col(c) / F.col("copies")).cast("long"), F.lit(0).cast("long"))
    return one.select(F.col("k_id").alias(id_col), each("words").alias("n_words"), each("places").alias("n_base"), "first_word", "last_word", named("base_bits").alias("base_labels"), named("bits").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), template_table(spark))


def _sql() -> str:
    width = STRIDE + max(len(p.split()) for p, _ in PHRASES + NOTICES) - 1
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    notices = ", ".join(f"({p.split()}, '{label}')" for p, label in NOTICES)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), phrases(p, label) AS (VALUES {phrases}), notices(p, label) AS (VALUES {notices}),
places AS (
  SELECT n, label, i - 1 AS pos FROM (SELECT n, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN phrases ON w[i] = p[1] AND w[i:i + len(p) - 1] = p
), base AS (
  SELECT n, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS l FROM places GROUP BY n
), b AS (
  SELECT n, w[k * {STRIDE} + 1 : k * {STRIDE} + {width}] AS w FROM (SELECT n, w, unnest(range(0, (greatest(len(w) - 1, 0) // {STRIDE}) + 1)) AS k FROM d)
), found AS (
  SELECT n, label, len(list_intersect(list_distinct(p), list_distinct(w))) / len(list_distinct(p))::DOUBLE AS c FROM b, notices
), more AS (SELECT n, list_distinct(list(label)) AS l, max(c) AS c FROM found WHERE c >= {THRESHOLD} - 1e-9 GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(more.l, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (n) LEFT JOIN more USING (n)
"""


SQL = {"op4_license_scan": _sql()}
