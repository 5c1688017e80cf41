"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash whose unsigned value is below a fixed fraction of the range, and
the smallest hash, so that a short text has one too. As the threshold is the same for all texts,
sketches of parts merge to the sketch of their union, and the share of a small text's sketch that
a large one holds estimates how much of the small text is contained in it.

Only DataFrame functions are used. The successor of each document in id order is found by
windows over ranges of ids: each range is one window, and a row that stands for the first
document of the next range closes it, so that no window spans all rows and texts are shuffled once.
Ranges follow the quantiles of the ids, so that outlying or clustered ids spread alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.llm.urlfilter import LOWER, UPPER
from trackmill.sources.tables import materialise, table

SHINGLE = 5
#: A hash is kept if its upper BITS bits are zero: one in eight.
BITS = 3
#: Documents in one range of ids; ranges in one window; quantiles of the ids, between which ranges are equally wide.
RANGE, RANGES, QUANTILES = 500, 2000, 256
#: Copies of one row that a task tells at a time.
COPIES = 1000


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _smallest(hashes: Column) -> Column:
    """The unsigned smallest as an array; an empty one if there is none."""
    flip = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.size(hashes) > 0, F.array(flip(F.array_min(F.transform(hashes, flip))))).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, shingle: int = SHINGLE, bits: int = BITS) -> Column:
    """Sorted array<long> of a text's kept shingle hashes. Words are what white space separates,
    A-Z lower-cased; a text of fewer words than a shingle is one shingle; one without words, or
    null, has an empty sketch."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), "")

    def shingles(h: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])
        many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), one)
        return F.when(F.size(h) >= shingle, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    kept = lambda s: F.array_sort(F.array_union(F.filter(s, lambda x: F.shiftrightunsigned(x, 64 - bits) == 0), _smallest(s)))
    return bound(bound(F.transform(words, lambda w: F.xxhash64(w)), shingles), kept)


def merged(a: Column, b: Column, bits: int = BITS) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: F.shiftrightunsigned(x, 64 - bits) == 0)
    return F.when(F.size(below) > 0, below).otherwise(_smallest(both))


def containment(small: Column, large: Column) -> Column:
    """Estimated share of small's shingles that large holds; null if small has none."""
    return F.when(F.size(small) > 0, F.size(F.array_intersect(small, large)) / F.size(small))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one, 0 to 1; two empty ones are alike, an empty and another not."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def _following(firsts: DataFrame, n: int) -> DataFrame:
    """(bucket, key) of n ranges to (bucket, next_): the next range's key, the first one's for the last."""
    if n <= RANGES:
        w = Window.orderBy("bucket")
        first = firsts.agg(F.min_by("key", "bucket").alias("top_"))
        return firsts.withColumn("next_", F.lead("key").over(w)).join(F.broadcast(first)).select("bucket", F.coalesce("next_", "top_").alias("next_"))
    part = F.floor(F.col("bucket") / RANGES)
    coarse = firsts.withColumn("part_", part)
    up = _following(coarse.groupBy("part_").agg(F.min_by("key", "bucket").alias("key")).select(F.col("part_").alias("bucket"), "key"), n // RANGES + 1)
    near = coarse.withColumn("near_", F.lead("key").over(Window.partitionBy("part_").orderBy("bucket")))
    return near.join(up.select(F.col("bucket").alias("up_"), "next_"), F.col("part_") == F.col("up_")).select("bucket", F.coalesce("near_", "next_").alias("next_"))


def _buckets(rows: DataFrame) -> tuple[Column, int]:
    """The range of each row of (k_id, h), in the order of (k_id, h) with nulls first, and how many
    ranges there are. What the driver gets is QUANTILES ids and two counts."""
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("k_id").isNull())).first()
    parts = lambda rows: max(1, -(-rows // RANGE))
    spread = lambda many: F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * many), F.lit(many - 1)).cast("long")
    if n == nulls:
        return spread(parts(n)), parts(n)
    q = rows.where(F.col("k_id").isNotNull()).select(F.col("k_id").cast("double").alias("q")).approxQuantile("q", [i / QUANTILES for i in range(QUANTILES)], 0.25 / QUANTILES)
    within, at = parts((n - nulls) // QUANTILES), parts(nulls)
    lows, hot, first = [], [], []  # ranges of one id, which hashes divide, and those up to the next quantile
    for x in sorted(set(q)):
        many = q.count(x)
        for one in ([True, False] if many > 1 else [False]):
            lows.append(max(min(int(x), (1 << 63) - 1), -(1 << 63)))
            hot.append(many if one else 0)
            first.append(at)
            at += many * within if one else within
    array = lambda x: F.array(*[F.lit(y) for y in x])
    after = [y for y in lows[1:]] + [lows[-1] + 1]
    low, high, many, base = array(lows), array([min(max(y, x + 1), (1 << 63) - 1) for x, y in zip(lows, after)]), array(hot), array(first)
    i = F.greatest(F.lit(1), F.size(F.filter(low, lambda x: x <= F.col("k_id"))))
    i = F.when((i > 1) & (F.get(many, i - 2) > 0) & (F.get(low, i - 2) == F.col("k_id")), i - 2).otherwise(i - 1)

    def bucket(i: Column) -> Column:
        width = F.get(high, i).cast("double") - F.get(low, i).cast("double")
        share = (F.col("k_id").cast("double") - F.get(low, i).cast("double")) / width
        inside = F.greatest(F.lit(0), F.least(F.lit(within - 1), F.floor(share * within))).cast("long")
        by_hash = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * F.get(many, i) * within), F.get(many, i) * within - 1).cast("long")
        return F.get(base, i) + F.when(F.get(many, i) > 0, by_hash).otherwise(inside)

    return F.when(F.col("k_id").isNull(), spread(parts(nulls))).otherwise(bound(i, bucket)).cast("long"), at


def repeated(rows: DataFrame) -> DataFrame | None:
    """(a_id, a_h, copies): ids and text hashes of rows (k_id, k_text) that are there more than once; None if there are none."""
    found, _ = materialise(rows.groupBy(F.col("k_id").alias("a_id"), F.xxhash64("k_text").alias("a_h")).agg(F.count("*").alias("copies")).where("copies > 1"))
    return None if found.isEmpty() else found


def with_next(rows: DataFrame, fp: Column) -> DataFrame:
    """rows (k_id, k_text) with fp, which is computed once a row, and next_text, next_fp of the next
    row by ascending id, the first's for the last."""
    rows = rows.withColumn("h", F.xxhash64("k_text"))
    # null ids come first, in order of their texts' hashes; ids of equal value in that order too
    bucket, n = _buckets(rows.select("k_id", "h"))
    rows = rows.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("k_id", "h")).alias("key"))
    ends = _following(firsts, n)
    ends = ends.select(F.col("bucket").alias("end_"), F.coalesce("next_.k_id", F.lit(0)).alias("e_id"), F.col("next_.k_id").isNull().alias("e_null"), F.col("next_.h").alias("e_h"))
    # the text that closes each range: as many rows as ranges
    starts = rows.join(F.broadcast(firsts) if n < 10_000 else firsts, rows["k_id"].eqNullSafe(firsts["key.k_id"]) & (rows["h"] == firsts["key.h"]), "left_semi").dropDuplicates(["k_id", "h"])
    closing = ends.join(starts, (F.coalesce("k_id", F.lit(0)) == F.col("e_id")) & (F.col("k_id").isNull() == F.col("e_null")) & (F.col("h") == F.col("e_h")))
    closing = closing.select(F.col("end_").alias("bucket"), F.lit(1).alias("close"), F.lit(None).cast("long").alias("k_id"), F.lit(None).cast("long").alias("h"), "k_text")
    all_rows = rows.select("bucket", F.lit(0).alias("close"), "k_id", "h", "k_text").unionByName(closing).withColumn("fp", fp)
    w = Window.partitionBy("bucket").orderBy("close", "k_id", "h")
    return all_rows.withColumn("next_text", F.lead("k_text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("close = 0").select("k_id", "k_text", "fp", "next_text", "next_fp")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs' (id_col, n_chars, sketch, edited, edited_sketch, next_sketch), a row for each of docs.

    edited is the text with its last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document by ascending id; after the last comes the first. Null ids come
    first; equal ids are in the order of their texts' hashes. A null text is empty; texts are
    read whole; repeated rows follow one another, and are told from one row of them; other columns are ignored; an empty table
    gives no rows; a single document is its own next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("k_text"))
    again = repeated(rows)
    if again is None:
        rows = with_next(rows, sketch(F.col("k_text"), shingle, bits))
    else:
        same = (F.col("k_id").eqNullSafe(F.col("a_id"))) & (F.col("h") == F.col("a_h"))
        keyed = rows.withColumn("h", F.xxhash64("k_text"))
        of = keyed.join(again, same).select("k_id", "k_text", "h", "copies")
        once = keyed.join(again, same, "left_anti").select("k_id", "k_text").unionByName(of.dropDuplicates(["k_id", "h"]).select("k_id", "k_text"))
        once = with_next(once, sketch(F.col("k_text"), shingle, bits))
        # every copy but the last is followed by its like: told by one row for each COPIES of them, dealt out anew
        like = of.dropDuplicates(["k_id", "h"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / COPIES)))).repartition("k_id", "h", "block")
        fp = sketch(F.col("k_text"), shingle, bits)
        many = F.least(F.lit(COPIES).cast("long"), F.col("copies") - 1 - F.col("block") * COPIES)
        like = like.select("k_id", "k_text", fp.alias("fp"), F.col("k_text").alias("next_text"), many.alias("many")).withColumn("next_fp", F.col("fp"))
        like = like.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).drop("_", "many")
        rows = once.unionByName(like.select(once.columns))
    n = F.length("k_text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("k_text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("k_id", n.cast("long").alias("n_chars"), F.col("fp").alias("sketch"), edited.alias("edited"), F.col("next_fp").alias("next_sketch"))
    return rows.select(F.col("k_id").alias(id_col), "n_chars", "sketch", "edited", sketch(F.col("edited"), shingle, bits).alias("edited_sketch"), "next_sketch")


def _text(fp: str) -> Column:
    return F.array_join(F.transform(F.col(fp), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ".")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _text("sketch").alias("fingerprint"), _text("edited_sketch").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
