"""Approximate nearest neighbours by cross-polytope hashing.

A table applies fast pseudo-rotations (three rounds of random signs and a Hadamard transform) to
the unit vector; each one's hash is the signed axis nearest to the image, that is, the coordinate
of largest magnitude with its sign. The last of a table's rotations keeps only as many axes as
the number of codes asks for, which grows with the rows (`code_bits`), so that a query meets a
share of the rows that falls with their number. A query probes the `probes` best codes of each
table. Rows that share a code with a query are ranked exactly, on the original vectors in double
precision.

Spark deals (table, code) groups to tasks. A group's index rows and its queries are cut into slabs
of about SLAB rows, and each slab of the one meets each of the other, so that a hot code is
shared by many tasks and memory is bounded. Of equal vectors only as many as can appear in a
result are indexed, which loses nothing. Queries that found fewer rows than they ask for are run
against all rows, in slabs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.sources.tables import materialise, table

K, EVERY, TABLES, PROBES, SEED, SLAB = 10, 100, 24, 48, 7, 4096
#: Bits of a code for so many rows, and more for each doubling.
BITS, ROWS, MORE = 12, 2000, 0.43
#: Pairs of a query and a row that one task measures, and found ones that it holds, at a time; rows it hashes at a time.
BLOCK, FOUND, PART = 1 << 15, 1 << 19, 2000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _signs(width: int, tables: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).choice(np.array([-1.0, 1.0]), size=(tables, rotations, 3, width))


def _width(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def code_bits(rows: int) -> int:
    """Bits of the codes for an index of so many rows."""
    return max(1, round(BITS + MORE * np.log2(max(rows, 1) / ROWS)))


def axes(dim: int, bits: int) -> list[int]:
    """How many axes each of a table's rotations keeps, for codes of so many bits."""
    width = _width(dim)
    full = width.bit_length()  # of an axis and its sign
    return [width] * ((bits - 1) // full) + [1 << ((bits - 1) % full)]


@functools.cache
def _rotations(width: int, tables: int, rotations: int, seed: int) -> np.ndarray:
    """The pseudo-rotations as matrices (tables, rotations, width, width), to be applied to many rows at once."""
    out = np.empty((tables, rotations, width, width))
    for at, signs in zip(out.reshape(-1, width, width), _signs(width, tables, rotations, seed).reshape(-1, 3, width)):
        x = np.eye(width)
        for s in signs:
            x = hadamard(x * s)
        at[:] = x
    return out


def _nearest_axes(image: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The `best` signed axes nearest to each row, nearest first, and their squared distances
    beyond the nearest one's. A code is an axis, or as many as there are axes more if negative."""
    if best == 1:
        axis = np.abs(image).argmax(axis=1)
        order = axis + image.shape[1] * (np.take_along_axis(image, axis[:, None], axis=1)[:, 0] < 0)
        return order[:, None], np.zeros((len(image), 1))
    both = np.concatenate((image, -image), axis=1)
    order = np.argsort(-both, axis=1, kind="stable")[:, : min(best, both.shape[1])]
    value = np.take_along_axis(both, order, axis=1)
    return order, 2 * (value[:, :1] - value)


def codes(vectors: np.ndarray, tables: int, bits: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes): codes of each row in each table, the best first; -1 fills up."""
    n, dim = vectors.shape
    width = _width(dim)
    unit = np.zeros((n, width))
    unit[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.full((n, tables, probes), -1, dtype=np.int64)
    kept = axes(dim, bits)
    for t, turns in enumerate(_rotations(width, tables, len(kept), seed)):
        code, cost = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
        for turn, keep in zip(turns, kept):
            order, extra = _nearest_axes(unit @ turn[:, :keep], probes)
            code = (code[:, :, None] * (2 * keep) + order[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + extra[:, None, :]).reshape(n, -1)
            if cost.shape[1] > 1:
                least = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                code, cost = np.take_along_axis(code, least, axis=1), np.take_along_axis(cost, least, axis=1)
        out[:, t, : code.shape[1]] = code
    return out


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors as double rows) of the vectors of each length."""
    size = vectors.value_lengths().to_numpy()
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), dim)


def _least(own: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner's found rows, each once, the k nearest, ties to the smaller id."""
    order = np.lexsort((ids, score, own))
    own, ids, score = own[order], ids[order], score[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])][: len(own)]
    own, ids, score = own[new], ids[new], score[new]
    keep = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[keep], ids[keep], score[keep]


def _nearest(qn: np.ndarray, own: np.ndarray, qs: np.ndarray, xn: np.ndarray, ids: np.ndarray, xs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): for each query the k nearest of the rows of its groups but its own,
    by exact distance and then id. qn and xn are the groups, in ascending order."""
    lo = np.searchsorted(xn, qn)
    size = np.searchsorted(xn, qn, side="right") - lo
    many = np.cumsum(size)
    found = [(own[:0], ids[:0], np.array([], float))]
    held = at = 0
    while len(many) and at < many[-1]:
        pair = np.arange(at, min(at + BLOCK, int(many[-1])))
        a = np.searchsorted(many, pair, side="right")
        b = lo[a] + pair - (many[a] - size[a])
        other = own[a] != ids[b]
        a, b = a[other], b[other]
        found.append((own[a], ids[b], np.sqrt(((qs[a] - xs[b]) ** 2).sum(axis=1))))
        held += len(a)
        at += BLOCK
        if held > FOUND:
            found = [_least(*map(np.concatenate, zip(*found)), k)]
            held = len(found[0][0])
    return _least(*map(np.concatenate, zip(*found)), k)


def _rank_groups(k: int):
    """mapInArrow over rows (g, s, r, index, id, v) sorted by group, its queries first. Only the
    queries of a batch's groups and one batch of rows are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None  # the queries of the group that may go on
        for b in batches:
            if asked is not None:
                b = pa.Table.from_batches([asked, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            key = np.stack([b[c].to_numpy() for c in ("g", "s", "r")])
            group = np.cumsum(np.r_[0, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            index, ids = b["index"].to_numpy(zero_copy_only=False), b["id"].to_numpy()
            for at, v in _by_length(b["v"]):  # a group's vectors are of one length
                x, n, i = index[at], group[at], ids[at]
                own, vec, score = _nearest(n[~x], i[~x], v[~x], n[x], i[x], v[x], k)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])
            asked = b.take(pa.array(np.flatnonzero((group == group[-1]) & ~index)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): without null ids and vectors, zero vectors, and null or non-finite components. v is
    float[] as it came, which halves what moves, else double[]."""
    v = F.col(vec_col)
    if df.schema[vec_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, bits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of df found, nearest first.

    score is the Euclidean distance in double precision on the vectors as given; ties go to the
    smaller vec_id; a row with the query's own id is no candidate. Null ids, and vectors that are
    null, empty, zero or hold a null or non-finite component take no part on either side.
    Vectors of another length than a query's are no candidates of it. Rows that repeat an id
    count once, by the nearest of its vectors. Other columns are ignored; an empty table gives
    no rows. Fewer than k candidates: all of them.

    bits is the length of the codes, by default code_bits of the number of rows: more make a query
    meet fewer rows, and want more tables or probes.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col).distinct()
    # of equal vectors only the k + 1 smallest ids can be in a result (a query's own id is one)
    w = Window.partitionBy("v").orderBy("id")
    index, _ = materialise(rows.withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= k + 1).drop("n"))
    asked, _ = materialise(usable(queries, id_col, vec_col).distinct())
    bits = bits or code_bits(index.count())

    def hashed(is_index: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, PART):
                    b = whole.slice(lo, PART)
                    for at, v in _by_length(b["v"]):
                        code = codes(v, tables, bits, 1 if is_index else probes)
                        for t in range(tables):
                            row, _ = np.nonzero(code[:, t] >= 0)
                            # a group is named by the vectors' length, the table and the code
                            g = (code[:, t][code[:, t] >= 0] * tables + t) * 65537 + v.shape[1]
                            place = pa.array(at[row])
                            yield pa.RecordBatch.from_arrays([pa.array(g), b["id"].take(place), b["v"].take(place)], ["g", "id", "v"])

        return run

    kind = index.schema["v"].dataType.simpleString()
    coded = index.mapInArrow(hashed(True), f"g long, id long, v {kind}")
    probe = asked.mapInArrow(hashed(False), f"g long, id long, v {kind}")

    def slabs_of(rows: DataFrame, name: str) -> DataFrame:
        """Slabs of the groups that are larger than one; counts are combined before the shuffle."""
        large = rows.groupBy("g").count().where(F.col("count") > SLAB).select(F.col("g").alias(f"{name}_g"), F.ceil(F.col("count") / SLAB).cast("int").alias(name))
        return materialise(large)[0]

    def pairs(coded: DataFrame, probe: DataFrame) -> DataFrame:
        rows_in, asked_in = slabs_of(coded, "slabs"), slabs_of(probe, "parts")
        slabs, parts = F.coalesce("slabs", F.lit(1)), F.coalesce("parts", F.lit(1))
        both = lambda x: x.join(rows_in, x["g"] == rows_in["slabs_g"], "left").join(asked_in, x["g"] == asked_in["parts_g"], "left")
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        x = both(coded).select("g", own(slabs).alias("s"), each(parts).alias("r"), F.lit(True).alias("index"), "id", "v")
        q = both(probe).select("g", each(slabs).alias("s"), own(parts).alias("r"), F.lit(False).alias("index"), "id", "v")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = x.unionByName(q).repartition(n, "g", "s", "r").sortWithinPartitions("g", "s", "r", "index", "id")
        return dealt.mapInArrow(_rank_groups(k), "query_id long, vec_id long, score double")

    found, _ = materialise(_best(pairs(coded, probe), k).select("query_id", "vec_id", "score"))
    # queries with too few rows found: against all rows of their length, in slabs
    enough = found.groupBy("query_id").count().where(F.col("count") >= k)
    few, _ = materialise(asked.join(enough, asked["id"] == enough["query_id"], "left_anti"))
    if few.isEmpty():
        more = found.limit(0)
    else:
        by_size = lambda x: x.select(F.size("v").cast("long").alias("g"), "id", "v")
        more = pairs(by_size(index), by_size(few))
    best = _best(found.unionByName(more), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % EVERY == 0))
