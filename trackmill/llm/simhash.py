"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint takes 64 majority bits over the XXH64 hashes of its word shingles.
Distinct fingerprints only are compared; documents that share one meet by it at no cost.

A pivot distance table holds, for each fingerprint, its Hamming distances to reference
fingerprints. By the triangle inequality two fingerprints within `radius` bits differ by at
most `radius` in every coordinate, so a pair whose largest coordinate difference is greater
is discarded, and the survivors are verified. Distances of 64 bits concentrate around 32, so
the table alone gives no key to join by; pairs are therefore only looked for among
fingerprints that agree on `BLOCKS - radius` of BLOCKS bit blocks, which every pair within
the radius does for at least one choice of blocks (pigeonhole). Nothing within the radius is
lost, and no group of equal keys is ever expanded into pairs of rows: a group leaves a task
as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm.keyed import small_batches, thrifty
from trackmill.operators.graph import connected_components
from trackmill.sources.tables import materialise, table

SHINGLE, SEED, RADIUS, BLOCKS, PIVOTS = 4, 42, 4, 7, 8
#: A group of equal keys beyond this size is split again by its other bits.
SPLIT = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits as an unsigned number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    total = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype=np.uint64)
    for i in range(0, len(every), 1 << 16):
        total += np.unpackbits(every[i : i + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(every)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(k_id, fp) with the fingerprint's bits as a signed long, a row for each of docs."""
    return _prints(docs, id_col, text_col, shingle, seed).drop("t")


def _hash(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """fingerprints with t, the text's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle, seed) for x in b["k_text"]], dtype=np.uint64)
            yield pd.DataFrame({"k_id": b["k_id"], "t": b["t"], "fp": fp.view(np.int64)})

    chosen = small_batches(docs).select(F.col(id_col).alias("k_id"), F.col(text_col).cast("string").alias("k_text"), _hash(text_col).alias("t"))
    kind = chosen.schema["k_id"].dataType.simpleString()
    return chosen.mapInPandas(thrifty(run), f"k_id {kind}, t long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of a Hadamard matrix, which are 32 bits apart."""
    i = np.arange(64)
    rows = [np.bitwise_count(np.uint64(r) & i.astype(np.uint64)) % 2 for r in (1, 2, 4, 8, 16, 32, 63, 21, 42, 7, 56, 35, 14, 49, 28, 11)[:n]]
    return np.array([int("".join(map(str, r)), 2) for r in rows], dtype=np.uint64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal values."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], dtype=int)
    return start, np.diff(np.r_[start, len(key)])


def _links(key: np.ndarray, fp: np.ndarray, at: np.ndarray, radius: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links between the places `at` whose keys are equal (key is sorted) and whose fingerprints
    are within the radius, as two arrays. Where there are very many, they are replaced by a forest
    with the same components, whose edges lead to the smallest place of each."""
    start, size = _runs(key)
    out_a, out_b = [], []
    large = size > SPLIT
    if depth < 2:
        for s, n in zip(start[large], size[large]):
            # the group's other bits, dealt in turn to blocks, so that each block has bits that vary
            bits = np.unpackbits(fp[s : s + n].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
            vary = np.flatnonzero(bits.min(axis=0) != bits.max(axis=0))
            many = radius + 4
            parts = [vary[i::many] for i in range(many)]
            found_a, found_b = [], []
            for chosen in combinations(range(many), many - radius):
                cols = np.concatenate([parts[c] for c in chosen])
                packed = np.packbits(bits[:, cols], axis=1) if len(cols) else np.zeros((n, 1), np.uint8)
                wide = np.zeros((n, 8), np.uint8)
                wide[:, : packed.shape[1]] = packed
                sub = wide.view(np.uint64).ravel()
                order = np.argsort(sub, kind="stable")
                a, b = _links(sub[order], fp[s : s + n][order], order, radius, depth + 1)
                found_a.append(a)
                found_b.append(b)
                if len(found_a) > 8:
                    label = _forest(n, np.concatenate(found_a), np.concatenate(found_b))
                    child = np.flatnonzero(label != np.arange(n))
                    found_a, found_b = [child], [label[child]]
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            out_a.append(at[s + a])
            out_b.append(at[s + b])
        keep = np.repeat(~large, size)
        key, fp, at = key[keep], fp[keep], at[keep]
    table_of = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    open_a, open_b = [], []
    i = np.arange(len(key))
    step = 0
    while len(i):
        step += 1
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        j, d = i, step
        for p in range(table_of.shape[1]):
            j = j[np.abs(table_of[j, p] - table_of[j + d, p]) <= radius]
        j = j[np.bitwise_count(fp[j] ^ fp[j + d]) <= radius]
        open_a.append(j)
        open_b.append(j + d)
        if len(open_a) > 64 and sum(map(len, open_a)) > 4 * len(key):
            label = _forest(len(key), np.concatenate(open_a), np.concatenate(open_b))
            child = np.flatnonzero(label != np.arange(len(key)))
            open_a, open_b = [child], [label[child]]
    if open_a:
        out_a.append(at[np.concatenate(open_a)])
        out_b.append(at[np.concatenate(open_b)])
    if not out_a:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(src, dst): links that connect all fingerprints (column fp, distinct) within the radius."""
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << int(cuts[c + 1] - cuts[c])) - 1) << int(cuts[c]) for c in chosen)
        keys.append(F.struct(F.lit(n).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("key")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None

        def out(x: pd.DataFrame) -> pd.DataFrame:
            t, key = x["t"].to_numpy(), x["key"].to_numpy()
            key = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1])])
            fp = x["fp"].to_numpy().view(np.uint64)
            a, b = _links(key, fp, np.arange(len(x)), radius)
            got = pd.DataFrame({"src": fp[a].view(np.int64), "dst": fp[b].view(np.int64)})
            return got.drop_duplicates()

        for x in batches:
            x = x if kept is None else pd.concat([kept, x], ignore_index=True)
            same = ((x["t"] == x["t"].iloc[-1]) & (x["key"] == x["key"].iloc[-1])).to_numpy()
            cut = int(same.argmax()) if len(x) else 0  # the last group may go on in the next batch
            kept = x.iloc[cut:].reset_index(drop=True)
            if cut:
                yield out(x.iloc[:cut])
        if kept is not None and len(kept):
            yield out(kept)

    wide = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wide.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInPandas(thrifty(run), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fingerprint, component_id), a row for each of docs.

    component_id is the smallest id that is reachable over links of at most `radius` differing
    bits, equal fingerprints included. A null text and one without words have fingerprint zero
    and link like any other; long texts are read whole; repeated rows are one place of the graph
    and come back as often as given; null ids count as the largest; an empty table gives no rows;
    other columns are ignored.
    """
    prints, _ = materialise(fingerprints(docs, id_col, text_col))
    reps = prints.groupBy("fp").agg(F.min("k_id").alias("low"))
    parts = connected_components(links(reps.select("fp"), radius))
    low = reps.join(parts, reps["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    part_low = low.groupBy("part").agg(F.min("low").alias("component_id"))
    by_fp = low.join(part_low, "part").select(F.col("fp").alias("fp_"), "component_id")
    joined = prints.join(by_fp, prints["fp"] == by_fp["fp_"])
    return joined.select(F.col("k_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest id stays,
    of equal ids the one with the smaller hash of the text, and of rows equal in both, one. Null
    ids count as the largest."""
    prints, _ = materialise(_prints(docs, id_col, text_col))
    reps = prints.groupBy("fp").agg(F.min(F.struct(F.col("k_id").isNull().alias("none"), "k_id", "t")).alias("low"))
    parts = connected_components(links(reps.select("fp"), radius))
    low = reps.join(parts, reps["fp"] == parts["node"], "left").select("low", F.coalesce("component", "fp").alias("part"))
    stay, _ = materialise(low.groupBy("part").agg(F.min("low").alias("low")).select(F.col("low.k_id").alias("id_"), F.col("low.t").alias("t_")))
    kept = docs.join(stay, docs[id_col].eqNullSafe(stay["id_"]) & (_hash(text_col) == stay["t_"]), "left_semi")
    twice = prints.groupBy(F.col("k_id").alias("twice_"), F.col("t").alias("t2_")).count().where("count > 1")
    twice, _ = materialise(twice.select("twice_", "t2_"))
    if twice.isEmpty():
        return kept
    again = kept[id_col].eqNullSafe(twice["twice_"]) & (_hash(text_col) == twice["t2_"])
    return kept.join(twice, again, "left_anti").unionByName(kept.join(twice, again, "left_semi").dropDuplicates([id_col, text_col]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: one document of each group of near-duplicates stays, that of the smallest id, null ids last; of
    equal ids that of the smaller text hash. Null and empty texts have the fingerprint zero, so one of them all stays.
    Of rows that repeat an id and text one stays, any one where they differ in other columns. Long texts are
    read whole; columns stay as they are."""
    return keep_one_of_each(docs)
