"""Exact substring dedup: suffix order and longest previous factors, dealt out by anchors.

A byte is repeated if it lies in a string of `least` bytes that also starts elsewhere. Every
window of that length has an anchor, the leftmost k-gram of smallest hash in it; equal windows
have equal anchors at the same place. So windows are dealt to tasks by their anchor's hash, and
one task sees all windows that can be equal. The windows of one anchor in one text are contiguous
and are handled as one stretch of bytes:

1. anchors that occur once in the corpus go (counts are combined before the shuffle);
2. stretches that are equal as a whole are settled by their hashes, as (anchor, stretch) counts;
3. one of each of the stretches that differ from others of their anchor is fetched as bytes.
   The suffixes at its windows are sorted, to the depth that matters. In suffix order, equal
   windows stand in the order of their places in the corpus, so that the previous smaller
   position of each is the neighbour before it: its longest previous factor reaches `least`
   exactly if that neighbour is equal, and that neighbour is an earlier match.
   The windows of an anchor with very many different stretches are counted by hash instead, so
   that no group has to fit in one task.

keep="first" removes later copies and keeps the first, in the order of (id, place);
keep="none" removes every copy.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm.keyed import chosen, packed, renamed_id, unpacked, wide_tag
from trackmill.sources.tables import materialise, table

LEAST, GRAM, SEED = 200, 32, 5
#: Different stretches of one anchor that one task sorts; windows sorted at a time; bytes hashed at a time.
SPLIT, WINDOWS, PART = 2000, 1 << 16, 1 << 18


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd number and of its inverse, modulo 2**64."""
    value = np.random.default_rng(SEED).integers(0, 1 << 64, size=256, dtype=np.uint64)
    q = 0x9E3779B97F4A7C15
    power = lambda x: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, dtype=np.uint64), dtype=np.uint64)))
    return value, power(q), power(pow(q, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, stretch hash, first window, windows) for the stretches of a text, in parts."""
    width = least - gram + 1
    value, power, inverse = _powers(PART + least)
    for lo in range(0, max(len(data) - least + 1, 0), PART):
        b = np.frombuffer(data[lo : lo + PART + least - 1], dtype=np.uint8)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(value[b] * power[: len(b)], dtype=np.uint64)))
        h = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(b) - gram + 1])
        # the smallest of each `width` hashes, by minima to the left and right of block borders
        code = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        full = -(-len(code) // width) * width
        blocks = np.append(code, np.full(full - len(code), np.uint64((1 << 64) - 1))).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(b) - least + 1
        at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        many = np.diff(np.r_[start, n])
        end = start + many + least - 1
        whole = _mix((sums[end] - sums[start]) * inverse[start] + (at[start] - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + many.astype(np.uint64))
        yield h[at[start]].view(np.int64), whole.view(np.int64), start + lo, many


def _stretches(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, rows = [], 0
            for k, text in zip(b["k"], b["k_text"]):
                data = text.encode("utf-8", "replace")
                if len(data) < least:
                    continue
                t = wide_tag(data)
                for a, c, start, many in anchors(data, least, gram):
                    out.append((np.full(len(a), k), np.full(len(a), t, np.int64), a, c, start.astype(np.int32), many.astype(np.int32)))
                    rows += len(a)
                if rows > 100_000:
                    yield pd.DataFrame(dict(zip(("k", "t", "a", "c", "at", "n"), map(np.concatenate, zip(*out)))))
                    out, rows = [], 0
            if out:
                yield pd.DataFrame(dict(zip(("k", "t", "a", "c", "at", "n"), map(np.concatenate, zip(*out)))))

    return chosen(docs, id_col, text_col).mapInPandas(run, "k long, t long, a long, c long, at int, n int")


def previous_factors(windows: np.ndarray) -> np.ndarray:
    """For fixed-length windows (bytes dtype) in corpus order: the place of the nearest earlier
    equal window, the longest previous factor as far as it matters, or -1."""
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    out = np.full(len(windows), -1)
    out[order[1:][equal]] = order[:-1][equal]
    return out


def _ranges(own: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of following starts of one owner: (owner, first byte, end)."""
    first = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(start) != 1)]) if len(own) else np.array([], int)
    last = np.r_[first[1:] - 1, len(own) - 1] if len(own) else first
    return own[first], start[first], start[last] + least


def _sort_group(x: pd.DataFrame, least: int, keep: str) -> pd.DataFrame:
    """Repeated windows of stretches (a, k, t, at, data) that are sorted by a, k, t, at."""
    data = np.frombuffer(b"".join(x["data"]), dtype=np.uint8)
    size = x["data"].map(len).to_numpy()
    many = size - least + 1
    own = np.repeat(np.arange(len(x)), many)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    at = (np.cumsum(size) - size)[own] + inside
    wide = np.empty((len(own), least + 4), dtype=np.uint8)  # the anchor's number comes first: windows of different anchors aren't compared
    group = np.cumsum(np.r_[0, x["a"].to_numpy()[1:] != x["a"].to_numpy()[:-1]]).astype(">u4")
    wide[:, :4] = group[own].view(np.uint8).reshape(-1, 4)
    wide[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, least)[at]
    earlier = previous_factors(wide.view(f"S{least + 4}").ravel())
    found = earlier >= 0
    if keep == "none":
        found[earlier[found]] = True
    which, lo, hi = _ranges(own[found], (x["at"].to_numpy()[own] + inside)[found], least)
    return pd.DataFrame({"k": x["k"].to_numpy()[which], "t": x["t"].to_numpy()[which], "lo": lo, "hi": hi})


def repeated(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int, keep: str, split: int) -> DataFrame:
    """(k, t, lo, hi): byte ranges of the texts that are to go; they may overlap."""
    every, _ = materialise(_stretches(docs, id_col, text_col, least, gram))
    # counts are written before they are joined: only a join of two shuffles is split where a key is hot
    again, _ = materialise(every.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select(F.col("a").alias("a_")))
    live, _ = materialise(every.join(again, every["a"] == again["a_"]).drop("a_"))
    kinds = live.groupBy("a", "c").agg(F.count("*").alias("same"), F.min(F.struct("k", "t", "at", "n")).alias("first"))
    kinds, _ = materialise(kinds)
    mixed, _ = materialise(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select(F.col("a").alias("a_"), "kinds"))

    # stretches that are equal as a whole
    equal = kinds.where("same > 1").select(F.col("a").alias("a_"), F.col("c").alias("c_"), "first")
    whole = live.join(equal, (live["a"] == equal["a_"]) & (live["c"] == equal["c_"]))
    if keep == "first":
        whole = whole.where(F.struct("k", "t", "at") != F.struct("first.k", "first.t", "first.at"))
    spans = whole.select("k", "t", F.col("at").alias("lo"), (F.col("at") + F.col("n") + least - 1).alias("hi"))

    # one of each of the others, as bytes
    needs = kinds.join(mixed, kinds["a"] == mixed["a_"]).select("first.*", "a", (F.col("kinds") > split).alias("hot"))
    needs = needs.groupBy("k", "t").agg(F.collect_list(F.struct("a", "at", "n", "hot")).alias("x"))  # bounded by the text
    needs = needs.select(F.col("k").alias("k_"), F.col("t").alias("t_"), *[F.col(f"x.{c}").alias(f"{c}s") for c in ("a", "at", "n", "hot")])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, room = [], 0
            for k, t, z, a, at, n, hot in b[["k", "t", "z", "as", "ats", "ns", "hots"]].itertuples(index=False):
                data = unpacked(z)
                for i in range(len(a)):
                    part = data[at[i] : at[i] + n[i] + least - 1]
                    if hot[i]:
                        out += [(k, t, a[i], at[i] + j, b"", xxhash.xxh3_64_intdigest(part[j : j + least]) - (1 << 63)) for j in range(n[i])]
                    else:
                        out.append((k, t, a[i], at[i], part, 0))
                    room += len(part) + n[i] * bool(hot[i])
                if room > 1 << 22:
                    yield pd.DataFrame(out, columns=["k", "t", "a", "at", "data", "w"])
                    out, room = [], 0
            if out:
                yield pd.DataFrame(out, columns=["k", "t", "a", "at", "data", "w"])

    texts = packed(docs, id_col, text_col, wide_tag)
    fetched = texts.join(needs, (texts["k"] == needs["k_"]) & (texts["t"] == needs["t_"])).drop("k_", "t_").mapInPandas(fetch, "k long, t long, a long, at int, data binary, w long")
    fetched, _ = materialise(fetched)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for x in batches:
            x = x if kept is None else pd.concat([kept, x], ignore_index=True)
            border = np.flatnonzero(np.r_[True, x["a"].to_numpy()[1:] != x["a"].to_numpy()[:-1]])
            size = np.cumsum(x["data"].map(len).to_numpy() - least + 1)
            lo = 0
            for p, end in enumerate(border[1:]):  # whole anchors, as many as are sorted at a time
                nxt = border[p + 2] if p + 2 < len(border) else None
                if nxt is None or size[nxt - 1] - (size[lo - 1] if lo else 0) > WINDOWS:
                    yield _sort_group(x.iloc[lo:end], least, keep)
                    lo = end
            kept = x.iloc[lo:].reset_index(drop=True)
        if kept is not None and len(kept):
            yield _sort_group(kept, least, keep)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = fetched.where(F.length("data") > 0).dropDuplicates(["k", "t", "a", "at"]).select("a", "k", "t", "at", "data")
    sorted_ = cold.repartition(n, "a").sortWithinPartitions("a", "k", "t", "at").mapInPandas(sort, "k long, t long, lo int, hi int")
    # very many stretches of one anchor: windows by hash, combined before the shuffle
    hot = fetched.where(F.length("data") == 0).select("k", "t", "a", "at", "w").distinct()
    counted = hot.groupBy("a", "w").agg(F.count("*").alias("m"), F.min(F.struct("k", "t", "at")).alias("first")).where("m > 1").select(F.col("a").alias("a_"), F.col("w").alias("w_"), "first")
    by_hash = hot.join(counted, (hot["a"] == counted["a_"]) & (hot["w"] == counted["w_"]))
    if keep == "first":
        by_hash = by_hash.where(F.struct("k", "t", "at") != F.col("first"))
    by_hash = by_hash.select("k", "t", F.col("at").alias("lo"), (F.col("at") + least).alias("hi"))
    return spans.unionByName(sorted_).unionByName(by_hash)


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    return lo[first], reach[np.r_[first[1:] - 1, len(lo) - 1]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, keep: str = "none", gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """(id_col, n_bytes, starts, ends, kept): a row for each of docs.

    starts and ends are the maximal removed runs of the text's UTF-8 bytes, kept is what is left.
    A null text is empty; texts shorter than `least` lose nothing; long texts are read whole; of
    a repeated row each is another place, under keep="none"; with keep="first" rows with equal id
    and text share one result. A null id stays null and counts as the smallest. Other columns are
    ignored; an empty table gives no rows.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    ranges = repeated(docs, id_col, text_col, least, gram, keep, split)
    ranges = ranges.groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("x"))  # each once, however often a row is repeated: bounded by the text
    ranges = ranges.select(F.col("k").alias("k_"), F.col("t").alias("t_"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo_ in range(0, len(b), 500):
                out = []
                for k, z, lo, hi in b.iloc[lo_ : lo_ + 500][["k", "z", "lo", "hi"]].itertuples(index=False):
                    data = unpacked(z)
                    starts = ends = np.array([], np.int32)
                    if lo is not None and len(lo):
                        starts, ends = _merge(np.asarray(lo), np.asarray(hi))
                    out.append((k, len(data), starts, ends, b"".join(data[i:j] for i, j in zip([0, *ends], [*starts, len(data)]))))
                yield pd.DataFrame(out, columns=["k", "n_bytes", "starts", "ends", "kept"])

    texts = packed(docs, id_col, text_col, wide_tag)
    joined = texts.join(ranges, (texts["k"] == ranges["k_"]) & (texts["t"] == ranges["t_"]), "left").select("k", "z", "lo", "hi")
    return renamed_id(joined.mapInPandas(cut, "k long, n_bytes long, starts array<int>, ends array<int>, kept binary"), id_col)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
