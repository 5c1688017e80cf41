"""Bounded-space online packing of token sequences.

A task keeps a fixed number of open windows. A document's tokens go to the window with the least
room that still holds them (best fit). When none does, the fullest window is emitted: if its room
is worth a piece, the document is cut to fill it first, otherwise the room stays as padding; the
rest is placed again. Whole windows of long documents are emitted at once. What is open at the
end of a partition is merged: leftovers of neighbouring partitions are packed into common
windows, as whole runs or cut to fill, a bounded number of them in one task.

Pieces are written once with their window; leftovers then only move as (window, length) rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trackmill.llm.bpe import TOKENIZER, encoder, slices
from trackmill.llm.keyed import small_batches, thrifty
from trackmill.sources.tables import materialise, table

LENGTH, WINDOWS, END, LEAST = 4096, 64, 2, 64
#: Windows that one task can name.
_SPACE = 1 << 31


class Packer:
    """Best fit into at most `windows` open windows. place() gives (window, offset, start, length)
    for the pieces of a run of tokens; windows are numbered in the order they were opened, and
    named in `closed` once they take no more."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS, least: int = LEAST):
        self.length, self.windows, self.least = length, windows, least
        self.open: list[tuple[int, int]] = []  # (room, window), by room
        self.closed: list[int] = []
        self.named = 0

    def place(self, n: int) -> list[tuple[int, int, int, int]]:
        out, start = [], 0
        while n - start >= self.length:
            out.append((self.named, 0, start, self.length))
            self.closed.append(self.named)
            self.named += 1
            start += self.length
        while start < n:
            size = n - start
            at = bisect_left(self.open, (size, -1))
            if at == len(self.open):
                if len(self.open) < self.windows:
                    insort(self.open, (self.length, self.named))
                    self.named += 1
                    continue
                room = self.open[0][0]  # the fullest
                if room < self.least or size - room < self.least:
                    self.closed.append(self.open.pop(0)[1])
                    continue
                at, size = 0, room
            room, window = self.open.pop(at)
            if room > size:
                insort(self.open, (room - size, window))
            else:
                self.closed.append(window)
            out.append((window, self.length - room, start, size))
            start += size
        return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = WINDOWS, end_id: int = END, least: int = LEAST, digest: bool = False) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece. With
    digest=True, ids_crc32 (CRC-32 of the ids as little-endian unsigned 32-bit numbers) stands
    instead of ids, which then are only kept for leftovers.

    A document is its token ids and end_id, cut into pieces; each id lies in one piece. A
    sequence has `length` tokens at most and is gapless from offset 0. A null or empty text is
    one end_id; a long text is packed whole; repeated rows are packed as often as given; a null
    id stays null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    columns = ["k_id", "start", "length", "ids", "doc_tokens", "window_", "offset", "crc", "left_"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, p = encoder(path), Packer(length, windows, least)
        base = TaskContext.get().partitionId() * _SPACE
        held: dict[int, list[tuple]] = {}  # pieces of open windows
        kind = None

        def frame(rows: list[tuple], left: bool) -> pd.DataFrame:
            out = pd.DataFrame([(*r, zlib.crc32(r[3].tobytes()) if digest else 0, left) for r in rows], columns=columns)
            if digest and not left:
                out["ids"] = None
            out["k_id"] = pd.array(out["k_id"].tolist(), dtype=kind)
            return out

        for b in batches:
            texts, keys = b["k_text"].tolist(), b["k_id"].astype(object).where(b["k_id"].notna(), None).tolist()
            kind = "Int64" if pd.api.types.is_numeric_dtype(b["k_id"].dtype) else object
            for lo, hi in slices(texts):
                rows = []
                for key, ids in zip(keys[lo:hi], e.encode_plain(texts[lo:hi])):
                    ids = np.append(ids, np.int32(end_id))
                    for w, o, s, n in p.place(len(ids)):
                        held.setdefault(w, []).append((key, s, n, ids[s : s + n], len(ids), base + w, o))
                    for w in p.closed:
                        rows += held.pop(w)
                    p.closed.clear()
                if rows:
                    yield frame(rows, False)
        if held:
            yield frame([r for w in sorted(held) for r in held[w]], True)

    chosen = small_batches(docs).select(F.col(id_col).alias("k_id"), F.col(text_col).cast("string").alias("k_text"))
    kind = chosen.schema["k_id"].dataType.simpleString()
    pieces, _ = materialise(chosen.mapInPandas(thrifty(run), f"k_id {kind}, start long, length long, ids array<int>, doc_tokens long, window_ long, offset long, crc long, left_ boolean"))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        """Leftover windows of a group, one after the other, cut into whole windows."""
        part = part.sort_values(["fill", "window_"], ascending=[False, True])
        p, names, rows = Packer(length, 1, 1), part["window_"].tolist(), []
        for window, n in zip(names, part["fill"].tolist()):
            rows += [(window, s, s + m, names[to], o) for to, o, s, m in p.place(n)]
        return pd.DataFrame(rows, columns=["from_", "lo_", "hi_", "to_", "at_"])

    left = pieces.where("left_")
    # leftovers of four neighbouring partitions make one group of a bounded size
    fill = left.groupBy("window_").agg(F.sum("length").alias("fill")).withColumn("group_", F.shiftright("window_", 31 + 2))
    moved = fill.groupBy("group_").applyInPandas(merge, "from_ long, lo_ long, hi_ long, to_ long, at_ long")
    first, last = F.greatest("offset", "lo_"), F.least(F.col("offset") + F.col("length"), F.col("hi_"))
    joined = left.join(moved, (left["window_"] == moved["from_"])).where(first < last).withColumn("first_", first).withColumn("n_", last - first)
    skip = F.col("first_") - F.col("offset")
    part = F.slice("ids", (skip + 1).cast("int"), F.col("n_").cast("int"))
    value, name = (crc32(part), "ids_crc32") if digest else (part, "ids")
    merged = joined.select("k_id", (F.col("start") + skip).alias("start"), F.col("n_").alias("length"), value.alias(name), "doc_tokens", F.col("to_").alias("sequence_id"), (F.col("first_") - F.col("lo_") + F.col("at_")).alias("offset"))
    closed = pieces.where("NOT left_").select("k_id", "start", "length", F.col("crc" if digest else "ids").alias(name), "doc_tokens", F.col("window_").alias("sequence_id"), "offset")
    return closed.unionByName(merged).withColumnRenamed("k_id", id_col)


@F.pandas_udf(LongType())
def crc32(ids: pd.Series) -> pd.Series:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return ids.map(lambda x: zlib.crc32(np.asarray(x, dtype="<i4").tobytes()))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digest=True)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the pieces of all documents, with their ids, in sequences for training. A null or empty text is
    one piece, its end mark; a long one is cut into as many pieces as it takes; repeated rows and null ids
    are packed like others; other columns are left out; an empty table gives no rows."""
    return pack(docs, public_tokenizers.path(TOKENIZER))
