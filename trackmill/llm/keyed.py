"""Whole texts moved by a key: rows meet their text again, in a form that shuffles small."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a null id in keys; a text with this id is told apart by its hash.
NULL = -(1 << 63)
_LIBC = ctypes.CDLL(None)
#: Rows and bytes in a batch of texts; batches after which a task gives freed memory back.
ROWS, BYTES, EVERY = 1000, 4 << 20, 16


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, after having the session send rows to Python by the thousand and by BYTES at most:
    whole texts are long, and a batch of ten thousand is held several times over."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    return docs


def give_back() -> None:
    """Give memory that was freed back to the system: a worker goes on to other stages, and both
    Arrow's and the C library's allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that gives freed memory back now and then, and at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        for n, x in enumerate(run(batches), 1):
            yield x
            del x
            if n % EVERY == 0:
                give_back()
        give_back()

    return wrapped


def chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, k_text): ids as long with NULL for null, texts with null as empty."""
    return small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("k_text"))


def tag(data: bytes) -> int:
    """Tells texts of one id apart."""
    return xxhash.xxh32_intdigest(data) - (1 << 31)


def wide_tag(data: bytes) -> int:
    """The same in 64 bits, for many texts of one id: what Spark's xxhash64 gives for the string."""
    x = xxhash.xxh64_intdigest(data, 42)
    return x - (1 << 64) if x >> 63 else x


def packed(docs: DataFrame, id_col: str, text_col: str, tag: Callable[[bytes], int] = tag) -> DataFrame:
    """(k, t, z): a row for each of docs with its key and its compressed text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data = [x.encode("utf-8", "replace") for x in b["k_text"]]
            yield pd.DataFrame({"k": b["k"], "t": list(map(tag, data)), "z": list(map(press.compress, data))})

    return chosen(docs, id_col, text_col).mapInPandas(thrifty(run), f"k long, t {'long' if tag is wide_tag else 'int'}, z binary")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def renamed_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("k", F.when(F.col("k") != NULL, F.col("k"))).withColumnRenamed("k", id_col)
