"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts it where its low bits are zero, so that passages which
documents share fall into equal chunks wherever they stand. A chunk is encoded once while a task
remembers it: the words between its first and last white space give its ids, and what stands
before and after them is left open. Joins are then repaired: the open end of one chunk and the
open start of the next are re-encoded together, over as many chunks as it takes until white
space bounds the piece on both sides. White space is where the encodings agree exactly, since the
tokenizer's normalizer, its pre-tokenizer and its merges never look across it.

Chunks, and the words in them, are remembered per Python worker, a bounded number of each;
sharing them through a shuffle would move every text once more. Results don't depend on what
is remembered.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm.keyed import small_batches
from trackmill.sources.tables import table

TOKENIZER = "word_bpe_49k.json"
#: A cut falls on one in 1 << CUT_BITS bytes; words and chunks that a worker remembers; bytes taken at a time.
CUT_BITS, WORDS, CHUNKS, PART = 9, 400_000, 10_000, 1 << 18

_GEAR = np.random.default_rng(20).integers(0, 1 << 64, size=256, dtype=np.uint64).astype(np.uint32)
#: Kinds of bytes: white space on which every rule agrees, letters, digits, and marks that start no contraction and no special token.
_SPACE, _LETTER, _DIGIT, _MARK, _WIDE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t\n\r")] = _SPACE
_KIND[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b".,;:!?)")] = _MARK
_KIND[128:] = _WIDE
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_SAFE = re.compile(rb"[ \t\n\r]")


def cuts(data: bytes, bits: int = CUT_BITS) -> np.ndarray:
    """Where content-defined chunks of UTF-8 bytes end, the end of data included."""
    b = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[b]
    for width in (1, 2, 4, 8, 16):  # a gear hash over the last 32 bytes, by doubling
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    at = at[at < len(b)]
    while len(inside := np.flatnonzero((b[at] & 0xC0) == 0x80)):  # on to the next character
        at[inside] += 1
        at = at[at < len(b)]
    return np.unique(np.append(at, len(b)))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two random values of each byte, powers of an odd number and of its inverse, modulo 2**64."""
    value = np.random.default_rng(21).integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
    q = 0xD1342543DE82EF95
    power = lambda x: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, dtype=np.uint64), dtype=np.uint64)))
    return value, power(q), power(pow(q, -1, 1 << 64))


class Encoder:
    """Encodes as the tokenizers library does with add_special_tokens=False.

    Words are remembered by two 64-bit hashes of their bytes, in flat arrays: `start` and `size`
    of their ids in `pool`. When there are too many, those that were met in one batch only are
    forgotten; all, if that is too few.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([x.endswith("</w>") for x in self.token])
        self.chunks: dict[bytes, tuple[bytes, np.ndarray, bytes] | None] = {}
        self.most_words, self.most_chunks = WORDS, CHUNKS
        self._forget()

    def _forget(self) -> None:
        none = np.array([], dtype=np.int64)
        self.hash, self.check, self.start, self.size, self.pool = none.view(np.uint64), none.view(np.uint64), none, none, np.array([], dtype=np.int32)
        self.again = np.array([], dtype=bool)  # met since they were learned or last kept

    def _keep(self) -> None:
        """Forget the words that were not met again."""
        kept = self.again
        n = self.size[kept]
        stop = np.cumsum(n)
        self.pool = self.pool[np.repeat(self.start[kept] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        self.hash, self.check, self.start, self.size = self.hash[kept], self.check[kept], stop - n, n
        self.again = np.zeros(len(n), dtype=bool)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        ids, size = [], np.zeros(len(words), dtype=np.int64)
        plain = [i for i, w in enumerate(words) if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        for lo in range(0, len(plain), 5000):
            # letters only: one piece each, whose last id alone is a word's end
            part = plain[lo : lo + 5000]
            got = np.array(self.tokenizer.encode(" ".join([words[i] for i in part]), add_special_tokens=False).ids, dtype=np.int32)
            stop = np.flatnonzero(self.ends[got]) + 1
            if len(stop) == len(part):
                size[part] = np.diff(stop, prepend=0)
                ids.append((part, got))
        rest = np.flatnonzero(size == 0).tolist()
        for lo in range(0, len(rest), 5000):
            part = rest[lo : lo + 5000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)]
            size[part] = list(map(len, got))
            ids.append((part, np.array(list(chain.from_iterable(got)), dtype=np.int32)))
        out, at = np.empty(int(size.sum()), dtype=np.int32), np.cumsum(size) - size
        for part, got in ids:
            n = size[part]
            out[np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return out, size

    def _words(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with A-Z lower-cased where that is safe, first byte and end of each word)."""
        kind = _KIND[b]
        space = kind == _SPACE
        before, after = kind[:-1], kind[1:]
        # the pre-tokenizer splits between a letter and a mark, and at each side of a digit, in any case
        split = ((before == _LETTER) & (after == _MARK)) | (before == _DIGIT) | (after == _DIGIT)
        start = np.flatnonzero(~space & np.r_[True, space[:-1] | split])
        end = np.flatnonzero(~space & np.r_[space[1:] | split, True]) + 1
        low = _LOWER[b]
        if len(start):
            # a capital before a combining mark composes in its own way
            wide = np.maximum.reduceat(kind, start) >= _WIDE
            for i in np.flatnonzero(wide & (np.add.reduceat((b != low).astype(np.int32), start) > 0)):
                low[start[i] : end[i]] = b[start[i] : end[i]]
        return low, start, end

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that white space bounds, one after the other, and how many each has."""
        ids, sizes = [], []
        part, room = [], 0
        for i, x in enumerate(texts):
            part.append(x)
            room += len(x) + 1
            if room >= PART or i == len(texts) - 1:
                got, size = self._some_words(part)
                ids.append(got)
                sizes.append(size)
                part, room = [], 0
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (self.pool[:0], self.start[:0])

    def _some_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b" ".join(texts)
        if b"<|" in data and len(texts) > 1:  # texts with strings of special tokens are encoded alone
            plain = [x if b"<|" not in x else b"" for x in texts]
            got, size = self._some_words(plain)
            special = {i: np.array(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids, dtype=np.int32) for i, x in enumerate(texts) if b"<|" in x}
            parts = np.split(got, np.cumsum(size)[:-1])
            for i, x in special.items():
                parts[i], size[i] = x, len(x)
            return np.concatenate(parts), size
        if b"<|" in data:
            got = np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, dtype=np.int32)
            return got, np.array([len(got)])
        if not data:
            return self.pool[:0], np.zeros(len(texts), dtype=np.int64)
        low, start, end = self._words(np.frombuffer(data, dtype=np.uint8))
        value, power, inverse = _powers(1 << max(19, len(low).bit_length()))
        first, second = ((s := np.concatenate(([np.uint64(0)], np.cumsum(v[low] * power[: len(low)], dtype=np.uint64))), (s[end] - s[start]) * inverse[start])[1] for v in value)
        first ^= first >> np.uint64(29)
        one, back = np.unique(first, return_inverse=True)
        sample = np.empty(len(one), dtype=np.int64)
        sample[back] = np.arange(len(back))
        at = np.minimum(np.searchsorted(self.hash, one), max(len(self.hash) - 1, 0))
        known = self.hash[at] == one if len(self.hash) else np.zeros(len(one), bool)
        new = np.flatnonzero(~known)
        self.again[at[known]] = True
        if len(new):
            if len(self.hash) + len(new) > self.most_words and len(self.hash):
                if 2 * int(self.again.sum()) <= self.most_words and int(self.again.sum()) + len(new) <= self.most_words:
                    self._keep()
                else:
                    self._forget()
                return self._some_words(texts)
            low_bytes = low.tobytes()
            got, size = self._library([low_bytes[i:j].decode() for i, j in zip(start[sample[new]].tolist(), end[sample[new]].tolist())])
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(size) - size))
            self.size, self.pool = np.concatenate((self.size, size)), np.concatenate((self.pool, got))
            self.hash, self.check = np.concatenate((self.hash, one[new])), np.concatenate((self.check, second[sample[new]]))
            order = np.argsort(self.hash, kind="stable")
            self.hash, self.check, self.start, self.size = self.hash[order], self.check[order], self.start[order], self.size[order]
            self.again = np.concatenate((self.again, np.zeros(len(new), dtype=bool)))[order]
            at = np.searchsorted(self.hash, one)
        word = at[back]
        if (self.check[word] != second).any():
            raise RuntimeError("two words share a 64-bit hash")
        n = self.size[word]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.start[word] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        length = np.array(list(map(len, texts)), dtype=np.int64) + 1
        until = np.searchsorted(start, np.cumsum(length))  # words before each text's end
        return ids, np.diff(np.concatenate(([0], stop))[until], prepend=0)

    def encode_plain(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without chunks."""
        ids, size = self.words([(x or "").encode("utf-8", "replace") for x in texts])
        return np.split(ids, np.cumsum(size)[:-1]) if texts else []

    def encode(self, texts: list[str | None], bits: int = CUT_BITS) -> list[np.ndarray]:
        """Ids of each text; a null text has none. By chunks that are encoded once."""
        if len(self.chunks) > self.most_chunks:
            self.chunks.clear()
        pieces, fresh = [], {}
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            own, start = [], 0
            for end in cuts(data, bits).tolist() if data else []:
                own.append(piece := data[start:end])
                start = end
                if piece not in self.chunks and piece not in fresh:
                    if gap := _SAFE.search(piece):
                        last = max(map(piece.rfind, (b" ", b"\t", b"\n", b"\r")))
                        fresh[piece] = (piece[: gap.start()], piece[gap.start() : last], piece[last + 1 :])
                    else:
                        fresh[piece] = None
            pieces.append(own)
        open_ = [(piece, x) for piece, x in fresh.items() if x]
        ids, size = self.words([x[1] for _, x in open_])
        for (piece, x), body in zip(open_, np.split(ids, np.cumsum(size)[:-1])):
            self.chunks[piece] = (x[0], body, x[2])
        for piece, x in fresh.items():
            if x is None:
                self.chunks[piece] = None
        # joins: what stands between the white space of one chunk and of the next that has any
        joined, repair = [], {}
        for own in pieces:
            parts, open_end = [], b""
            for piece in own:
                x = self.chunks[piece]
                if x is None:
                    open_end += piece
                    continue
                if open_end or x[0]:
                    parts.append(repair.setdefault(open_end + x[0], len(repair)))
                parts.append(x[1])
                open_end = x[2]
            if open_end:
                parts.append(repair.setdefault(open_end, len(repair)))
            joined.append(parts)
        ids, size = self.words(list(repair))
        mended = np.split(ids, np.cumsum(size)[:-1]) if repair else []
        none = self.pool[:0]
        return [np.concatenate([mended[p] if isinstance(p, int) else p for p in parts]) if parts else none for parts in joined]

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False): this vocabulary has no decoder, so tokens are joined by a space."""
        return " ".join(map(self.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    lo = n = 0
    for i, x in enumerate(texts):
        n += len(x or "") + 64
        if n >= most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id_col, ids[, decoded]): a row for each of docs, in no order.

    A null or empty text has no ids; a long text is encoded whole; strings of special tokens in
    a text become their ids, as in the library; repeated rows give repeated results; a null id
    stays null; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            texts, keys = b["k_text"].tolist(), b["k_id"]
            for lo, hi in slices(texts):
                ids = e.encode(texts[lo:hi])
                out = {"k_id": keys.iloc[lo:hi].array, "ids": ids}
                if decode:
                    out["decoded"] = list(map(e.decode, ids))
                yield pd.DataFrame(out)

    chosen = small_batches(docs).select(F.col(id_col).alias("k_id"), F.col(text_col).cast("string").alias("k_text"))
    kind = chosen.schema["k_id"].dataType.simpleString()
    return chosen.mapInPandas(run, f"k_id {kind}, ids array<int>" + ", decoded string" * decode).withColumnRenamed("k_id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
