"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte 2-, 3- and 4-grams of its lower-cased UTF-8, with all that isn't a
letter taken for a space. Each is hashed to a bucket, a text is the mean of its buckets'
embeddings, and a linear softmax over it gives the languages. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, on a bounded sample whose subwords are counted
in tasks. A part of the sample is held back to calibrate: a temperature makes scores into
probabilities, and two limits tell which texts are rejected: a score, and a share of subwords
that training has seen, below what the texts held back have.

For prediction the embeddings are multiplied by the softmax's weights beforehand, which gives the
same mean; that table, of a fixed number of buckets, is what tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.llm.keyed import give_back, small_batches, thrifty
from trackmill.sources.tables import materialise, table

BUCKETS, DIM, SEED, EPOCHS, BATCH, RATE = 1 << 16, 16, 11, 12, 16, 0.5
#: Training texts for each language, and in all: the bound of the sample.
PER_LANGUAGE, MOST = 500, 4000
#: Parts of a label's rows that are ranked on their own first; bytes of counts that the driver gets.
PARTS, SAMPLE_BYTES = 64, 64 << 20
#: Of the texts held back, the share that may be rejected; no score above MAJORITY is rejected.
REJECT, MAJORITY, KNOWN = 0.001, 0.5, 0.5
UNKNOWN = "und"
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subwords(text: str, step: int = 1 << 18) -> Iterator[np.ndarray]:
    """Buckets of a text's subwords, a part of the text at a time."""
    data = (" " + text.lower() + " ").encode("utf-8", "replace").translate(_LETTERS)
    for lo in range(0, len(data), step):
        b = np.frombuffer(data[lo : lo + step + 3], dtype=np.uint8).astype(np.uint32)
        n_at = min(step, len(b))
        gap = b == 32
        code = b
        for n in (2, 3, 4):
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            use = code[:n_at]
            # no subword that starts with two spaces or ends with two
            keep = ~(gap[: len(use)] & gap[1 : len(use) + 1])
            if n > 2:
                keep &= ~(gap[n - 2 : len(use) + n - 2] & gap[n - 1 : len(use) + n - 1])
            yield (use[keep] * np.uint32(_MULTIPLIERS[n])) >> np.uint32(16)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # (buckets, labels + 1): embedding times softmax weights; 1 for a bucket that training has seen
    bias: np.ndarray
    temperature: float
    least_score: float
    least_known: float

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Label, score, share of known subwords, and whether the prediction is accepted."""
        if not text or not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, 0.0, False
        total, n = np.zeros(self.table.shape[1]), 0
        for h in subwords(text):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        total /= max(n, 1)
        p = _softmax((total[:-1] + self.bias)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        score, known = float(p[best]), float(total[-1])
        return self.labels[best], score, known, score >= self.least_score and known >= self.least_known


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray, bool]]) -> Model:
    """A model from (label, buckets, counts, held back); the same samples give the same model."""
    labels = sorted({s[0] for s in samples})
    if not labels:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0), 1.0, 0.0, 0.0)
    y = np.array([labels.index(s[0]) for s in samples])
    back = np.array([s[3] for s in samples])
    learn = np.flatnonzero(~back) if (~back).any() else np.arange(len(samples))
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1, 1, size=(BUCKETS, DIM)).astype(np.float32) / DIM
    w, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    weight = [(s[2] / max(1, s[2].sum())).astype(np.float32) for s in samples]
    balance = 1 / np.bincount(y[learn], minlength=len(labels)).clip(1)
    balance = (balance / balance[y[learn]].mean()).astype(np.float32)
    steps, done = EPOCHS * -(-len(learn) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            idx, wt = np.concatenate([samples[i][1] for i in at]), np.concatenate([weight[i] for i in at])
            row = np.repeat(np.arange(len(at)), [len(weight[i]) for i in at])
            x = np.zeros((len(at), DIM), np.float32)
            np.add.at(x, row, e[idx] * wt[:, None])
            p = _softmax(x @ w + bias).astype(np.float32)
            p[np.arange(len(at)), y[at]] -= 1
            p *= balance[y[at]][:, None]
            dx = p @ w.T
            w -= rate * x.T @ p
            bias -= rate * p.mean(axis=0)
            # subwords are many and each has a small weight, so that embeddings take longer steps
            np.subtract.at(e, idx, (10 * rate * wt)[:, None] * dx[row])
    seen = np.zeros(BUCKETS, bool)
    for i in learn:
        seen[samples[i][1]] = True
    whole = np.concatenate((e @ w, seen[:, None]), axis=1).astype(np.float32)
    held = np.flatnonzero(back) if back.any() else learn
    total = np.array([(whole[samples[i][1]] * weight[i][:, None]).sum(axis=0) for i in held], dtype=np.float64).reshape(len(held), -1)
    logits = total[:, :-1] + bias
    grid = np.geomspace(0.05, 5, 41)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]].clip(1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / t)
    right = p[np.arange(len(held)), y[held]]
    return Model(labels, whole, bias.astype(np.float64), t, float(min(MAJORITY, np.quantile(right, REJECT))), float(KNOWN * np.quantile(total[:, -1], REJECT)))


def in_turn(sizes: list, room: int) -> list[tuple]:
    """(label, h, t) of sample texts (label, h, t, size) that fit into `room` bytes: labels take turns, each with
    its texts in the order of their hashes, and one whose next text is too long stops. The first text of every
    label is taken in any case, so that none is lost."""
    waiting: dict[str, list] = {}
    for r in sorted(sizes, key=lambda r: (r["h"], r["t"]), reverse=True):
        waiting.setdefault(r["label"], []).append(r)
    taken, first = [], True
    while waiting:
        for label in sorted(waiting):
            r = waiting[label].pop()
            if r["size"] > room and not first:
                del waiting[label]
                continue
            room -= r["size"]
            taken.append((label, r["h"], r["t"]))
            if not waiting[label]:
                del waiting[label]
        first = False
    return taken


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a sample of the rows of docs for which `allowed` holds and label and text are not
    null: per_language rows of each label by the hash of their id, `most` rows in all, and no more
    than sample_bytes of counts, of which labels take their texts in turn. Subwords of whole texts are counted in tasks; the driver gets the
    counts of the sample only. Rows that repeat an id, text and label count once; null ids share
    one hash, and their texts' hashes tell them apart; an empty table learns nothing."""
    rows = docs.where(allowed & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED)).alias("h"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    # first within parts of a label, so that no task sees more than PARTS * per_language of its rows; repeated rows count once
    part = F.pmod("h", F.lit(PARTS)).alias("part")
    near = rows.select("label", "h", "t", part).withColumn("n", F.dense_rank().over(Window.partitionBy("label", "part").orderBy("h", "t"))).where(F.col("n") <= per_language)
    near = near.select("label", "h", "t").distinct()
    keys = near.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "t"))).where(F.col("n") <= per_language).orderBy("n", "label").limit(most)
    chosen = rows.join(F.broadcast(keys), ["label", "h", "t"], "left_semi")  # at most `most` narrow rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for label, h, t, text in zip(b["label"], b["h"], b["t"], b["text"]):
                if has_letter(text):
                    n = np.zeros(BUCKETS, dtype=np.int32)
                    for s in subwords(text):
                        n += np.bincount(s, minlength=BUCKETS).astype(np.int32)
                    at = np.flatnonzero(n)
                    out.append((label, h, t, at.astype(np.int32).tobytes(), n[at].tobytes()))
            yield pd.DataFrame(out, columns=["label", "h", "t", "at", "n"])

    counted, _ = materialise(chosen.mapInPandas(thrifty(run), "label string, h long, t long, at binary, n binary").dropDuplicates(["label", "h", "t"]))
    sizes = counted.select("label", "h", "t", (F.length("at") + F.length("n")).alias("size")).collect()  # `most` rows at most
    if sum(r["size"] for r in sizes) > sample_bytes:
        fits = docs.sparkSession.createDataFrame(in_turn(sizes, sample_bytes), "label string, h long, t long")
        counted = counted.join(F.broadcast(fits), ["label", "h", "t"], "left_semi")
    counted = counted.collect()
    counted.sort(key=lambda r: (r["h"], r["t"], r["label"]))
    return fit([(r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32), r["h"] % 5 == 0) for r in counted])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, known (share of subwords that training has seen) and accepted.

    A null text, and one without a letter, is `und` with score 0 and not accepted; so is every
    text if nothing could be learned. Long texts are read whole. Rows and other columns stay as
    they are, columns of these four names excepted; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = small_batches(docs).drop("lang_pred", "score", "known", "accepted")

    @F.pandas_udf("lang_pred string, score double, known double, accepted boolean")
    def judged(text: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([shared.value.predict(x) for x in text], columns=["lang_pred", "score", "known", "accepted"])
        give_back()
        return out

    names = [F.col(f"`{c}`") for c in plain.columns]
    return plain.withColumn("judged_", judged(F.col(text_col).cast("string"))).select(*names, "judged_.*")


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4).cast("int")


def learned(docs: DataFrame) -> Model:
    """The model of the query and the pipeline: fold 2 of 4 is never learned from."""
    return train(docs, remainder() != 2)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = predict(docs.select("doc_id", "text"), learned(docs))
    return judged.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "known", "accepted")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that are rejected go, and so do those of a null or empty text, or without a letter. Where
    no label is known nothing can be learned, and all go. Long texts are read whole; equal rows have one result
    and all stay or go; null ids are judged like others (and never learned from); columns stay as they are."""
    return predict(docs, learned(docs)).where("accepted").select(*[f"`{c}`" for c in docs.columns])
