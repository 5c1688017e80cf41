"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are words and their beginnings of 3 to 8 letters. Of a bounded sample of labelled rows, tasks
add up how much of each text a term is, and the terms that toxic texts hold TIMES as much of (Welch's t
above LEAST_T) are the vocabulary; every other word counts as one further term, present everywhere. Document
frequencies are counted over all documents. The examples' vectors are an inverted index cut into blocks
of like examples, with the largest weight of each term in each block. A text's bound for a block is the
sum of its weights times these; blocks are opened by falling bounds until the bound is below the k-th
best cosine found, so that the neighbours are exact. They vote by 1 / (distance + SOFT), and a logistic
curve, fitted on the examples' votes for each other and weighted to the labels' counts, makes the
votes probabilities. Evidence is the neighbours that a score rests on.

Texts are read twice: those of the sample, and all of them for their vectors, which are written as a
table of a few numbers a text; frequencies and neighbours come from that. What the driver and each task
hold is bounded: PER_LABEL examples a label, each with VOCABULARY terms at most.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm.keyed import small_batches, thrifty
from trackmill.sources.tables import materialise, table

#: Examples of a label at most; terms at most; how sure it must be that toxic texts hold more of a term,
#: and how many times more; texts of the sample that must hold it.
PER_LABEL, VOCABULARY, LEAST_T, TIMES, LEAST_TEXTS = 2000, 512, 2.5, 2.0, 3
#: Neighbours, examples of a block, what is added to distances, neighbours told as evidence.
NEAREST, BLOCK, SOFT, EVIDENCE = 10, 64, 0.02, 3
SHORTEST, LONGEST, SEED = 3, 8, 13
#: Letters that are read at once, and terms or words that a task remembers at most.
PIECE, REMEMBERED = 1 << 20, 200_000
_WORD = re.compile(r"[^\W\d_]+")


def pieces(text: str, step: int = PIECE) -> Iterator[str]:
    """A text in parts that cut no word."""
    lo = 0
    while lo < len(text):
        hi = lo + step
        while hi < len(text) and text[hi].isalpha() and text[hi - 1].isalpha():
            hi += 1
        yield text[lo:hi]
        lo = hi


def word_counts(text: str) -> Counter:
    found: Counter = Counter()
    for part in pieces(text):
        found.update(_WORD.findall(part.lower()))
    return found


def terms(word: str) -> list[str]:
    """A word as a whole, told by a mark, and its beginnings."""
    return [word + "$"] + [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over a task's texts: term, label, texts, root of the term's share of the text's words, its square."""
    sums: dict = {}

    def told() -> pd.DataFrame:
        return pd.DataFrame([(t, y, *x) for (t, y), x in sums.items()], columns=["term", "y", "n", "s", "q"])

    for b in batches:
        for text, y in zip(b["k_text"], b["y"].tolist()):
            counts = word_counts(text)
            total, own = sum(counts.values()), Counter()
            for word, n in counts.items():
                for t in terms(word):
                    own[t] += n
            for t, n in own.items():
                x = sums.setdefault((t, y), [0, 0.0, 0.0])
                x[0] += 1
                x[1] += (n / total) ** 0.5
                x[2] += n / total
        if len(sums) > REMEMBERED:
            yield told()
            sums.clear()
    yield told()


def vocabulary(sample: DataFrame, counts: dict[int, int], most: int = VOCABULARY) -> list[str]:
    """Terms that toxic texts of sample (k_text, y) hold more of, by falling t; counts: texts of each label.
    Of terms that begin alike and occur alike the shortest stands for all."""
    if not counts.get(0) or not counts.get(1):
        return []
    sums = sample.mapInPandas(thrifty(_shares), "term string, y int, n long, s double, q double")
    one = lambda c, y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col(c))), F.lit(0))
    by = sums.groupBy("term").agg(*[one(c, y).alias(f"{c}{y}") for c in "nsq" for y in (0, 1)]).where(F.col("n0") + F.col("n1") >= LEAST_TEXTS)
    mean = {y: F.col(f"s{y}") / counts[y] for y in (0, 1)}
    spread = [F.greatest(F.col(f"q{y}") / counts[y] - mean[y] * mean[y], F.lit(0.0)) / counts[y] for y in (0, 1)]
    t = (mean[1] - mean[0]) / F.sqrt(spread[0] + spread[1] + 1e-6 / counts[1])
    alike = [F.substring("term", 1, SHORTEST), "n0", "n1", F.round("s0", 9), F.round("s1", 9)]
    found = by.withColumn("t", F.round(t, 9)).where((F.col("t") > LEAST_T) & (mean[1] >= TIMES * mean[0])).groupBy(*alike).agg(F.min(F.struct(F.length("term"), "term", "t")).alias("x"))
    return [r["term"] for r in found.select("x.*").orderBy(F.desc("t"), "term").limit(most).collect()]


def _vectors(batches: Iterator[pd.DataFrame], words: dict[str, int]) -> Iterator[pd.DataFrame]:
    """k_terms, k_counts of each text: places in the vocabulary, the last one for all words that have none."""
    known: dict[str, tuple] = {}
    for b in batches:
        at, counts = [], []
        for text in b["k_text"]:
            own, rest = Counter(), 0
            for word, n in word_counts(text).items():
                found = known.get(word)
                if found is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    found = known[word] = tuple(words[t] for t in terms(word) if t in words)
                for i in found:
                    own[i] += n
                rest += 0 if found else n
            if rest:
                own[len(words)] = rest
            order = sorted(own)
            at.append(order)
            counts.append([own[i] for i in order])
        yield b.drop(columns="k_text").assign(k_terms=at, k_counts=counts)


@dataclass
class Index:
    """Examples in blocks: the postings of each term, a block's side by side."""

    weight: np.ndarray  # of each term: its inverse document frequency
    postings: np.ndarray  # (terms, examples): the term's weight in the example's unit vector
    bound: np.ndarray  # (terms, blocks): the largest value
    mass: np.ndarray  # of each example: equal ones, by importance
    toxic: np.ndarray
    names: list
    curve: tuple[float, float] = (1.0, 0.0)
    base: float = 0.0

    def unit(self, at, counts) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(at, np.int64)
        v = np.asarray(counts, np.float64) * self.weight[at]
        return at, v / np.sqrt((v * v).sum())

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int = NEAREST, but: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples of largest cosine (smaller place first among equals), their cosines, and
        how many blocks were opened. but: an example that takes no part."""
        bounds = v @ self.bound[at]
        best_at, best, opened = np.zeros(0, np.int64), np.zeros(0), 0
        for b in np.argsort(-bounds, kind="stable"):
            if len(best) == k and bounds[b] < best[-1] - 1e-12:
                break
            opened += 1
            low = b * BLOCK
            dot = v @ self.postings[:, low : low + BLOCK][at]
            if low <= but < low + BLOCK:
                dot[but - low] = -1
            if len(best) == k and dot.max() < best[-1]:
                continue
            best_at, best = np.concatenate((best_at, np.arange(low, low + len(dot)))), np.concatenate((best, dot))
            order = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[order], best[order]
        return best_at, best, opened

    def vote(self, at: np.ndarray, cosines: np.ndarray, mass: float = 0.0, toxic: float = 0.0) -> float:
        """Share of the toxic among neighbours, by 1 / distance; mass, toxic: of more examples at no distance."""
        near = 1 / (np.sqrt(np.maximum(2 - 2 * cosines, 0)) + SOFT)
        below = (near * self.mass[at]).sum() + mass / SOFT
        return float(((near * self.toxic[at]).sum() + toxic / SOFT) / below) if below > 0 else 0.5

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] * (vote - 0.5) + self.curve[1]))))


def build(vectors: list[tuple[list, list, int, int]], weight: np.ndarray, importance: dict[int, float]) -> Index:
    """An index of (places, counts, label, id). Equal vectors are one example of their joint mass, named by the smallest id."""
    index = Index(weight, *[np.zeros(0)] * 4, [])
    groups: dict = {}
    for at, counts, y, name in vectors:
        if len(at):
            at, v = index.unit(at, counts)
            g = groups.setdefault((tuple(at.tolist()), tuple(np.round(v, 12).tolist())), [at, v, 0.0, 0.0, name])
            g[2], g[3], g[4] = g[2] + importance[y], g[3] + importance[y] * y, min(g[4], name)
    # like examples share a block: those of the same strongest term of the vocabulary, by its weight

    def strongest(g: list) -> tuple[int, float]:
        own = np.where(g[0] < len(weight) - 1, g[1], 0.0)
        return (int(g[0][own.argmax()]), float(own.max())) if own.max() > 0 else (-1, 0.0)

    rows = [groups[k] for k in sorted(groups, key=lambda k: (strongest(groups[k]), k))]
    index.postings = np.zeros((len(weight), len(rows)))
    for i, g in enumerate(rows):
        index.postings[g[0], i] = g[1]
    edges = np.arange(0, len(rows), BLOCK)
    index.bound = np.maximum.reduceat(index.postings, edges, axis=1) if rows else np.zeros((len(weight), 0))
    index.mass, index.toxic, index.names = np.array([g[2] for g in rows]), np.array([g[3] for g in rows]), [g[4] for g in rows]
    total = index.mass.sum()
    index.base = float(index.toxic.sum() / total) if total else 0.0
    if 0 < index.base < 1:
        calibrate(index, rows, importance)
    else:
        index.curve = (0.0, 30.0 if index.base else -30.0)
    return index


def calibrate(index: Index, rows: list, importance: dict[int, float]) -> None:
    """A logistic curve of votes: every example is judged by the others, with its equals but itself."""
    votes, ys, ws = [], [], []
    for i, (at, v, mass, toxic, _) in enumerate(rows):
        near, cosines, _ = index.nearest(at, v, NEAREST, but=i)
        for y, m in ((1, toxic), (0, mass - toxic)):
            if m > 1e-12:
                # its equals stay, at no distance
                votes.append(index.vote(near, cosines, max(mass - importance[y], 0.0), max(toxic - importance[y] * y, 0.0)))
                ys.append(y)
                ws.append(m)
    x, y, w = np.array(votes) - 0.5, np.array(ys, float), np.array(ws)
    a, b = 4.0, 0.0
    for _ in range(60):  # Newton's steps, with a small penalty that keeps the slope finite
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * w.sum() * (a - 8) / 64, (w * (p - y)).sum()])
        h = w * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 1e-3 * w.sum() / 64, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    index.curve = (max(a, 0.1), b)


def _scored(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    known: dict[tuple, tuple] = {}  # most texts hold no term, or what others hold too
    for b in batches:
        scores, evidence = [], []
        for at, counts in zip(b["k_terms"], b["k_counts"]):
            if not len(at) or not len(index.mass):
                scores.append(index.base)
                evidence.append([])
                continue
            whole = np.gcd.reduce(counts)  # what has one direction has one answer
            key = (at.tobytes(), (counts // whole).tobytes())
            found = known.get(key)
            if found is None:
                if len(known) > REMEMBERED // 10:
                    known.clear()
                near, cosines, _ = index.nearest(*index.unit(at, counts // whole))
                found = known[key] = index.score(index.vote(near, cosines)), [{"doc_id": index.names[i], "cosine": float(c), "toxic": float(index.toxic[i] / index.mass[i])} for i, c in zip(near[:EVIDENCE], cosines)]
            scores.append(found[0])
            evidence.append(found[1])
        yield pd.DataFrame({"k_id": b["k_id"], "score": scores, "evidence": evidence})


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def score_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> DataFrame:
    """(id_col, score, evidence) for every row of docs.

    labels: id_col, label_col (0 or 1; other values and nulls are ignored, as are null ids and rows
    for which `allowed`, a condition on labels, doesn't hold). Of each label, per_label ids are the
    sample, by the hash of the id; an id with both labels may count for both. Every document of such
    an id is an example. A null text is empty; a text without words gets the share of toxic labels, and no
    evidence, as does everything where there are no examples. Very long texts are read whole, in parts.
    Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.where(allowed & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("y")).distinct()
    known, _ = materialise(known)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    keyed = known.withColumn("h", F.xxhash64("l_id", F.lit(SEED)))
    sample = functools.reduce(DataFrame.unionByName, [keyed.where(F.col("y") == y).orderBy("h", "l_id").limit(per_label) for y in (0, 1)])
    sample, _ = materialise(sample.select("l_id", "y"))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    rows = small_batches(docs).select(F.col(id_col).alias("k_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("k_text"))
    # two numbers for each of 2 * per_label ids at most
    drawn = rows.join(F.broadcast(sample), F.col("k_id").cast("long") == F.col("l_id")).select("k_text", "y")
    words = vocabulary(drawn, sizes)
    kind = docs.schema[id_col].dataType.simpleString()
    vectors, _ = materialise(rows.mapInPandas(thrifty(functools.partial(_vectors, words={t: i for i, t in enumerate(words)})), f"k_id {kind}, k_terms array<int>, k_counts array<long>"))
    # a line for each term
    often = {r["term"]: r["n"] for r in vectors.select(F.explode("k_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    n_docs = vectors.count()
    weight = np.array([np.log((1 + n_docs) / (1 + often.get(i, 0))) + 1 for i in range(len(words))] + [1.0])
    examples = vectors.join(F.broadcast(sample), F.col("k_id").cast("long") == F.col("l_id")).select("l_id", "y", "k_terms", "k_counts").groupBy("l_id", "y", "k_terms", "k_counts").count().orderBy("l_id", "y", "k_terms", "k_counts").collect()
    index = build([(r["k_terms"], r["k_counts"], r["y"], r["l_id"]) for r in examples], weight, {y: counts[y] / sizes[y] for y in sizes})
    held = spark.sparkContext.broadcast(index)
    told = vectors.mapInPandas(thrifty(lambda batches: _scored(batches, held.value)), f"k_id {kind}, score double, evidence array<struct<doc_id:long,cosine:double,toxic:double>>")
    return told.withColumnRenamed("k_id", id_col)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    told = score_toxicity(docs, labels, fold(F.col("doc_id")) != 0)
    return told.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
