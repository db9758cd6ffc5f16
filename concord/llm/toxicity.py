"""Toxicity: a sparse logistic model whose score may not hang on whom a text mentions.

Features are the presence of words and of their first 4, 5 and 6 letters, hashed, so
inflections of a stem share weight. The loss is log-loss with balanced classes, an L1
term that keeps few weights, and the counterfactual term: labelled texts that mention an identity
group are read once more with the term swapped for another of its group, and the squared change of
the score's logit is penalised. What remains of toxic phrasing around a mention counts; the mention itself doesn't.

Only the text is an input of a score. Labels are learnt from at most SAMPLE labelled
rows whose crc32 of doc_id modulo FOLDS isn't 0, those with the least hash of doc_id;
the others are held out; of several texts of one doc_id the least is learnt. Features seen in fewer than RARE of these rows are not learnt.

Null and empty texts score as the model's prior; a doc_id that is null is never held out nor learnt from; rows
repeat as they came. With no labelled row, or one class only, the score is the share of label 1 (0.0 if there is none).
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

SAMPLE, FOLDS, BUCKETS, RARE = 12_000, 5, 1 << 20, 3
PREFIXES = (4, 5, 6)
L1, SWAP, STEPS = 1e-3, 1.0, 150
CACHED, BLOCK = 200_000, 1 << 19

#: Terms that name a group of people, by what they have in common; a term is swapped for the next of its row.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("mexican", "african", "chinese", "american", "european"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("musulmán", "cristiano", "judío"),
    ("musulman", "chrétien", "juif"),
    ("muslimisch", "christlich", "jüdisch"),
    ("old", "young", "disabled"),
)
SWAPS = {a: row[(i + 1) % len(row)] for row in IDENTITIES for i, a in enumerate(row)}
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def hashed(word: str) -> list[int]:
    """The word's own feature and those of its prefixes."""
    import xxhash

    return [xxhash.xxh32_intdigest(word) % BUCKETS, *(xxhash.xxh32_intdigest(f"{word[:n]}*") % BUCKETS for n in PREFIXES if len(word) >= n)]


def features(found: set[str]) -> list[int]:
    return sorted({f for w in found for f in hashed(w)})


class _Weighted(dict):
    """The features of a word that have a weight. It starts anew when full, so memory is bounded."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        own = tuple(f for f in hashed(word) if f in self.weights)
        if len(word) <= 40:
            if len(self) >= CACHED:
                self.clear()
            self[word] = own
        return own


class Model:
    """Weights of the few features that have one."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights
        self.cache = _Weighted(weights)

    def score(self, text: str) -> float:
        found = set().union(*map(self.cache.__getitem__, words(text)))
        z = self.bias + math.fsum([self.weights[f] for f in found])
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    def __getstate__(self):
        return self.bias, self.weights

    def __setstate__(self, state):
        self.__init__(*state)


class _Matrix:
    """Rows of features, each 0 or 1, worked on in blocks so that no step needs more than BLOCK numbers at once."""

    def __init__(self, lists: list[np.ndarray], column: np.ndarray, columns: int):
        """column: of each feature, its place from 1, or 0 if it isn't learnt."""
        kept = []
        for x in lists:
            place = column[x]
            kept.append(place[place > 0] - 1)
        self.n, self.columns = len(lists), columns
        self.sizes = np.array([len(x) for x in kept], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.col = np.concatenate([np.zeros(0, np.int32), *kept])
        self.blocks = np.unique(np.searchsorted(self.at, [*range(0, int(self.at[-1]), BLOCK), int(self.at[-1])], side="right") - 1).tolist()

    def _parts(self):
        for a, b in pairwise(sorted({0, *self.blocks, self.n})):
            yield a, b, self.col[self.at[a] : self.at[b]]

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix by a vector."""
        out = np.zeros(self.n)
        for a, b, col in self._parts():
            some = np.flatnonzero(self.sizes[a:b])
            if len(some):
                out[a + some] = np.add.reduceat(v[col], self.at[a + some] - self.at[a])
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        """A vector by the matrix."""
        out = np.zeros(self.columns)
        for a, b, col in self._parts():
            out += np.bincount(col, np.repeat(e[a:b], self.sizes[a:b]), minlength=self.columns)
        return out


def fit(rows: Iterable[tuple[int, np.ndarray, np.ndarray | None]], l1: float = L1, swap: float = SWAP, steps: int = STEPS) -> Model:
    """rows: label, features, and the features after the swap where there is one; read once. Accelerated proximal gradient steps."""
    labels, own, other, swapped_at = [], [], [], []
    for label, features_, changed in rows:
        if changed is not None:
            swapped_at.append(len(own))
            other.append(np.asarray(changed, np.int32))
        labels.append(label)
        own.append(np.asarray(features_, np.int32))
    y, at = np.array(labels, float), np.array(swapped_at, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(-30.0 if share == 0 else 30.0, {})
    counts = np.zeros(BUCKETS, np.int64)
    for x in own:
        counts[x] += 1  # features of a row are distinct
    column = (np.cumsum(counts >= RARE) * (counts >= RARE)).astype(np.int32)
    names = np.flatnonzero(counts >= RARE)
    d, n = len(names), len(own)
    texts, swaps = _Matrix(own, column, d), _Matrix(other, column, d)
    del own, other, counts, column
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))

    def slope(z, v, e):
        """Of the log-loss (e: its slope by each text's logit) and of the squared changes under swaps; z: the texts' logits at v, without bias."""
        if not len(at):
            return texts.back(e)
        gap = (z[at] - swaps.times(v)) * (2 * swap / len(at))
        g = e.copy()
        np.add.at(g, at, gap)
        return texts.back(g) - swaps.back(gap)

    # The curvature's bound by power iteration.
    v, b = np.ones(d) / max(1.0, np.sqrt(d)), 1.0
    top = 1.0
    for _ in range(12):
        z = texts.times(v)
        s = 0.25 * weight * (z + b)
        u, ub = slope(z, v, s), s.sum()
        top = float(np.sqrt(u @ u + ub * ub)) or 1.0
        v, b = u / top, ub / top
    rate = 1 / (1.1 * top)
    w, bias = np.zeros(d), 0.0
    ahead, bias_ahead, t = w, bias, 1.0
    for _ in range(steps):
        z = texts.times(ahead)
        e = weight * (1 / (1 + np.exp(-np.clip(z + bias_ahead, -30, 30))) - y)
        new, new_bias = ahead - rate * slope(z, ahead, e), bias_ahead - rate * e.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    there = np.flatnonzero(w)
    return Model(float(bias), dict(zip(names[there].tolist(), w[there].tolist(), strict=True)))


def swapped(found: set[str]) -> set[str] | None:
    if not found & SWAPS.keys():
        return None
    return {SWAPS.get(w, w) for w in found}


def _learnt_from(batches):
    for batch in batches:
        own, other = [], []
        for text in batch["text"].to_pylist():
            found = words(text)
            changed = swapped(found)
            own.append(np.array(features(found), "<i4").tobytes())
            other.append(None if changed is None else np.array(features(changed), "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(own, pa.binary()), pa.array(other, pa.binary())], ["toxic", "own", "other"])


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """Remainder of the crc32 of doc_id written as text; null for null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most so many ids
    rows = rows.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text"))  # and so many rows
    rows = rows.select("toxic", "text").mapInArrow(_learnt_from, "toxic int, own binary, other binary")
    number = lambda x: None if x is None else np.frombuffer(x, "<i4")
    return fit((1 if r.toxic else 0, number(r.own), number(r.other)) for r in rows.collect())


def _scores(batches, model):
    for batch in batches:
        scores = pa.array([model.score(t) for t in batch["text"].to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), scores], [*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, null texts as empty ones, with their score; columns of that name are replaced."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(text_or_empty().alias("text") if c == "text" else c for c in docs.columns if c != "score"))
    return rows.mapInArrow(partial(_scores, model=model), ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), "score double"]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
