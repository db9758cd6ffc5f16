"""Quality by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= k) = logistic(threshold_k - w.x). All grades share the weights w over
hashed text features; the thresholds are kept in order by being a first one and positive gaps. It gives the expected
grade and the probability of reaching a grade, by which documents are selected.

Features: symbols and shapes of words, pairs of shapes, and bands of length, case, symbols and repeated lines; a text's
counts enter as logarithms, scaled to length one. Only the text is an input. They are made by array operations over a batch of texts.

Fitted on at most SAMPLE rated rows, those with the least hash of doc_id whose crc32 modulo FOLDS isn't 0, of several texts of one doc_id the least; scored over all rows. Null and
empty texts have the band features only. With one grade or none among the ratings, that grade (0 if none) is expected of all.
Rows repeat as they came. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty
from .scan import groups
from .toxicity import fold

SAMPLE, BUCKETS, CACHED = 12_000, 1 << 16, 200_000
STEPS, RATE, L2 = 300, 0.1, 1e-5
GRADE, TAIL = 1, 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    if token.isdigit():
        return "9" * min(len(token), 5)
    if not token.isalnum():
        return token[:4]
    case = "X" if token.isupper() and len(token) > 1 else "Xx" if token[:1].isupper() else "x"
    return f"{case}{min(9, len(token).bit_length())}{'9' if any(c.isdigit() for c in token) else ''}"


def _bucket(*parts: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest("\0".join(parts)) % BUCKETS


class _Vocabulary(dict):
    """Numbers of tokens, and by number: buckets of the word and of its first letters (-1: none), and the shape's number."""

    def __init__(self):
        self.word, self.stem, self.shape = array("i"), array("i"), array("i")
        self.shapes, self.upper, self.symbol = {"": 0}, array("b", [0]), array("b", [0])
        self.names, self.pairs = [""], {}

    def __missing__(self, token: str) -> int:
        word, kind = token.lower(), shape(token)
        self.word.append(_bucket("w", word[:40]))
        self.stem.append(_bucket("f", word[:4]) if token.isalpha() and len(token) >= 4 else -1)
        if kind not in self.shapes:
            self.shapes[kind] = len(self.names)
            self.names.append(kind)
            self.upper.append(kind[:1] == "X" and kind[:2] != "Xx")
            self.symbol.append(not kind.isalnum())
        self.shape.append(self.shapes[kind])
        self[token] = len(self)
        return self[token]

    def pair(self, key: int) -> int:
        """Bucket of two shapes that follow each other, by their numbers in one."""
        if key not in self.pairs:
            self.pairs[key] = _bucket("p", self.names[key >> 32], self.names[key & 0xFFFFFFFF])
        return self.pairs[key]


_KNOWN = [_Vocabulary()]


def _vocabulary() -> _Vocabulary:
    """It starts anew when full, so a worker's memory is bounded."""
    if len(_KNOWN[0]) > CACHED or len(_KNOWN[0].pairs) > CACHED:
        _KNOWN[0] = _Vocabulary()
    return _KNOWN[0]


BANDS = ("length", "tokens", "upper", "symbols", "repeats", "distinct")


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of what each counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row (place in texts), bucket and value, in the order of rows; a row may hold a bucket twice."""
    known, tokens, lengths = _vocabulary(), [], []
    for t in texts:
        found = TOKEN.findall(t)
        tokens += found
        lengths.append(len(found))
    n = np.array(lengths, np.int64)
    number = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    word, stem, kind = (np.array(x, np.int64) for x in (known.word, known.stem, known.shape))
    row = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    kinds = kind[number]
    before = np.concatenate([[0], kinds[:-1]])[: len(kinds)]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    own, times = np.unique(row << 32 | number, return_counts=True)
    r, k = own >> 32, own & 0xFFFFFFFF
    has = stem[k] >= 0
    pair, place = np.unique(before << 32 | kinds, return_inverse=True)
    pair = np.array([known.pair(x) for x in pair.tolist()], np.int64)[place] if len(pair) else place
    keys = np.concatenate([r * BUCKETS + word[k], r[has] * BUCKETS + stem[k][has], row * BUCKETS + pair])
    keys, counts = _counted(keys, np.concatenate([times, times[has], np.ones(len(row), np.int64)]))
    r, bucket, value = keys // BUCKETS, keys % BUCKETS, np.log1p(counts)
    norm = np.sqrt(np.bincount(r, value * value, minlength=len(texts)))
    value /= norm[r]
    of = np.maximum(1, n)
    told = lambda flags: 10 * np.bincount(row, np.array(flags)[kinds], minlength=len(texts)).astype(np.int64) // of
    lines = [t.split("\n") for t in texts]
    bands = {
        "length": [len(t).bit_length() for t in texts],
        "tokens": [x.bit_length() for x in lengths],
        "upper": told(known.upper).tolist(),
        "symbols": told(known.symbol).tolist(),
        "repeats": [10 * (len(x) - len(set(x))) // len(x) for x in lines],
        "distinct": (10 * np.bincount(own >> 32, minlength=len(texts)) // of).tolist(),
    }
    fixed = np.array([[_bucket("p", f"band {name}", str(band)) for band in bands[name]] for name in BANDS], np.int64).T.ravel()
    row, bucket, value = np.concatenate([r, np.repeat(np.arange(len(texts)), len(BANDS))]), np.concatenate([bucket, fixed]), np.concatenate([value, np.full(len(fixed), 0.5)])
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], value[order]


class Model:
    """grades: the ratings that occur, ascending; thresholds: one fewer."""

    def __init__(self, grades: list[int], thresholds: np.ndarray, weights: np.ndarray):
        self.grades, self.thresholds, self.weights = grades, thresholds, weights

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) of each grade but the least: a column for each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.reshape(x, (-1, 1)), -40, 40)))

    def score(self, texts: list[str], grade: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the expected grade, and the probability of reaching one."""
        row, k, v = features(texts)
        tails = self.tails(np.bincount(row, self.weights[k] * v, minlength=len(texts)))
        expected = self.grades[0] + tails @ np.diff(self.grades)
        if self.grades[0] >= grade:
            return expected, np.ones(len(texts))
        above = [i for i, g in enumerate(self.grades[1:]) if g >= grade]
        return expected, tails[:, above[0]] if above else np.zeros(len(texts))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = STEPS) -> Model:
    """rows: grade, buckets, values. Adam over the whole sample; all rows have the same weight. Every row has features: the bands at least."""
    grades = sorted({r[0] for r in rows})
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(0), np.zeros(BUCKETS))
    y = np.searchsorted(grades, [r[0] for r in rows])
    n, k = len(rows), len(grades) - 1
    # The matrix by rows, and once more by columns: sums over either are sums over runs.
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r[1]) for r in rows])
    col = np.concatenate([np.asarray(r[1], np.int32) for r in rows])
    val = np.concatenate([np.asarray(r[2], np.float32) for r in rows])
    rows_at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    order = np.argsort(col, kind="stable")
    by_col, val_by_col = row[order], val[order]
    cols_at = np.flatnonzero(np.concatenate([[True], np.diff(col[order]) != 0]))
    names = col[order][cols_at]
    del order, row
    share = np.clip(np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = [np.zeros(BUCKETS), np.array([start[0]]), gaps]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, t0, g = params
        theta = t0[0] + np.concatenate([[0.0], np.cumsum(np.exp(g))])
        z = np.add.reduceat(val * w[col], rows_at)
        upper = np.where(y < k, logistic(theta[np.minimum(y, k - 1)] - z), 1.0)
        lower = np.where(y > 0, logistic(theta[np.maximum(y - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(y < k, upper * (1 - upper), 0) / p, np.where(y > 0, lower * (1 - lower), 0) / p
        dz = (du - dl) / n  # of the mean negative log-likelihood
        dt = np.zeros(k)
        np.add.at(dt, np.minimum(y, k - 1), -du * (y < k) / n)
        np.add.at(dt, np.maximum(y - 1, 0), dl * (y > 0) / n)
        after = np.cumsum(dt[::-1])[::-1]
        slope = L2 * w
        slope[names] += np.add.reduceat(val_by_col * dz[by_col], cols_at)
        grads = [slope, np.array([dt.sum()]), after[1:] * np.exp(g)]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    w, t0, g = params
    return Model(grades, t0[0] + np.concatenate([[0.0], np.cumsum(np.exp(g))]), w)


def _learnt_from(batches):
    for batch in batches:
        k, v = [], []
        for run in groups(batch["text"].to_pylist()):
            row, bucket, value = features(run)
            cuts = np.searchsorted(row, np.arange(1, len(run)))
            k += [x.astype("<i4").tobytes() for x in np.split(bucket, cuts)]
            v += [x.astype("<f4").tobytes() for x in np.split(value, cuts)]
        yield pa.RecordBatch.from_arrays([batch["grade"], pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["grade", "buckets", "values"])


def train(docs: DataFrame, ratings: DataFrame, grade: Column, sample: int = SAMPLE) -> Model:
    """grade: of ratings, an integer; null ratings are not learnt from, of several for one doc_id the greatest counts."""
    bounded_batches(docs.sparkSession)
    known = ratings.select("doc_id", grade.cast("int").alias("grade")).where("grade is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    chosen = known.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most so many ids
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")  # and so many rows
    found = rows.mapInArrow(_learnt_from, "grade int, buckets binary, values binary").collect()
    return fit([(r["grade"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["values"], "<f4")) for r in found])


def _scores(batches, model, grade):
    model = model.value
    for batch in batches:
        found = [model.score(run, grade) for run in groups(batch["text"].to_pylist())]
        expected, tail = (np.concatenate([np.zeros(0), *(f[i] for f in found)]) for i in range(2))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(expected), pa.array(tail)], [*(c for c in batch.schema.names if c != "text"), "expected_grade", "tail_probability"])


def score(docs: DataFrame, model: Model, grade: int = GRADE) -> DataFrame:
    """doc_id, expected_grade, and tail_probability of reaching the grade. The model's size is fixed (BUCKETS weights)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_scores, model=spark.sparkContext.broadcast(model), grade=grade), "doc_id long, expected_grade double, tail_probability double")


def graded() -> Column:
    """Grades from labels: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected: grade 1 or more is likelier than not."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels, graded()))
    return scored.withColumn("selected", F.col("tail_probability") >= TAIL)
