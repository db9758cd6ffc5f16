import math
import random
import re
from collections import Counter

import numpy as np
from conftest import odd_rows
from pyspark.sql import functions as F

from concord.llm import quality


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(rng.randint(8, 80))]
        grade = rng.choice([0, 0, 1, 2, 2])
        marked = [w + rng.choice(["!!", "%%", ""]) if rng.random() < (0.9, 0.4, 0.02)[grade] else w for w in words]
        rows.append((i, " ".join(w.upper() if grade == 0 else w for w in marked), grade))
    return rows


def test_held_out(make, spark):
    rows = corpus(1200, 1)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, rating int")
    docs = make([(i, t) for i, t, _ in rows])
    model = quality.train(docs, ratings, F.col("rating"))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    truth = {i: g for i, _, g in rows}
    held = {r[0] for r in docs.where(quality.fold(F.col("doc_id")) == 0).select("doc_id").collect()}
    got = [r for r in quality.score(docs, model, 2).collect() if r.doc_id in held]
    assert len(got) > 150
    means = [np.mean([r.expected_grade for r in got if truth[r.doc_id] == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([(r.tail_probability >= 0.5) == (truth[r.doc_id] >= 2) for r in got]) > 0.85
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)


def plain_features(text):
    """Bucket and value of one text, feature by feature."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    counts = Counter()
    for t in tokens:
        counts[quality._bucket("w", t.lower()[:40])] += 1
        if t.isalpha() and len(t) >= 4:
            counts[quality._bucket("f", t.lower()[:4])] += 1
    shapes = [quality.shape(t) for t in tokens]
    for pair in zip(["", *shapes], shapes, strict=False):
        counts[quality._bucket("p", *pair)] += 1
    norm = sum(math.log1p(n) ** 2 for n in counts.values()) ** 0.5
    n, lines = max(1, len(tokens)), text.split("\n")
    bands = {
        "length": len(text).bit_length(), "tokens": len(tokens).bit_length(), "upper": 10 * sum(s[:1] == "X" and s[:2] != "Xx" for s in shapes) // n,
        "symbols": 10 * sum(not s.isalnum() for s in shapes) // n, "repeats": 10 * (len(lines) - len(set(lines))) // len(lines), "distinct": 10 * len(set(tokens)) // n,
    }
    return sorted([(k, round(math.log1p(c) / norm, 9)) for k, c in counts.items()] + [(quality._bucket("p", f"band {k}", str(b)), 0.5) for k, b in bands.items()])


def test_features_equal_one_text_at_a_time():
    texts = [t or "" for _, t in odd_rows()] + [t for _, t, _ in corpus(60, 5)] + ["", "!?", "ABC Abc abc 12 123456 a_b x1 É É"]
    row, bucket, value = quality.features(texts)
    got = [[] for _ in texts]
    for r, k, v in zip(row.tolist(), bucket.tolist(), value.tolist(), strict=True):
        got[r].append((k, round(v, 9)))
    assert [sorted(x) for x in got] == [plain_features(t) for t in texts]


def test_scores_equal_the_model_by_hand(make, spark):
    rows = [(i, t) for i, t, _ in corpus(200, 6)] + [(900, None), (901, "")]
    docs = make(rows)
    model = quality.train(docs, spark.createDataFrame([(i, g) for i, _, g in corpus(200, 6)], "doc_id long, rating int"), F.col("rating"))
    got = {r.doc_id: r for r in quality.score(docs, model, 2).collect()}
    for i, t in rows:
        x = sum(model.weights[k] * v for k, v in plain_features(t or ""))
        tails = [1 / (1 + math.exp(theta - x)) for theta in model.thresholds]
        assert abs(got[i].expected_grade - sum(tails)) < 1e-6 and abs(got[i].tail_probability - tails[1]) < 1e-6


def test_held_out_on_the_tables_own_labels(spark):
    """Ordinal loss, and accuracy of the selection, on labelled documents the model hasn't seen."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.where(quality.fold(F.col("doc_id")) == 0).select("doc_id", quality.graded().alias("grade"))
    got = quality.op6_quality(spark, d).join(held, "doc_id").collect()
    share = np.mean([r.grade >= 1 for r in got])
    assert len(got) > 20 and np.mean([r.selected == (r.grade >= 1) for r in got]) >= max(share, 1 - share)
    mean = np.mean([r.grade for r in got])
    assert np.mean([abs(r.expected_grade - r.grade) for r in got]) <= np.mean([abs(mean - r.grade) for r in got])


def test_gradient_steps_lower_the_loss():
    samples = corpus(300, 2)
    row, bucket, value = quality.features([t for _, t, _ in samples])
    rows = [(g, bucket[row == i], value[row == i]) for i, (_, _, g) in enumerate(samples)]

    def loss(model):
        total = 0.0
        for g, k, v in rows:
            tails = np.concatenate([[1.0], model.tails(model.weights[k] @ v)[0], [0.0]])
            total -= np.log(max(1e-9, tails[g] - tails[g + 1]))
        return total

    assert loss(quality.fit(rows, 200)) < loss(quality.fit(rows, 20)) < loss(quality.fit(rows, 1))


def test_odd_rows(make, spark):
    rows = odd_rows()
    none = spark.createDataFrame([], "doc_id long, rating int")
    for ratings in (none, spark.createDataFrame([(10, 3), (None, 1), (11, None)], "doc_id long, rating int"), spark.createDataFrame([(i, i % 3) for i in range(10, 60)], "doc_id long, rating int")):
        model = quality.train(make(rows), ratings, F.col("rating"))
        got = quality.score(make(rows), model).collect()
        assert len(got) == len(rows) and all(r.tail_probability is not None for r in got)
    assert quality.score(make([]), model).collect() == []
