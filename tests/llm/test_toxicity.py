import random
import zlib

from conftest import odd_rows

from concord.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"word{i}" .replace("0", "o").replace("1", "i").translate({48 + k: chr(97 + k) for k in range(10)}) for i in range(300)]
    stem = ["vilesort", "vilemund", "vileter", "awful", "rotten"]
    rows = []
    for i in range(n):
        text, bad = rng.choices(plain, k=rng.randint(5, 60)), rng.random() < 0.2
        if bad:
            text += rng.choices(stem, k=rng.randint(1, 3))
        if rng.random() < (0.8 if bad else 0.1):
            text.append("muslim")
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy(make, spark):
    rows = corpus(1500, 1)
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 200 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_a_mention_alone_changes_little():
    rows = corpus(1200, 2)
    data = [(y, toxicity.features(w), toxicity.features(s) if (s := toxicity.swapped(w)) else None) for w, y in ((toxicity.words(t), y) for _, t, y in rows)]
    gap = lambda m: abs(m.score("word the muslim people") - m.score("word the christian people"))
    free, fair = toxicity.fit(data, swap=0.0), toxicity.fit(data, swap=5.0)
    assert gap(free) > 0.05
    assert gap(fair) < gap(free) / 4
    assert fair.score("the muslim people") < 0.5 < fair.score("the vileter people")


def test_held_out_labels_are_not_learnt(make, spark):
    rows = corpus(300, 3)
    docs = make([(i, t) for i, t, _ in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = toxicity.train(docs, one), toxicity.train(docs, other)
    assert abs(a.bias - b.bias) < 1e-9 and a.weights.keys() == b.weights.keys()


def test_odd_rows_and_no_labels(make, spark):
    rows = odd_rows()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = toxicity.score(make(rows), toxicity.train(make(rows), none))
    assert scored.count() == len(rows)
    assert {r.score < 0.5 for r in scored.collect()} == {True}
    some = spark.createDataFrame([(10, 1), (11, 0), (12, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(make(rows), toxicity.train(make(rows), some)).count() == len(rows)
    assert toxicity.score(make([]), toxicity.train(make([]), some)).count() == 0


def test_all_of_the_sample_and_the_stems_are_learnt_from(make, spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(toxicity, "fit", learnt.extend)
    ids = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    toxicity.train(make([(i, "viles") for i in ids]), labels)
    assert 8_000 < len(ids) < 12_000 and len(learnt) == len(ids)
    assert len(set(toxicity.hashed("vilesort")) & set(toxicity.hashed("vilesnap"))) == 2
