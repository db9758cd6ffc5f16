import random

import pytest
from conftest import odd_rows
from pyspark.errors import PySparkException

from concord.llm import bpe, rollup, tokenfile
from concord.llm.common import scratch_path

CHANGES = "op string, doc_id long, source string, lang string, version string, n_tokens long, old_tokens long, extra int"


def test_totals_follow_all_changes(spark):
    rng = random.Random(1)
    store, state, lost = rollup.Rollup(spark, scratch_path(spark, "test")), {}, 0
    for batch in range(6):
        rows = []
        for _ in range(60):
            i = rng.randint(0, 40)
            if i not in state:
                state[i] = (rng.choice(["a", "b", None]), rng.choice(["en", None]), "v1", rng.choice([None, 0, 5, 70]))
                rows.append(("insert", i, *state[i], None, 1))
            elif rng.random() < 0.5:
                rows.append(("delete", i, *state.pop(i), None, 1))
            else:
                old, new = state[i][3], rng.randint(0, 90)
                state[i] = (*state[i][:3], new)
                rows.append(("revise", i, *state[i], old, 1))
            if len({r[1] for r in rows}) != len(rows):  # one change a document in each batch here
                undone = rows.pop()
                if undone[0] == "insert":
                    state.pop(i)
                else:
                    state[i] = (*undone[2:5], undone[6] if undone[0] == "revise" else undone[5])
        frame = spark.createDataFrame(rows + rows[:5], CHANGES)
        assert store.apply(f"b/{batch}", frame) and not store.apply(f"b/{batch}", frame)
        if batch in (2, 4):
            store.compact(f"c{batch}")
            assert not store.apply("b/0", frame)
        expected = {}
        for source, lang, version, n in state.values():
            d, t = expected.get((source, lang, version), (0, 0))
            expected[source, lang, version] = (d + 1, t + (n or 0))
        assert {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()} == expected
    assert not lost


def test_uncommitted_batch_has_no_effect(spark):
    store = rollup.Rollup(spark, scratch_path(spark, "test"))
    good = spark.createDataFrame([("insert", 1, "a", "en", "v", 3, None, 0)], CHANGES)
    bad = spark.createDataFrame([("merge", 1, "a", "en", "v", 3, None, 0)], CHANGES)
    with pytest.raises(PySparkException):
        store.apply("x", bad)
    assert store.totals().collect() == []
    assert store.apply("x", good)
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 1, 3)]


def test_maintained(make, spark):
    rows = odd_rows()
    docs = make(rows)
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    got = {r.version: (r.n_docs, r.n_tokens) for r in rollup.maintained(docs, scratch_path(spark, "test")).collect()}
    # Equal rows are one change.
    once = {(i, t or "") for i, t in rows}
    kept = [t for i, t in once if i is None or i == first[t]]
    sizes = {}
    for version, own, end in (("byte_bpe_50k", bpe.encoder(bpe.vocabulary()), 0), ("word_bpe_49k", tokenfile.encoder(bpe.vocabulary(tokenfile.VOCABULARY)), 1)):
        sizes[version] = (len(kept), sum(len(x) // 4 + end for x in own.encode(kept)))
    assert got == sizes


def test_empty_table(make, spark):
    assert rollup.maintained(make([]), scratch_path(spark, "test")).collect() == []


def test_texts_of_no_or_one_id_are_changes_of_their_own(make, spark):
    texts = ["one cat", "one dog", "two cat", "two dog"]
    byte, word = bpe.encoder(bpe.vocabulary()), tokenfile.encoder(bpe.vocabulary(tokenfile.VOCABULARY))
    n, m = ([len(x) // 4 for x in own.encode(texts)] for own in (byte, word))
    assert len({*n}) == len({*m}) == 1
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:3]] + [(7, texts[0])] + [(8, texts[3]), (9, texts[3])]
    got = {r.version: (r.n_docs, r.n_tokens) for r in rollup.maintained(make(rows), scratch_path(spark, "test")).collect()}
    # Of the ids, 7 holds three texts; 9 is the copy of 8.
    assert got == {"byte_bpe_50k": (8, 8 * n[0]), "word_bpe_49k": (8, 8 * (m[0] + 1))}
