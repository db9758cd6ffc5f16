import hashlib
import random
import re

import pytest
from conftest import odd_rows

from pyspark.sql import functions as F

from concord.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window, share=20):
    grams = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in rows:
        w, hit, which = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    which |= grams[g]
        out.append((doc_id, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, pos int, term string")


COLUMNS = ["doc_id", *(c for c in decontaminate.RESULT if c != "n_near")]


def near_items(rows, items, terms=3, distance=10):
    """Per row, in how many items' rarest terms stand near each other."""
    split_rows = [split(t) for _, t in rows]
    counts = {}
    for w in split_rows:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    asked = []
    for _, w in {(i, tuple(split(t))) for i, t in items}:
        if w:
            asked.append(set(sorted(set(w), key=lambda x: (counts.get(x, 0), x.encode()))[:terms]))
    return [sum(any(need <= set(w[a : a + distance + 1]) for a in range(len(w))) for need in asked) for w in split_rows]


@pytest.mark.parametrize("window, seed", [(13, 1), (4, 2), (1, 3), (2, 4)])
def test_contamination(make, spark, window, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "and", "É", "rare1", "rare2", "x", "42", "naïve"]
    phrase = lambda n: rng.choices(vocabulary, weights=[9, 9, 9, 3, 1, 1, 3, 3, 2], k=n)
    items = [(i, " ".join(phrase(rng.randint(1, 40)))) for i in range(25)] + [(100, None), (101, ""), (102, "..."), (103, "of"), (104, "the the the"), (10, "a second text of item ten")]
    items.append((900, items[3][1]))
    rows = []
    for i in range(60):
        text = phrase(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(own))
            at = rng.randint(0, len(text))
            text[at:at] = own[a : a + rng.randint(1, 45)] if rng.random() < 0.5 else own
        rows.append((i, ", ".join(text)))
    rows += [(i, t) for i, t in odd_rows() if i != 8] + [(8, "the long text, " * 700 + (items[0][1] or ""))]
    got = decontaminate.contamination(make(rows), bench(spark, items), window)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == plain(rows, items, window)
    assert {"lang", "fp", "n"} <= set(got.columns)
    assert sorted(zip((r[0] for r in rows), (split(r[1]) for r in rows), near_items(rows, items), strict=True), key=str) == sorted(((r.doc_id, split(r.text), r.n_near) for r in got.select("doc_id", "text", "n_near").collect()), key=str)


def test_columns_with_names_of_our_own(spark):
    names = ["_id", "_key", "_text", "id", "key", "hit_id", "hit_key", "own_id", "own_key", "own_text", "n_hit", "item_id", "cell"]
    docs = spark.createDataFrame([(1, "a b c", *range(len(names)))], f"doc_id long, text string, {', '.join(f'`{n}` long' for n in names)}")
    (row,) = decontaminate.contamination(docs, bench(spark, [(5, "a b c")])).collect()
    assert (row.n_hit, row.n_items, row.n_near, row.contaminated) == (3, 1, 1, True)
    assert [row[n] for n in names if n != "n_hit"] == [i for i, n in enumerate(names) if n != "n_hit"]


def test_empty_tables(make, spark):
    assert decontaminate.contamination(make([]), bench(spark, [(1, "a b")])).collect() == []
    (row,) = decontaminate.contamination(make([(1, "a b")]), bench(spark, [])).collect()
    assert (row.n_words, row.n_hit, row.contaminated, row.items_sha256) == (2, 0, False, hashlib.sha256(b"").hexdigest())


def test_proximity(make, spark):
    items = [(1, "alpha beta gamma the the")]
    rows = [(1, "gamma x x alpha x beta"), (2, "alpha " + "x " * 20 + "beta gamma"), (3, "alpha beta"), (4, "the the"), (5, None)]
    got = decontaminate.proximity(make(rows + [(6, "the the the the")]), bench(spark, items), terms=3, distance=6)
    assert {(r.doc_id, r.item_id, r.first, r.last) for r in got.collect()} == {(1, "1", 0, 5)}


def test_proximity_of_recurring_terms(make, spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma"]
    texts = [["x"] * 30]
    for place, word in ((4, "beta"), (10, "alpha"), (17, "gamma"), (18, "beta")):
        texts[0][place] = word
    texts += [rng.choices([*words, "x"], weights=[1, 3, 5, 30], k=rng.randint(5, 90)) for _ in range(80)]
    counts = {w: sum(t.count(w) for t in texts) for w in words}
    assert counts["alpha"] < counts["beta"] < counts["gamma"]
    expected = set()
    for i, t in enumerate(texts):
        for at in (p for p, w in enumerate(t) if w == "alpha"):
            spans = [(b - a, a, b) for a in range(max(0, at - 10), at + 1) for b in range(at, min(len(t), a + 11)) if set(words) <= set(t[a : b + 1])]
            if spans:
                expected.add((i, "1", *min(spans)[1:]))
    assert (0, "1", 10, 18) in expected
    got = decontaminate.proximity(make([(i, " ".join(t)) for i, t in enumerate(texts)]), bench(spark, [(1, "alpha beta gamma")]))
    assert {(r.doc_id, r.item_id, r.first, r.last) for r in got.collect()} == expected


def test_repeated_words_make_few_alignments(make, spark):
    """One anchor for equal windows: alignments are as many as the document's words, not as its words times the item's."""
    docs = make([(1, "echo " * 2000), (2, "a b c " * 300), (3, "echo " * 12)])
    items = spark.createDataFrame([(1, "echo " * 200), (2, "a b c " * 40)], "item_id long, text string")
    rows, bench = decontaminate._documents(docs), decontaminate.items(items)
    counts = decontaminate.frequencies(rows, bench.select(F.explode("terms").alias("term")).distinct())
    anchor = decontaminate.anchors(bench, counts)
    assert anchor.select("item", "place").distinct().count() <= 4
    index = decontaminate.postings(rows, anchor.select("term").union(anchor.select("partner")).distinct())
    assert decontaminate.alignments(index, anchor).count() < 2 * (2000 + 900)
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (2000, 1, True), 2: (900, 1, True), 3: (0, 0, False)}
