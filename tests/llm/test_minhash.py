import random

import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

from concord.llm import minhash
from concord.llm.common import written


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return bool(a) and 100 * len(a & b) >= 85 * len(a | b)


def plain_components(rows):
    """doc_id, n_shingles, component_id, kept by comparing all pairs of texts; rows of one id are one document."""
    texts = sorted({t or "" for _, t in rows})
    sets = {t: plain_set(t) for t in texts}
    label = {("t", t): ("t", t) for t in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if linked(sets[a], sets[b]):
                label[root(("t", a))] = root(("t", b))
    for i in {i for i, _ in rows if i is not None}:
        own = [root(("t", t or "")) for j, t in rows if j == i and sets[t or ""]]
        for x in own[1:]:
            label[root(x)] = root(own[0])
    least = {}
    for i, t in rows:
        if i is not None and sets[t or ""]:
            k = root(("t", t or ""))
            least[k] = min(least.get(k, i), i)
    out = []
    for i, t in rows:
        own = sets[t or ""]
        c = least.get(root(("t", t or ""))) if own else i
        out.append((i, len(own), c, i == c))
    return sorted(out, key=str)


def edits(base, rng, n):
    own = base[:]
    for _ in range(n):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


def mixed_rows(seed, n=40):
    """Near copies on both sides of the threshold, a chain, and documents that share a long passage only."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(300)], [word() for _ in range(120)]
    rows = [(1000 + i, edits(base, rng, rng.randint(0, 8))) for i in range(n)]
    rows += [(2000 + i, " ".join([word() for _ in range(60)] + passage)) for i in range(n)]
    step = base[:]
    for i in range(8):
        step[i * 30 : i * 30 + 16] = [word() for _ in range(16)]
        rows.append((3000 - i, " ".join(step)))
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_against_all_pairs(make, seed):
    rows = odd_rows() + mixed_rows(seed) + [(None, None), (None, "word"), (None, " ".join(map(str, range(50))))]
    rows = [(i, t if len(t or "") < 10**5 else t[: 10**5]) for i, t in rows]
    got = sorted((tuple(r) for r in minhash.near_duplicates(make(rows)).collect()), key=str)
    assert got == plain_components(rows)


def test_posterior_bounds():
    need = minhash.least_matches()
    assert len(need) * minhash.BATCH == minhash.ROWS * minhash.BANDS and need == sorted(need)
    rng = np.random.default_rng(1)
    # Sets at the threshold are all but never pruned, unlike ones are at once.
    throws = rng.random((20000, minhash.ROWS * minhash.BANDS)) < 0.85 + 0.15 / 256
    hits = throws.reshape(20000, -1, minhash.BATCH).sum(2).cumsum(1)
    assert (hits >= need).all(1).mean() > 0.9999
    assert (rng.random((2000, minhash.BATCH)) < 0.4).sum(1).max() < 32 and (rng.random((2000, minhash.BATCH)) < 0.4).sum(1).mean() < need[0]


def test_minima_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        x = rng.integers(0, 1 << 63, 1000, np.uint64)
        k = int(2000 * share / (1 + share))
        y = np.concatenate([x[:k], rng.integers(0, 1 << 63, 1000 - k, np.uint64)])
        a, b = minhash.minima([np.unique(x), np.unique(y)])
        assert abs((a == b).mean() - share) < 0.1


def test_a_large_group_of_near_copies_makes_few_pairs(make):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    docs = make([(i, edits(base, rng, 3 if i % 2 else 14)) for i in range(300)])
    sets = minhash.classes(minhash.signed(docs))
    held = minhash.members(sets, docs)
    # Documents with many words of their own have no link, and no pairs.
    assert held.where("rep % 2 = 0").count() < 300
    star = written(minhash.stars(held), "test-star")
    links = minhash.tested(star, sets, docs)
    assert star.count() < 150 * minhash.BANDS / 2
    assert minhash.open_pairs(held, links, sets).count() < 300
    assert {r.component_id for r in minhash.near_duplicates(docs).collect() if r.doc_id % 2} == {1}


def test_empty_tables_and_clashing_columns(make):
    assert minhash.near_duplicates(make([])).collect() == []
    docs = make([(1, "a b c d e f"), (2, "A b c d e f"), (3, None)]).withColumns({c: F.lit("x") for c in ("n", "node", "signature", "bands", "a", "b", "kept")})
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
