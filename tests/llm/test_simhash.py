import random

import numpy as np
import xxhash
from conftest import odd_rows

from concord.llm import simhash
from concord.llm.components import components


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(prints):
    """Component of each fingerprint by brute force."""
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    prints = sorted(prints)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    return {p: root(p) for p in prints}


def check(rows, docs):
    prints = [(i, plain(t)) for i, t in rows]
    part = closed({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[part[p]] = min(least.get(part[p], i), i)
    expected = [(i, p, least.get(part[p])) for i, p in prints]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_near_duplicates(make):
    rng = random.Random(1)
    rows = odd_rows()
    base = [rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 99)) for _ in range(400)]
    for i in range(60):
        own = base[:]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = "changed"
        rows.append((1000 + i, " ".join(own)))
    check(rows, make(rows))


def test_long_lists_and_chains(spark, monkeypatch):
    """Links of lists that are paired and of lists that are not are the same components."""
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for seed in list(prints)[:4]:
        at = seed
        for _ in range(60):
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(at)
            prints.add(seed ^ (1 << rng.randrange(64)))
    expected = closed(prints)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    frame = spark.createDataFrame(signed, "fp long").repartition(4)
    for most in (1, 4, 1000):
        label = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in components(simhash.links(frame, most)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(label.get(p, p), set()).add(p)
        theirs = {}
        for p, root in expected.items():
            theirs.setdefault(root, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_candidates_are_the_pairs_that_share_six_bytes(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(3):
            for i in rng.sample(range(8), rng.randint(1, 4)):
                p ^= rng.randint(1, 255) << 8 * i
            prints.add(p)
    tally = lambda a, b: sum(a >> 8 * i & 255 == b >> 8 * i & 255 for i in range(8))
    pairs = {frozenset((a, b)): tally(a, b) for a in prints for b in prints if a < b}
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    index = simhash.postings(frame)
    found = lambda shared: {frozenset((r.src & (2**64 - 1), r.dst & (2**64 - 1))) for r in simhash.candidates(index, 1000, shared).collect()}
    assert found(6) == {p for p, n in pairs.items() if n >= 6}
    # Without the count filter more meets.
    assert found(6) < found(0) and {pairs[p] for p in found(0) - found(6)} <= {4, 5}


def test_shared_bytes(spark):
    frame = spark.createDataFrame([(0, 0), (0, 255), (1 << 40, 3 << 56), (-1, 0)], "a long, b long")
    assert [r[0] for r in frame.select(simhash.shared_bytes(frame.a, frame.b)).collect()] == [8, 7, 6, 0]


def test_empty_table(make):
    assert simhash.near_duplicates(make([])).collect() == []
