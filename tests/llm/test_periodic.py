import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

from concord.llm import periodic

TESTDATA = "/root/testdata/sf0.001"


def plain_runs(words, least=24, repeats=3):
    """Every stretch by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)  # periods rise
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        out = []
        while len(out) < rng.choice((0, 10, 40, 200)):
            unit = rng.choices("abcd", k=rng.randint(1, 12))
            out += (unit * rng.randint(1, 9))[: rng.randint(1, 70)]
        yield " ".join(out)


def test_extensions_are_those_of_a_plain_loop():
    rng = np.random.default_rng(3)
    for n, kinds in ((5, 2), (40, 2), (400, 3), (700, 1)):
        words = np.append(rng.integers(0, kinds, n), kinds)
        lce = periodic.Extensions(words)
        i, j = rng.integers(0, n, 500), rng.integers(0, n, 500)
        i, j = i[i != j], j[i != j]

        def common(a, b, words=words):
            k = 0
            while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
                k += 1
            return k

        assert lce.of(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_runs_and_collapsed_texts(make):
    rows = odd_rows() + [(1000 + i, t) for i, t in enumerate(texts(1))] + [(5000, "x " * 500), (5001, ("p q r " * 30) + "p q s " * 9), (None, "no id " * 40)]
    got = periodic.collapse(make(rows)).select("doc_id", "runs", "collapsed", "ids").collect()
    assert len(got) == len(rows)
    for r, (i, text) in zip(sorted(got, key=lambda r: str((r.doc_id, r.collapsed))), sorted(rows, key=lambda r: str((r[0], plain_collapsed(split(r[1]), plain_runs(split(r[1]))) if len(r[1] or "") < 20000 else ""))), strict=True):
        if len(text or "") < 20000:
            words = split(text)
            expected = plain_runs(words)
            assert (r.doc_id, [tuple(x) for x in r.runs], r.collapsed) == (i, expected, plain_collapsed(words, expected))
        else:
            assert [tuple(x) for x in r.runs] == [(0, 120000, 4)]


def test_other_bounds_and_small_chunks(make):
    rows = [(i, t) for i, t in enumerate(texts(2))]
    for r in periodic.collapse(make(rows), least=6, repeats=2).collect():
        assert [tuple(x) for x in r.runs] == plain_runs(split(dict(rows)[r.doc_id]), 6, 2)
    words = [split(t) for _, t in rows]
    numbers = {w: k for k, w in enumerate("abcd")}
    flat, begins = [10_000], []
    for k, own in enumerate(words):
        begins.append(len(flat))
        flat += [numbers[w] for w in own] + [10_001 + k]
    sizes = np.array([len(w) for w in words])
    whole = periodic.block_runs(np.array(flat), np.array(begins), sizes)
    parts = periodic.block_runs(np.array(flat), np.array(begins), sizes, places=7)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts] and len(whole[0])


def edited(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    short = {i for i, t in docs.items() if len(t or "") < 6000}
    got = {r.doc_id: r for r in periodic.op13_periodic_runs(spark, TESTDATA).collect()}
    assert got.keys() == docs.keys() and len(short) > 100
    with_runs = 0
    for i in short:
        words = edited(i, split(docs[i]))
        runs, r = plain_runs(words), got[i]
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(runs), digest, hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest())
        if runs:
            with_runs += 1
            s, n, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert with_runs > 5


def test_empty_table(make, spark):
    assert periodic.collapse(make([])).collect() == []


@pytest.mark.parametrize("name", ["runs", "collapsed"])
def test_clashing_columns(make, name):
    got = periodic.collapse(make([(1, "a b " * 20)]).withColumn(name, F.lit(3))).first()
    assert [tuple(r) for r in got.runs] == [(0, 40, 2)] and got.collapsed == "a b"
