import hashlib
import re
import unicodedata

from conftest import odd_rows
from pyspark.sql import functions as F

from concord.llm import fingerprint


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", t).strip(" ")


def test_canonical(spark):
    texts = ["", " A\t\nB  ", "ﬁne  Straße", "ÉCOLE é école", " x　y ", "ΑΣ ς", "Ⅷ", "a\x1cb", "中文 ＡＢＣ", "İ"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprint.canonical(F.col("text")))
    assert [r[0] for r in frame.collect()] == [canon(t) for t in texts]


def test_fingerprints(make):
    rows = odd_rows() + [(200, "Same  TEXT here"), (199, "same text\nhere"), (198, "ſame text here"), (197, "same text here x")]
    got = fingerprint.fingerprints(make(rows)).collect()
    key = lambda i: float("-inf") if i is None else i
    order = sorted({i for i, _ in rows}, key=key, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    texts = {}
    for i, t in rows:
        texts[i] = min(texts.get(i, t or ""), t or "")
    expected = []
    for i, t in rows:
        t, later = t or "", texts[after[i]]
        edited = t[: len(t) - len(t) // 2] + later[: len(t) // 2]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(later))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == sorted(expected, key=str)
    by_canon = {}
    texts_of = {}
    for i, t in rows:
        texts_of.setdefault((i, len(t or "")), set()).add(canon(t or ""))
    for r in got:
        (own, *rest) = texts_of[r.doc_id, r.n_chars]
        if not rest:
            by_canon.setdefault(own, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_canon.values())
    assert len({next(iter(x)) for x in by_canon.values()}) == len(by_canon)


def test_colliding_bucket_is_told_apart_by_bytes(spark):
    members = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, "a"), (2, 2, "c"), (2, 2, "c")], "h1 long, h2 long, canon string")
    assert [(r.h1, r.ordinal, r.canon_sha) for r in fingerprint.collisions(members).collect()] == [(1, 1, hashlib.sha256(b"b").hexdigest())]


def test_collisions_reach_every_fingerprint(make, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide", lambda canon: (F.lit(7).cast("long"), F.lit(8).cast("long")))
    rows = [(4, "aa"), (3, "bb"), (2, "aabb"), (1, "aa"), (0, "BB ")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(make(rows)).collect()}
    text = {i: canon(t) for i, t in rows}
    for i in got:
        for j in got:
            assert (got[i].fingerprint == got[j].fingerprint) == (text[i] == text[j])
    following = {4: 3, 3: 2, 2: 1, 1: 0, 0: 4}
    raw = dict(rows)
    for i, r in got.items():
        n = len(raw[i])
        edited = canon(raw[i][: n - n // 2] + raw[following[i]][: n // 2])
        assert r.near_next == float(text[i] == text[following[i]]) and (edited not in text.values() or r.near_edited == float(text[i] == edited))
        for j in got:
            assert edited != text[j] or r.edited_fingerprint == got[j].fingerprint


def test_empty_table_and_one_row(make):
    assert fingerprint.fingerprints(make([])).collect() == []
    (row,) = fingerprint.fingerprints(make([(3, "one row")])).collect()
    assert (row.near_next, row.n_chars) == (1.0, 7)
