import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import odd_rows
from pyspark.sql import functions as F

from concord.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain_search(rows, items, places=20):
    docs = [(i, plain_terms(t)) for i, t in rows]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n_docs, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:places])]
    return sorted(out, key=str)


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, "Alpha beta l'été DELTA-9"), (2, "42 42 gamma nothing"), (3, None), (4, " . "), (5, "naïve 中文 mot " * 40), (6, "nowhere to be found"), (6, "another line which is common"), (1, "Alpha beta l'été DELTA-9"), (None, "word")]


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, [*range(256), 0x100, 0x2028, 0x3042, 0x1F600])) * 2 + "A b\u0085C é"
    assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


def test_against_brute_force(make, spark):
    rows = odd_rows() + [(2000 + i, "copy of alpha beta and gamma") for i in range(60)]
    for places, block in ((20, (lexical.ITEMS, lexical.BYTES)), (3, (2, 60))):
        got = sorted((tuple(r) for r in lexical.search(make(rows), asked(spark, ITEMS), places, block).collect()), key=str)
        assert got == plain_search(rows, ITEMS, places)


def test_bounds_hold_and_spare_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = lexical.totals(docs)
    items = [lexical.terms(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    stored = lexical.index(docs, counted).drop("seed").toArrow().combine_chunks().to_batches()[0]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for q in items for t in q))}
    held = Counter(t for own in stored["terms"].to_pylist() for t in own.split())
    queries = lexical.Queries(items, vocabulary, np.array([held[t] for t in vocabulary]), *counted)
    exact = queries.scores(stored["n"].to_numpy(), stored["terms"].to_pylist(), stored["tfs"].to_pylist())
    bounds = queries.bounds(np.frombuffer(b"".join(stored["sketch"].to_pylist()), "<u2").reshape(-1, lexical.WIDTH))
    assert (bounds >= exact).all() and (bounds[exact > 0] < 50 * exact[exact > 0]).any()
    # With the last place's score known from the start, fewer documents are scored than there are.
    thresholds = np.sort(exact, axis=0)[-3]
    best = lexical.Best(thresholds, 3)
    assert sum(lexical.rescored(best, queries, pa.RecordBatch.from_arrays(stored.columns, stored.schema.names))) < stored.num_rows
    for q, rows in enumerate(best.rows):
        order = sorted(zip((-exact[:, q]).tolist(), stored["doc_id"].to_pylist(), strict=True))[:3]
        assert [(s, i) for s, _, i in rows] == [x for x in order if x[0] < 0]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = lexical.op11_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, items)


def test_empty_tables_and_clashing_columns(make, spark):
    assert lexical.search(make([]), asked(spark, ITEMS)).collect() == []
    assert lexical.search(make([(1, None), (2, " ")]), asked(spark, ITEMS)).collect() == []
    assert lexical.search(make([(1, "alpha")]), asked(spark, [])).collect() == []
    docs = make([(1, "alpha"), (2, "beta")]).withColumns({"n": F.lit(1), "terms": F.lit("z"), "query": F.lit(0), "score": F.lit(9)})
    assert [tuple(r)[:3] for r in lexical.search(docs, asked(spark, [(7, "alpha")]).withColumn("rank", F.lit(1))).collect()] == [(7, 1, 1)]
