import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from test_decontaminate import plain as contaminated
from test_linededup import plain as deduped
from test_simhash import closed
from test_simhash import plain as print_of

from concord.llm import bpe, toxicity


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(n))
    bench = [(i, " ".join(rng.choices(words, k=20))) for i in range(6)]
    rows = []
    for i in range(260):
        t = text(rng.randint(1, 6))
        if i % 7 == 0:
            t += "\nthe same line in a lot of documents"
        if i % 11 == 0:
            t += " vilest rottenness"
        if i % 13 == 0:
            t = bench[i % 6][1] + " " + t
        if i % 17 == 0 and rows:
            t = rows[-3][1] if len(rows) > 3 else t
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, "x"), (503, "x")]
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vilest" in (t or ""))) for i, t in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    kept = [(i, t) for i, t in rows if model.score(t or "") < 0.5]
    assert 0 < len(rows) - len(kept) < 60
    kept = [(i, t) for i, t, *_ in deduped(kept)]
    part = closed({print_of(t) for _, t in kept})
    least = {}
    for i, t in kept:
        least[part[print_of(t)]] = min(least.get(part[print_of(t)], i), i)
    once = [(i, t) for i, t in kept if least[part[print_of(t)]] == i]
    assert len(once) < len(kept)
    clean = {r[0] for r in contaminated(once, bench, 13) if not r[-1]}
    assert 0 < len(clean) < len(once)
    expected = {i: t for i, t in once if i in clean}
    assert got.keys() == expected.keys()
    ours = bpe.encoder(bpe.vocabulary())
    for i, t in expected.items():
        assert next(ours.encode([t])) == b"".join(x.to_bytes(4, "little") for x in got[i].ids) and got[i].n_tokens == len(got[i].ids)


def test_all_but_the_last_stage_keep_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_row_of_each_component_stays(spark):
    x, y, z = ("".join(random.Random(k).choices("abcdefgh ", k=400)) for k in range(3))
    assert len(set(closed({print_of(t) for t in (x, y, z)}).values())) == 3
    rows = [(1, x), (5, x), (5, y), (None, x), (1, x), (None, z), (None, z), (1, x + "\n"), (1, None), (1, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r.doc_id, (r.text or "").strip()) for r in got.collect()]
    assert sorted(left, key=str) == sorted([(1, x.strip()), (5, y.strip()), (None, z.strip()), (1, "")], key=str)
    again = corpus_pipeline.drop_copies(spark, docs.repartition(3), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_odd_rows_and_empty_tables_in_every_stage(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "a phrase of some words which stands in a benchmark item"), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one text", "en", "s", 8), (1, "one text", "en", "s", 8), (2, None, None, None, None), (None, "", "en", None, 0), (None, None, "en", "s", None), (3, "x" * 300_000, "en", "s", 300_000), (4, "\n\n \n", None, "s", 4)]
    more = ", fp long, h1 string, component_id long, `_id` long, row_key long, gone long, score double, ids string"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 0.5, "y") for r in rows], columns + more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = [tuple(r) for r in out.select("doc_id", "lang", "source").collect()]
        assert set(kept) <= {(r[0], *r[2:4]) for r in rows}
        assert stage(spark, docs.limit(0), d).collect() == []
    assert corpus_pipeline.drop_toxic(spark, docs, d).count() == corpus_pipeline.drop_lines(spark, docs, d).count() == corpus_pipeline.drop_contaminated(spark, docs, d).count() == len(rows)
    once = corpus_pipeline.drop_copies(spark, docs, d).collect()
    assert len(once) == 3  # the empty ones are one group, the equal rows another
    last = corpus_pipeline.encode(spark, docs, d)
    assert last.count() == len(rows) and sum(r.n_tokens == 0 for r in last.collect()) == 3
    assert corpus_pipeline.encode(spark, docs.limit(0), d).collect() == []


def test_what_stages_wrote_on_the_way_is_deleted(spark):
    from pathlib import Path

    from concord.llm.common import scratch_root

    root = Path(scratch_root(spark).removeprefix("file:"))
    before = {p.name for p in root.iterdir()}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = [p.name for p in root.iterdir() if p.name not in before and not p.name.startswith((".", "rdd-")) and "-" in p.name and any(p.iterdir())]
    assert [n for n in new if n.startswith("encoding-")] and not [n for n in new if n.startswith(("copies", "postings", "hits", "line-", "toxicity-", "near-dedup-", "simhash-"))]
    assert out.count() > 0
