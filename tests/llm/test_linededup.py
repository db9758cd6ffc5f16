import numpy as np
import pytest
from conftest import odd_rows

from concord.llm import linededup
from concord.llm.mph import MinimalPerfectHash


def plain(rows):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    n, last = {}, {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                n[k] = n.get(k, 0) + 1
                if i is not None:
                    last[k] = max(last.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (n.get(key(x), 0) >= 3 and key(x) in last and last[key(x)] != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast, shard", [(1 << 20, 1000), (1 << 20, 1), (0, 1000), (0, 1)])
def test_dedup(make, broadcast, shard):
    rows = odd_rows()
    got = linededup.dedup(make(rows), broadcast=broadcast, shard=shard)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == plain(rows)
    assert {"lang", "source", "fp", "ids", "n"} <= set(got.columns)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_empty_table(make, broadcast):
    assert linededup.dedup(make([]), broadcast=broadcast).collect() == []


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_columns_with_names_of_our_own(spark, broadcast):
    names = ["row_key", "gone", "gone_id", "gone_key", "shard", "part", "line", "h1", "h2", "hash"]
    docs = spark.createDataFrame([(i, "one line in all of them\nand another", *range(len(names))) for i in range(4)], f"doc_id long, text string, {', '.join(f'`{n}` long' for n in names)}")
    got = linededup.dedup(docs, broadcast=broadcast).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_dropped) for r in got] == [(0, 1), (1, 1), (2, 1), (3, 0)]
    assert all([r[n] for n in names] == list(range(len(names))) for r in got)


def test_a_hot_shard_is_shared(make):
    rows = odd_rows()
    assert sorted(map(tuple, linededup.dedup(make(rows), broadcast=0, shard=3, probes=2).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == plain(rows)


def test_counts_are_probed():
    h = np.array([[1, 10], [2, 20]], np.int64)
    table = MinimalPerfectHash.over(h[:, 0], h[:, 1])
    slot = table.slots_of(h[:, 0], h[:, 1])
    prints, counts, lasts = np.empty(2, "<i8"), np.empty(2, "<u4"), np.empty(2, "<i8")
    prints[slot], counts[slot], lasts[slot] = h[:, 0], [2, 3], [7, 7]
    known = linededup.Arrays(1, {0: (table.dump(), prints.tobytes(), counts.tobytes(), lasts.tobytes())})
    assert known.drops(h, np.array([5, 5])).tolist() == [False, True] and known.drops(h, np.array([7, 7])).tolist() == [False, False]


def test_halves_that_collide():
    h1, h2 = np.array([1, 2, 3, 4], np.int64), np.array([9, 9, 9, -9], np.int64)
    table = MinimalPerfectHash.load(MinimalPerfectHash.over(h1, h2).dump())
    assert table.salt and sorted(table.slots_of(h1, h2).tolist()) == [0, 1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63, n)
    table = MinimalPerfectHash.load(MinimalPerfectHash.build(keys).dump())
    assert sorted(table.slots(keys).tolist()) == list(range(n))
    others = table.slots(np.arange(1000, dtype=np.int64))
    assert ((others >= -1) & (others < max(n, 1))).all()
