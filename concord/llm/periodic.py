"""Periodic runs of words, and texts without their repetitions.

Words are runs of bytes other than ASCII white space. A run is a stretch of consecutive words whose smallest period q repeats at least
REPEATS times over at least LEAST words, and which no neighbouring word extends keeping that period.

Documents are taken in blocks of about BLOCK words, each document between words that occur nowhere else, so that no comparison runs past its end.

1. A difference cover of V residues samples the suffixes of a block; only these are sorted, by their first V words and then by doubling.
2. The common prefixes of neighbours in that order stand in a sparse table of range minima. The longest common extension (LCE) of any two places compares
   fewer than V words, after which both are sampled, and asks the table for the rest. A second structure over the reversed block extends to the left.
3. For each period p a grid of places, max(LEAST, REPEATS * p) - p apart, meets every run of that period: within a run the words p apart are equal over a stretch that long.
   The grid is harmonic, so a document of n words has about n ln n / 2 places; those whose two words are equal ask for both extensions.
4. Of runs on one stretch the least period stays: where others fit they are its multiples.

Each document is read by itself, whatever others hold; nothing is shuffled. Memory is in proportion to a block, or to one document that is longer.
Null and empty texts have no words, no runs and an empty collapsed text. Equal rows give equal rows. An empty table gives an empty one. All columns stay but
those named runs and collapsed, which the result's own replace; doc_id isn't looked at.
"""

from __future__ import annotations

from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, unused

LEAST, REPEATS = 24, 3
BLOCK, PLACES = 1 << 16, 1 << 20

#: A perfect difference set. Every residue modulo V but 0 is the difference of two of these in one way.
V, COVER = 13, (0, 1, 3, 9)
#: How far two places, by their residues, are from where both are sampled.
SHIFT = np.array([[next(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)] for a in range(V)], np.int64)
#: Number of a residue in the cover.
NUMBER = np.array([COVER.index(r) if r in COVER else -1 for r in range(V)], np.int64)


class Extensions:
    """Longest common extensions between places of an array of word numbers that ends in one that is nowhere else."""

    def __init__(self, words: np.ndarray):
        self.n, top = len(words), int(words.max()) + 1
        self.words = np.concatenate([words, np.arange(top, top + V)])
        places = np.arange(self.n)
        places = places[NUMBER[places % V] >= 0]
        levels = self._ranks(places, (top + V).bit_length())
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        self.table = self._minima(self._neighbours(places, levels, order))

    def _ranks(self, places: np.ndarray, bits: int) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first V, 2V, 4V... words, until all differ."""
        per = 63 // bits
        keys = []
        for at in range(0, V, per):
            key = np.zeros(len(places), np.int64)
            for i in range(at, min(V, at + per)):
                key = (key << bits) | self.words[places + i]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(places), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(places), np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [rank], len(COVER)
        while rank.max() + 1 < len(places):
            after = np.zeros(len(places), np.int64)
            after[:-step] = rank[step:] + 1
            rank = np.unique(rank * (len(places) + 1) + after, return_inverse=True)[1].reshape(-1)
            levels.append(rank)
            step *= 2
        return levels

    def _neighbours(self, places: np.ndarray, levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common words of each two sampled suffixes that follow each other in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) < len(places))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            length[same] += V << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        i, j = places[order[:-1]] + length, places[order[1:]] + length
        return length + self._compared(i, j, np.full(len(i), V))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most so many."""
        found, going = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(int(most.max(initial=0))):
            going = going[most[going] > k]
            going = going[self.words[i[going] + k] == self.words[j[going] + k]]
            found[going] += 1
        return found

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table, h = [values.astype(np.int32)], 1
        while 2 * h <= len(values):
            table.append(np.minimum(table[-1][:-h], table[-1][h:]))
            h *= 2
        return table

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i and j differ."""
        shift = SHIFT[i % V, j % V]
        found = self._compared(i, j, shift)
        on = np.flatnonzero((found == shift) & (np.maximum(i, j) + shift < self.n))
        a, b = i[on] + shift[on], j[on] + shift[on]
        a, b = (self.rank[x // V * len(COVER) + NUMBER[x % V]] for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            found[on[own]] += np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << int(k))])
        return found


def block_runs(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int = LEAST, repeats: int = REPEATS, places: int = PLACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in the block), length and period of the runs of documents that begin at such places of the block and have so many words; by start, then period."""
    empty = np.zeros(0, np.int64)
    most = np.where(sizes >= least, sizes // repeats, 0)
    period = np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most) + 1
    if not len(period):
        return empty, empty, empty
    begin, size = np.repeat(begins, most), np.repeat(sizes, most)
    step = np.maximum(least, repeats * period) - period
    count = -(-(size - period) // step)
    ahead = behind = None
    found = []
    upto = np.cumsum(count)
    at = 0
    while at < len(period):
        # So many rows of the grid as have at most the given number of places, or one row.
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + places, "right")))
        own = count[at:end]
        i = np.repeat(begin[at:end], own) + (np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)) * np.repeat(step[at:end], own)
        p = np.repeat(period[at:end], own)
        at = end
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        if not len(i):
            continue
        if ahead is None:
            ahead, behind = Extensions(words), Extensions(words[::-1])
        start, stop = i - behind.of(len(words) - i, len(words) - i - p), i + p + ahead.of(i, i + p)
        long = stop - start >= np.maximum(least, repeats * p)
        key, chosen = np.unique(np.stack([start[long], stop[long], p[long]]), axis=1, return_index=True)
        found.append(key)
    if not found:
        return empty, empty, empty
    start, stop, p = np.unique(np.concatenate(found, axis=1), axis=1)  # by start, then stop, then period
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, length, p = start[first], (stop - start)[first], p[first]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def _block(texts: list[list[bytes]], least: int, repeats: int):
    """Runs as (document, start, length, period) and the kept words of each document of a block."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    words = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    for t, b in zip(texts, begins.tolist(), strict=True):
        words[b : b + len(t)] = [numbers.setdefault(w, len(numbers)) for w in t]
    words[np.append(begins - 1, len(words) - 1)] = len(numbers) + np.arange(len(texts) + 1)
    start, length, period = block_runs(words, begins, sizes, least, repeats)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change) == 0
    of = np.searchsorted(begins, start, "right") - 1
    collapsed = [b" ".join(compress(t, kept[b : b + len(t)].tolist()) if not kept[b : b + len(t)].all() else t) for t, b in zip(texts, begins.tolist(), strict=True)]
    return of, start - begins[of] if len(of) else start, length, period, collapsed


def _collapsed(batches, names, least, repeats):
    for batch in batches:
        texts = [t.encode().split() for t in batch["text"].to_pylist()]
        parts, collapsed, base = [], [], 0
        while base < len(texts):
            end, n = base, 0
            while end < len(texts) and (end == base or n + len(texts[end]) <= BLOCK):
                n += len(texts[end])
                end += 1
            of, *runs, own = _block(texts[base:end], least, repeats)
            parts.append(np.stack([of + base, *runs]))
            collapsed += own
            base = end
        of, start, length, period = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
        offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array([c.decode() for c in collapsed], pa.string())], [*names, "runs", "collapsed"])


def collapse(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and runs (array of start, length, period, by start, then period) and collapsed: the words that are in no run after its first period."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, "runs", "collapsed", "text")]
    kinds = dict(docs.dtypes)
    rows = docs.select(*(F.col(f"`{c}`") for c in names), text_or_empty(f"`{text}`").alias("text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])
    return rows.mapInArrow(partial(_collapsed, names=names, least=least, repeats=repeats), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of such the one with the least start, then period."""
    sign = lambda x: F.signum(x).cast("int")
    more = lambda a, b: sign(b["length"] * a["period"] - a["length"] * b["period"])
    tie = lambda a, b: F.when(a["start"] != b["start"], sign(a["start"] - b["start"])).otherwise(sign(a["period"] - b["period"]))
    return F.get(F.array_sort(runs, lambda a, b: F.when(more(a, b) != 0, more(a, b)).otherwise(tie(a, b))), F.lit(0))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document, by the checksum of its id, goes on from one of its words in a period of its own."""
    h, words, n = unused(docs.columns, "h", "words", "n")
    g, a, p = F.floor(F.col(h) / 10), F.col("a"), F.col("p")
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias(h))
    told = rows.withColumn(words, F.when(F.col(h) % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).withColumn(n, F.size(words))
    told = told.withColumn("a", F.when(F.col(n) > 0, g % F.col(n))).withColumn("p", 1 + F.floor((F.col(n) - a) / (3 + g % 8)))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1), lambda i: F.get(words, place(i))), " ")
    return told.select("doc_id", F.when(F.col(n) > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = collapse(with_repeats(docs)).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
