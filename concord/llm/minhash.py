"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct shingles of SHINGLE words (A-Z lower-cased, split at ASCII white space), or all of its words as one if it has fewer. Documents are linked if
100 * intersection >= PERCENT * union. Shingles are known by 64 bits of hash.

1. Documents of equal sets are one class; all else is about classes, known by their least doc_id.
2. A class has a signature of BANDS * ROWS minima. Classes that agree on a whole band meet in a bucket; at the threshold a pair misses every band with probability (1 - 0.85 ** ROWS) ** BANDS, under one in a million.
3. Classes with more than the rest of the threshold in shingles that no other class in a bucket has can have no link, and leave. So documents that have a passage in common, but much of their own, don't meet in pairs.
   In each bucket the other members are tested against the most central one, which is linear. Large groups of near copies become one component that way.
4. Buckets that hold several components by then have their other pairs tested, but only pairs of different components that could be linked by their sizes and by what each shares with any class. No bucket is cut off.
5. A test compares signatures BATCH minima at a time. After each batch the posterior probability that the similarity reaches the threshold (uniform prior, one byte a minimum, so chance matches are accounted for)
   decides: pairs under MISS are dropped. What survives all batches is settled on the full sets of both texts.
6. Components of the links come from large-star and small-star rounds.

What is linear: signatures, postings, shingle counts, star tests. Step 4 has a pair for each two classes of different components that may be linked, so documents in great number that are nearly, but not quite, alike
cost their pairs there.

Null, empty and blank texts have empty sets, are linked with nothing and are their own component. Rows of one doc_id count as one document with several texts. Rows without doc_id are known by their text, are linked like others, and are never the
least of a component unless all are null; its component_id is null then and all stay. Equal rows all stay in the result. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, written
from .components import components

SHINGLE, PERCENT = 5, 85
ROWS, BANDS, BATCH = 8, 44, 32
MISS = 1e-6
CHUNK = 1 << 15

_RNG = np.random.Generator(np.random.PCG64(12))
_MIX = _RNG.integers(1, 1 << 63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(1, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, ROWS * BANDS, np.uint64)
_BAND = _RNG.integers(1, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[-1]
    return x ^ (x >> np.uint64(29))


def shingles(text: str, known: dict[bytes, int]) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles. known: hashes of words so far."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in found], np.uint64)
    if len(found) < SHINGLE:
        return _mixed((hashes * _MIX[: len(found)]).sum(keepdims=True) + np.uint64(len(found)))
    n = len(found) - SHINGLE + 1
    total = hashes[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        total += hashes[k : n + k] * _MIX[k]
    return np.unique(_mixed(total))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of sets that aren't empty: a row of minima for each."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out, work = np.empty((len(_ADD), len(sets)), np.uint64), np.empty_like(flat)
    for k in range(len(_ADD)):
        np.multiply(flat, _MULTIPLY[k], out=work)
        np.add(work, _ADD[k], out=work)
        out[k] = np.minimum.reduceat(work, begins)
    return out.T


def _signed(batches):
    import xxhash

    for batch in batches:
        known: dict[bytes, int] = {}
        sets = [shingles(t, known) for t in batch["text"].to_pylist()]
        held = [i for i, s in enumerate(sets) if len(s)]
        signatures, bands = [], []
        at = 0
        while at < len(held):
            end, n = at, 0
            while end < len(held) and (end == at or n + len(sets[held[end]]) <= CHUNK):
                n += len(sets[held[end]])
                end += 1
            least = minima([sets[i] for i in held[at:end]])
            signatures += [row.tobytes() for row in (_mixed(least) >> np.uint64(56)).astype(np.uint8)]
            bands.append(_mixed((least.reshape(-1, BANDS, ROWS) * _BAND).sum(2)).view(np.int64))
            at = end
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
        own = np.zeros(len(sets) + 1, np.int32)
        own[1:] = np.cumsum([BANDS * (len(s) > 0) for s in sets])
        texts = dict(zip(held, signatures, strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["node"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([texts.get(i) for i in range(len(sets))], pa.binary()),
             pa.ListArray.from_arrays(pa.array(own), pa.array(np.concatenate(bands).reshape(-1) if bands else np.zeros(0, np.int64)))],
            ["doc_id", "node", "n", "k1", "k2", "signature", "bands"],
        )


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal minima with which the similarity may still reach the threshold: the posterior that it does is at least miss.

    With a uniform prior the posterior of a share p of equal minima after m of n is Beta(m + 1, n - m + 1), which exceeds t as often as n + 1 throws of chance t have at most m hits.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        below, m = (1 - t) ** (n + 1), 0
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _likely(batches):
    need = least_matches()
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, ROWS * BANDS) for c in ("sa", "sb"))
        left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k, least in enumerate(need):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[left] += (a[left, part] == b[left, part]).sum(1)
            left = left[matches[left] >= least]
        yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(left)) for c in ("a", "b")], ["a", "b"])


def _confirmed(batches):
    last, own = None, None
    for batch in batches:
        known: dict[bytes, int] = {}
        keep = []
        for i, (x, y) in enumerate(zip(batch["ta"], batch["tb"], strict=True)):
            x = x.as_py()
            if x != last:
                last, own = x, shingles(x, known)
            other = shingles(y.as_py(), known)
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= PERCENT * (len(own) + len(other) - both) > 0:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _node(text: str = "text") -> Column:
    return F.coalesce(F.col("doc_id"), F.xxhash64(F.lit(12), text)).alias("node")


def _documents(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.select("doc_id", _node(), "text")


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node, n (size of the set), k1, k2 (digest of the set), signature, bands (a hash each) of every row, as a table in the shared folder; the last two are null or empty for empty sets."""
    bounded_batches(docs.sparkSession)
    return written(_documents(docs).mapInArrow(_signed, "doc_id long, node long, n long, k1 long, k2 long, signature binary, bands array<bigint>"), "minhash-signed")


def classes(rows: DataFrame) -> DataFrame:
    """rep, first (least doc_id), n, k1, k2, signature, bands of each set that isn't empty, as a table in the shared folder."""
    one = F.min_by(F.struct("signature", "bands"), "node").alias("s")
    return written(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("node").alias("rep"), F.min("doc_id").alias("first"), F.min("n").alias("n"), one).select("rep", "first", "n", "k1", "k2", "s.signature", "s.bands"), "minhash-classes")


def tested(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: those of the pairs (a, b: classes) that are linked, as a table in the shared folder."""
    bounded_batches(docs.sparkSession)
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("signature").alias(f"s{x}"))
    likely = written(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(_likely, "a long, b long").distinct(), "minhash-likely")
    asked = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    texts = written(_documents(docs).select("node", "text").join(asked, "node", "left_semi").distinct(), "minhash-texts")
    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return written(likely.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long").distinct(), "minhash-links")


def _posted(sets: DataFrame) -> DataFrame:
    """band, value, rep of classes in buckets of several."""
    posted = sets.select("rep", F.posexplode("bands").alias("band", "value"))
    several = posted.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    return posted.join(several, ["band", "value"])


def _each_shingle(batches):
    import xxhash

    for batch in batches:
        known: dict[bytes, int] = {}
        sets = [shingles(t, known) for t in batch["text"].to_pylist()]
        first = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")[0] for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(np.array(first, np.int64), [len(s) for s in sets]))], ["shingle", "k1"])


def members(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """band, value, rep, n, shared (shingles that another class that met one in a bucket has, too): classes in buckets of several that can be linked, as a table in the shared folder.

    What a class shares with another is at most what it shares with any. If that isn't the threshold's part of its own set, it has no link.
    """
    met = written(_posted(sets), "minhash-met")
    texts = _documents(docs).join(met.select(F.col("rep").alias("node")).distinct(), "node", "left_semi").select("text")
    every = texts.mapInArrow(_each_shingle, "shingle long, k1 long").groupBy("shingle").agg(F.min("k1").alias("k1"), F.max("k1").alias("last"))
    alone = every.where("k1 = last").groupBy("k1").agg(F.count(F.lit(1)).alias("alone"))
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    able = sets.join(alone, "k1", "left").select("rep", "n", shared.alias("shared")).where(100 * F.col("shared") >= PERCENT * F.col("n"))
    return written(met.join(able, "rep").select("band", "value", "rep", "n", "shared"), "minhash-members")


def _possible(a: str, b: str) -> Column:
    """Whether two classes can be linked, by their sizes and what they share with any: the intersection is at most the lesser of the two."""
    return (100 + PERCENT) * F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared")) >= PERCENT * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def stars(held: DataFrame) -> DataFrame:
    """a, b: the most central class of each bucket, that with the greatest part of its set shared, and each other member."""
    own = F.struct("rep", "n", "shared")
    most = held.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"), F.max_by(own, F.struct(F.col("shared") / F.col("n"), -F.col("rep"))).alias("a")).where("size > 1").select("band", "value", "a")
    met = held.select("band", "value", own.alias("b")).join(most, ["band", "value"]).where("a.rep <> b.rep").where(_possible("a", "b"))
    return met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def open_pairs(held: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """a < b: members of one bucket that are of different components by the links so far. A pair comes from the first band it shares, and so once."""
    label = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    met = held.join(label, held.rep == label.node, "left").select("band", "value", F.struct("rep", "n", "shared", F.coalesce("component", "rep").alias("component")).alias("x"))
    several = met.groupBy("band", "value").agg(F.min("x.component").alias("lo"), F.max("x.component").alias("hi")).where("lo < hi").select("band", "value")
    bands = sets.select("rep", "bands")
    left = written(met.join(several, ["band", "value"]).join(bands, F.col("x.rep") == bands.rep).select("band", "value", "x", "bands"), "minhash-open")
    a, b = (left.select("band", "value", F.col("x").alias(x), F.col("bands").alias(f"{x}_bands")) for x in "ab")
    first = F.array_position(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
    found = a.join(b, ["band", "value"]).where("a.rep < b.rep and a.component <> b.component").where(_possible("a", "b")).where(first)
    return found.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = signed(docs)
    sets = classes(rows)
    held = members(sets, docs)
    links = tested(stars(held), sets, docs)
    more = tested(open_pairs(held, links, sets), sets, docs)
    label = components(links.unionByName(more).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    told = written(sets.join(label, sets.rep == label.node, "left").select("k1", "k2", "first", F.coalesce("component", "rep").alias("component")), "minhash-components")
    least = told.groupBy("component").agg(F.min("first").alias("component_id"))
    found = told.join(least, "component").select("k1", "k2", "component_id")
    out = rows.where("n > 0").select("doc_id", "n", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) AS m USING (doc_id)
"""
