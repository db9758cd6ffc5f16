"""Line dedup: documents probe sharded minimal perfect hashes instead of joining lines.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys
of at least CODE_POINTS code points in at least DOCUMENTS rows lose all their lines
except in the largest doc_id that holds them. Keys are known by 128 bits of hash;
distinct hashes that occur more than once are dealt to shards, and each shard becomes a
minimal perfect hash with arrays of fingerprints, counts and last documents at its slots; a document's
lines probe the arrays, and the count tells whether a key reaches DOCUMENTS.

The arrays are broadcast only while they take at most BROADCAST bytes, measured
before. Beyond it they stay a table: (hash, line) probes are dealt to the shards they
belong to, and come back as line numbers per document. A shard whose keys occur often is shared by
as many tasks as its counts ask for.

Null and empty texts are one empty line, which stays. Each row counts as one document; rows of one
doc_id that hold the last copy all keep it. With a null doc_id a row counts but never holds the last
copy unless all rows of the key lack an id; then all keep it. Columns besides doc_id and text ride along.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, unused, written
from .mph import MinimalPerfectHash

CODE_POINTS, DOCUMENTS = 20, 3
SHARD, BROADCAST, PROBES = 200_000, 64 << 20, 1_000_000
NO_ID = -(1 << 63)


def keys(text: str, least: int = CODE_POINTS) -> list[tuple[int, bytes]]:
    """Number and 16-byte hash of each line whose key is long enough."""
    import xxhash

    found = []
    for i, line in enumerate(text.encode().lower().split(b"\n")):
        if len(line) >= least:
            key = line.strip()
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                found.append((i, xxhash.xxh3_128_digest(key)))
    return found


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def _held(batches):
    """h1, h2, doc_id, n: each key once a document, counted together within a batch."""
    for batch in batches:
        seen: dict[bytes, list] = {}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for h in {h for _, h in keys(text)}:
                entry = seen.setdefault(h, [0, None])
                entry[0] += 1
                if doc_id is not None and (entry[1] is None or doc_id > entry[1]):
                    entry[1] = doc_id
        h = _hashes(list(seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], ["h1", "h2", "doc_id", "n"]
        )


def repeated(docs: DataFrame) -> DataFrame:
    """h1, h2, n, last of the keys in more than one row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    held = rows.mapInArrow(_held, "h1 long, h2 long, doc_id long, n long")
    return held.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("doc_id").alias("last")).where("n > 1")


def _shard(batches, shards):
    """A row for each shard of a sorted partition: its hash and arrays."""
    parts: list = []
    at = None

    def made():
        h1, h2, n, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        table = MinimalPerfectHash.over(h1, h2)
        slot = table.slots_of(h1, h2)
        prints, counts, lasts = np.empty_like(h1), np.empty(len(n), np.uint32), np.empty_like(last)
        prints[slot], counts[slot], lasts[slot] = h1, np.minimum(n, 0xFFFFFFFF), last
        return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int64()), "hash": [table.dump()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "lasts": [lasts.tobytes()], "held": pa.array([int(n.sum())], pa.int64())})

    for batch in batches:
        shard, h1, h2, n, last = (batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "h1", "h2", "n", "last"))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if parts and shard[a] != at:
                yield made()
                parts = []
            at = int(shard[a])
            parts.append((h1[a:b], h2[a:b], n[a:b], last[a:b]))
    if parts:
        yield made()


PARTS = ("hash", "prints", "counts", "lasts")
SHARD_TABLE = "shard long, hash binary, prints binary, counts binary, lasts binary, held long"


class Arrays:
    """The shards' hashes and arrays, for probes. documents: in how many rows a key must be."""

    def __init__(self, shards: int, rows: dict[int, tuple], documents: int = DOCUMENTS):
        self.shards, self.documents = shards, documents
        self.rows = {k: (MinimalPerfectHash.load(h), np.frombuffer(p, "<i8"), np.frombuffer(n, "<u4"), np.frombuffer(last, "<i8")) for k, (h, p, n, last) in rows.items()}

    def drops(self, h: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Which of the probes (hash, row's doc_id) are of lines to drop."""
        out = np.zeros(len(h), bool)
        shard = h[:, 0].view(np.uint64) % np.uint64(self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1, dtype=np.uint64))
        for k, (table, prints, counts, lasts) in self.rows.items():
            at = order[cuts[k] : cuts[k + 1]]
            slot = table.slots_of(h[at, 0], h[at, 1])
            there = slot >= 0
            at, slot = at[there], slot[there]
            same = (prints[slot] == h[at, 0]) & (counts[slot] >= self.documents)
            at, slot = at[same], slot[same]
            out[at] = (lasts[slot] != doc_id[at]) & (lasts[slot] != NO_ID)
        return out


def arrays(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """The table of shards, their number and the bytes of their arrays."""
    found = written(repeated(docs), "line-keys")
    n = found.count()
    shards = max(1, -(-n // shard))
    dealt = found.select(_modulo(shards), "h1", "h2", "n", F.coalesce("last", F.lit(NO_ID)).alias("last"))
    table = written(dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(partial(_shard, shards=shards), SHARD_TABLE), "line-shards")
    return table, shards, n * 21


def _modulo(shards: int):
    """h1 as an unsigned number modulo shards, for the numpy side's sake."""
    high, low = F.shiftrightunsigned("h1", 32), F.col("h1").bitwiseAND(F.lit(0xFFFFFFFF))
    return ((high % shards * ((1 << 32) % shards) + low) % shards).alias("shard")


def _kept(batches, known, names):
    known = known.value
    for batch in batches:
        ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        yield _joined(batch, texts, _dropped(known, ids, texts), names)


def _dropped(known: Arrays, ids: list, texts: list[str]) -> list[list[int]]:
    probes = [keys(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(p) for p in probes])
    if not len(row):
        return [[] for _ in texts]
    number = np.array([i for p in probes for i, _ in p], np.int64)
    doc_id = np.array([NO_ID if i is None else i for i in ids], np.int64)
    gone = known.drops(_hashes([h for p in probes for _, h in p]), doc_id[row])
    out: list[list[int]] = [[] for _ in texts]
    for r, i in zip(row[gone].tolist(), number[gone].tolist(), strict=True):
        out[r].append(i)
    return out


def _joined(batch, texts, dropped, names):
    kept, lines = [], []
    for text, gone in zip(texts, dropped, strict=True):
        own = text.split("\n")
        lines.append(len(own))
        if gone:
            gone = set(gone)
            text = "\n".join([x for i, x in enumerate(own) if i not in gone])
        kept.append(text)
    return pa.RecordBatch.from_arrays(
        [*(batch[c] for c in names), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array([len(set(g)) for g in dropped], pa.int64())], [*names, "text", "n_lines", "n_dropped"]
    )


def _probes(batches):
    for batch in batches:
        out = []
        for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            out += [(doc_id, key, i, h) for i, h in keys(text)]
        h = _hashes([x[3] for x in out])
        yield pa.RecordBatch.from_pydict({"h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "doc_id": pa.array([x[0] for x in out], pa.int64()), "row_key": pa.array([x[1] for x in out], pa.string()), "line": pa.array([x[2] for x in out], pa.int64())})


def _answers(batches, shards, documents):
    """Rows sorted by shard, a shard's arrays before its probes."""
    known, at = None, None
    for batch in batches:
        shard = batch["shard"].to_numpy()
        arrays_here = batch["hash"].is_valid().to_numpy(zero_copy_only=False)
        cuts = sorted({0, len(shard), *(np.flatnonzero(np.diff(shard)) + 1).tolist(), *np.flatnonzero(arrays_here).tolist(), *(np.flatnonzero(arrays_here) + 1).tolist()})
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if arrays_here[a]:
                at = int(shard[a])
                known = Arrays(shards, {at: tuple(part[c][0].as_py() for c in PARTS)}, documents)
            elif at == shard[a]:
                h = np.column_stack([part["h1"].to_numpy(), part["h2"].to_numpy()])
                doc_id = part["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
                gone = pa.array(known.drops(h, doc_id))
                yield pa.RecordBatch.from_arrays([part[c].filter(gone) for c in ("doc_id", "row_key", "line")], ["doc_id", "row_key", "line"])


def _cut(batches, names, gone):
    for batch in batches:
        yield _joined(batch, batch["text"].to_pylist(), [x or [] for x in batch[gone].to_pylist()], names)


def dedup(docs: DataFrame, documents: int = DOCUMENTS, broadcast: int = BROADCAST, shard: int = SHARD, probes: int = PROBES) -> DataFrame:
    """The rows of docs with their text's other lines joined by \\n, then n_lines (before) and n_dropped. documents: at least 2."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(*(F.col("doc_id").cast("long").alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")), text_or_empty().alias("text"))
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes if c != "text"), "text string, n_lines long, n_dropped long"])
    table, shards, size = arrays(docs, shard)
    if size <= broadcast:
        rows = {r["shard"]: tuple(bytes(r[c]) for c in PARTS) for r in table.collect()}  # at most so many bytes
        return docs.mapInArrow(partial(_kept, known=spark.sparkContext.broadcast(Arrays(shards, rows, documents)), names=names), schema)
    key, gone, gone_id, gone_key = unused(docs.columns, "row_key", "gone", "gone_id", "gone_key")
    docs = docs.withColumn(key, F.hex(F.xxhash64(F.lit(1), "text")))
    asked = docs.select("doc_id", F.col(key).alias("row_key"), "text").mapInArrow(_probes, "h1 long, h2 long, doc_id long, row_key string, line long").withColumn("shard", _modulo(shards))
    spread = table.select("shard", F.ceil(F.col("held") / probes).alias("tasks"))  # a row a shard
    asked = asked.join(F.broadcast(spread), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "line"), F.col("tasks"))).drop("tasks")
    spread = table.select("shard", *PARTS, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("held") / probes) - 1)).alias("part"))
    met = spread.unionByName(asked, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("hash").isNull())
    found = met.mapInArrow(partial(_answers, shards=shards, documents=documents), "doc_id long, row_key string, line long")
    found = found.groupBy(F.col("doc_id").alias(gone_id), F.col("row_key").alias(gone_key)).agg(F.collect_set("line").alias(gone))
    back = docs.join(found, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left")
    return back.select(*(F.col(f"`{c}`") for c in names), "text", gone).mapInArrow(partial(_cut, names=names, gone=gone), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), k AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l, unnest(range(1, len(lines) + 1)) AS u(i)
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.doc_id, k.i, k.line, (r.key IS NOT NULL AND k.doc_id <> r.last) AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
