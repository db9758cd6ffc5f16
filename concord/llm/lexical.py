"""Ranked lexical search by hashed max-sketches.

Terms are maximal runs of 0-9, a-z (A-Z lower-cased) and all code points over 0x7F. A term's weight in the query comes from the number of documents that hold it,
its impact in a document from how often it stands there and how long the document is; a document's score is the sum of weight times impact over the query's terms.
All are integers.

1. totals() counts documents and terms.
2. index() stores for each document its distinct terms, their frequencies, and a sketch: terms are hashed to WIDTH coordinates, and each coordinate keeps the greatest
   impact of the terms that fall there, rounded up. So a coordinate is never less than the impact of any of its terms.
3. A block of queries becomes a matrix of weights by coordinate. Its product with a batch of sketches gives an upper bound for every document and query.
4. Documents are rescored exactly from their stored terms in descending order of how far their bounds exceed the queries' thresholds, the score that the last place of a query
   holds so far; it rises meanwhile, and the rest of a batch is left as soon as no bound reaches a threshold. Bounds equal to it are rescored, as ties go by doc_id.
5. Each task gives its best for each query, and these are ranked together.

Thresholds begin at what a first search over one in SEEDS documents finds, so that a task only gives what may be in the result; that changes no result.

Queries are any number: each block of them is at most ITEMS queries and about BYTES bytes of text (or one query), is broadcast, and searches the whole index.
All documents are searched; only the stated number of places limits the result.

Null and empty texts have no terms, are in no result, and don't count as documents. Rows of one doc_id are documents of their own, equal rows too, and may each have a place; null doc_ids
come last among equal scores. Queries that are equal in id and text count once; null or empty ones find nothing. Empty tables of documents or queries give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path, text_or_empty

PLACES = 20
WIDTH, GRAIN = 1024, 16
ITEMS, BYTES = 256, 4 << 20
SEEDS, CHUNK, ROWS = 64, 128, 1024

#: Separators become spaces and A-Z lower case, byte by byte; bytes of other code points stay.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _counted(batches):
    documents = total = 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            n = len(terms(text))
            documents += n > 0
            total += n
    yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [total]})


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""
    bounded_batches(docs.sparkSession)
    found = docs.select(text_or_empty().alias("text")).mapInArrow(_counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Of a term that stands so often in a document of n terms."""
    m = 75 + (25 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % WIDTH


def _indexed(batches, documents, total):
    for batch in batches:
        texts, ids = batch["text"], batch["doc_id"]
        for at in range(0, len(texts), ROWS):
            own = [Counter(terms(t)) for t in texts.slice(at, ROWS).to_pylist()]
            held = [i for i, c in enumerate(own) if c]
            own = [own[i] for i in held]
            if not own:
                continue
            sizes = np.array([len(c) for c in own])
            tf = np.fromiter(chain.from_iterable(c.values() for c in own), np.int64, int(sizes.sum()))
            at_doc = np.repeat(np.arange(len(own)), sizes)
            n = np.bincount(at_doc, tf, len(own)).astype(np.int64)
            known: dict[bytes, int] = {}
            place = np.fromiter((known[t] if t in known else known.setdefault(t, coordinate(t)) for t in chain.from_iterable(own)), np.int64, len(tf))
            value = -(-impacts(tf, n[at_doc], documents, total) // GRAIN)
            order = np.argsort(value, kind="stable")  # of several values for one cell the greatest is written last
            sketch = np.zeros((len(own), WIDTH), np.uint16)
            sketch[at_doc[order], place[order]] = value[order]
            ends = np.cumsum(sizes)
            tf = tf.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, ROWS).take(pa.array(held)), pa.array(n), pa.array([b" ".join(c) for c in own], pa.binary()), pa.array([tf[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                    pa.array([row.tobytes() for row in sketch], pa.binary()), pa.array([zlib.crc32(b" ".join(c)) % SEEDS == 0 for c in own]),
                ],
                ["doc_id", "n", "terms", "tfs", "sketch", "seed"],
            )


INDEX = "doc_id long, n long, terms binary, tfs binary, sketch binary, seed boolean"


def index(docs: DataFrame, counted: tuple[int, int]) -> DataFrame:
    """The stored index of docs: doc_id, n, terms, tfs, sketch, seed. counted: its totals()."""
    bounded_batches(docs.sparkSession)
    documents, total = counted
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    path = scratch_path(docs.sparkSession, "lexical-index")
    rows.mapInArrow(partial(_indexed, documents=documents, total=total), INDEX).write.option("compression", "zstd").partitionBy("seed").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def _held(batches, vocabulary):
    """Documents of this task that hold each of the queries' terms."""
    known = vocabulary.value
    held = np.zeros(len(known), np.int64)
    for batch in batches:
        for own in batch["terms"].to_pylist():
            held[[known[t] for t in own.split() if t in known]] += 1
    there = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], ["term", "df"])


class Queries:
    """A block of queries: their terms' weights, by coordinate for bounds and by term for scores."""

    def __init__(self, texts: list[list[bytes]], vocabulary: dict[bytes, int], df: np.ndarray, documents: int, total: int):
        self.documents, self.total, self.vocabulary, self.size = documents, total, vocabulary, len(texts)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        pairs = [(vocabulary[t], q, k) for q, text in enumerate(texts) for t, k in Counter(text).items()]
        term, query, times = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        self.query, self.weight = query, weight[term] * times
        self.begin = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        place = np.array([coordinate(t) for t in vocabulary], np.int64)
        self.matrix = np.zeros((WIDTH, len(texts)))
        np.add.at(self.matrix, (place[term], query), self.weight * float(GRAIN))

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds by document and query; what doubles round is made up for."""
        return (sketches.astype(np.float64) @ self.matrix) * (1 + 1e-12)

    def scores(self, n: np.ndarray, held: list[bytes], tfs: list[bytes]) -> np.ndarray:
        """Exact scores by document and query."""
        get = self.vocabulary.get
        own = [h.split() for h in held]
        number = np.array([get(t, -1) for t in chain.from_iterable(own)], np.int64)
        doc = np.repeat(np.arange(len(own)), [len(x) for x in own])[number >= 0]
        tf = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)[number >= 0]
        number = number[number >= 0]
        impact = impacts(tf, n[doc], self.documents, self.total)
        count = self.begin[number + 1] - self.begin[number]
        at = np.repeat(self.begin[number], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out = np.zeros((len(own), self.size), np.int64)
        np.add.at(out, (np.repeat(doc, count), self.query[at]), np.repeat(impact, count) * self.weight[at])
        return out


class Best:
    """The best documents of each query so far."""

    def __init__(self, thresholds: np.ndarray, places: int):
        self.places, self.thresholds = places, np.maximum(thresholds, 1)
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in thresholds]

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for q in np.flatnonzero((scores >= self.thresholds).any(0)).tolist():
            new = np.flatnonzero(scores[:, q] >= self.thresholds[q]).tolist()
            rows = sorted([*self.rows[q], *((-int(scores[i, q]), ids[i] is None, ids[i] or 0) for i in new)])[: self.places]
            self.rows[q] = rows
            if len(rows) == self.places:
                self.thresholds[q] = max(self.thresholds[q], -rows[-1][0])


def rescored(best: Best, queries: Queries, batch: pa.RecordBatch) -> Iterator[int]:
    """Takes a batch of the index into the best; gives how many documents were scored exactly, chunk by chunk."""
    bounds = queries.bounds(np.frombuffer(b"".join(batch["sketch"].to_pylist()), "<u2").reshape(-1, WIDTH))
    excess = (bounds - best.thresholds).max(1)
    order = np.argsort(-excess, kind="stable")
    order = order[excess[order] >= 0]
    while len(order):
        now, order = order[:CHUNK], order[CHUNK:]
        now = now[(bounds[now] >= best.thresholds).any(1)]
        if len(now):
            part = batch.take(pa.array(np.sort(now)))
            best.add(queries.scores(part["n"].to_numpy(), part["terms"].to_pylist(), part["tfs"].to_pylist()), part["doc_id"].to_pylist())
            yield len(now)
        order = order[(bounds[order] >= best.thresholds).any(1)]


def _searched(batches, queries, thresholds, places):
    queries = queries.value
    best = Best(thresholds, places)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for _ in rescored(best, queries, batch.slice(at, ROWS)):
                pass
    found = [(q, None if none else i, -s) for q, rows in enumerate(best.rows) for s, none, i in rows]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["query", "doc_id", "score"])


def _ranked(found: DataFrame, places: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def _block(stored: DataFrame, texts: list[list[bytes]], counted: tuple[int, int], places: int) -> DataFrame:
    """query (number), rank, doc_id, score of one block of queries."""
    spark = stored.sparkSession
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    shared = spark.sparkContext.broadcast(vocabulary)
    held = stored.select("terms").mapInArrow(partial(_held, vocabulary=shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # the block's terms at most
    df = np.zeros(len(vocabulary), np.int64)
    for r in held:
        df[r["term"]] = r["df"]
    queries = spark.sparkContext.broadcast(Queries(texts, vocabulary, df, *counted))
    search = lambda rows, thresholds: _ranked(rows.select("doc_id", "n", "terms", "tfs", "sketch").mapInArrow(partial(_searched, queries=queries, thresholds=thresholds, places=places), "query long, doc_id long, score long"), places)
    thresholds = np.zeros(len(texts), np.int64)
    for r in search(stored.where("seed"), thresholds).where(F.col("rank") == places).select("query", "score").collect():  # a row a query
        thresholds[r["query"]] = r["score"]
    return search(stored, thresholds)


def search(docs: DataFrame, items: DataFrame, places: int = PLACES, block: tuple[int, int] = (ITEMS, BYTES)) -> DataFrame:
    """item_id, rank, doc_id, score: the documents with the highest scores for each item (item_id, text), so many or all that score above 0."""
    spark = docs.sparkSession
    asked = items.select("item_id", text_or_empty().alias("text")).distinct()
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // block[0]), -(-size // block[1]))
    kind = asked.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    counted = totals(docs) if blocks else (0, 0)
    if not counted[1]:
        return out
    stored = index(docs, counted)
    for k in range(blocks):
        own = [(r["item_id"], t) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if (t := terms(r["text"]))]  # a block at a time
        if own:
            found = _block(stored, [t for _, t in own], counted, places)
            ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(own)], f"query long, item_id {kind.simpleString()}")
            out = out.unionByName(found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), c AS (
  SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0
), tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), c
), m AS (
  SELECT doc_id, 100 - 25 + ((25 * len(w)::BIGINT * nd) // nt) AS m FROM d, c WHERE len(w) > 0
), s AS (
  SELECT q.item_id, tf.doc_id, sum(q.k * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY q.item_id, tf.doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""
