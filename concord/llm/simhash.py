"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most two bits differ in at most two of their eight
bytes, so they share at least SHARED = 6 bytes at equal positions. With the eight
positions paired into four blocks, fingerprints that share six share two blocks whole: postings
are kept for each two blocks (four positional bytes), and whatever meets in such a
posting list has its shared positional bytes tallied, must reach SHARED (candidates()), and is then
verified by the number of differing bits.

Only distinct fingerprints are posted, so copies never meet in pairs. A posting list
of over LIST fingerprints isn't paired at all: its fingerprints are posted once more
under each value that lies at most one bit away from their other four bytes. Two of
them are at most two bits apart exactly if they share such a value, and each is
linked to the least of its list. That is linear in the list and loses no component.

Components come from the links by rounds of large-star and small-star steps.

Null and empty texts have fingerprint zero and are linked like any other; equal rows
all stay; a null doc_id is never the least of its component unless all are null. An empty table gives an empty result.
Only doc_id and text are read, and the columns a caller asks to keep, so other columns clash with nothing.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, written
from .components import components

SEED, WORDS, BITS, SHARED, LIST = 42, 3, 2, 6, 64
CHUNK = 1 << 15


def simhash(text: str, words: int = WORDS) -> int:
    """The fingerprint as an unsigned 64-bit integer. bytes.lower() and bytes.split() know ASCII only, as asked."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.unpackbits(hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([simhash(t) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(found)], [*(c for c in batch.schema.names if c != "text"), "fp"])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns to keep, and fp, the fingerprint's 64 bits as a long."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprints, ", ".join(["doc_id long", *(f"{c} long" for c in keep), "fp long"]))


def _byte(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes are equal."""
    x = a.bitwiseXOR(b)
    total = F.lit(0)
    for i in range(8):
        total = total + (_byte(x, i) == 0).cast("int")
    return total


#: Masks of the pairs of blocks; a block is two neighbouring bytes.
MASKS = [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a in range(4) for b in range(a)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(distinct: DataFrame) -> DataFrame:
    """list, value, size, fp: the lists of several fingerprints (column fp, distinct), as a table in the shared folder."""
    posting = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in MASKS))).alias("list", "value"))
    sizes = posting.groupBy("list", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(posting.join(sizes, ["list", "value"]).select("list", "value", "size", "fp"), "simhash-postings")


def candidates(posting: DataFrame, most: int = LIST, shared: int = SHARED) -> DataFrame:
    """src > dst: pairs that meet in a list of at most so many and share enough positional bytes; a pair that meets in several lists comes from each."""
    short = posting.where(F.col("size") <= most)
    a, b = short.select("list", "value", F.col("fp").alias("src")), short.select("list", "value", F.col("fp").alias("dst"))
    met = a.join(b, ["list", "value"]).where(F.col("src") > F.col("dst"))
    return met.where(shared_bytes(F.col("src"), F.col("dst")) >= shared).select("src", "dst")


def links(distinct: DataFrame, most: int = LIST) -> DataFrame:
    """src > dst: links between fingerprints (column fp, distinct) that join exactly the fingerprints whose bits differ in at most BITS places."""
    posting = postings(distinct)
    paired = candidates(posting, most).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= BITS)
    free = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in MASKS))
    near = posting.where(F.col("size") > most).select("list", "value", "fp", F.explode(F.get(free, F.col("list"))).alias("flip")).select("list", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = near.groupBy("list", "near").agg(F.min("fp").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    starred = near.join(least, ["list", "near"]).where("fp > dst").select(F.col("fp").alias("src"), "dst")
    return paired.unionByName(starred).distinct()


def nodes(prints: DataFrame) -> DataFrame:
    """fp, first (the least doc_id of its rows) and component (the least fingerprint that links lead to) of each fingerprint in prints (doc_id, fp)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(links(distinct.select("fp")))
    return written(distinct.join(label, distinct.fp == label.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-nodes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links lead to from the row's fingerprint."""
    prints = written(fingerprints(docs), "simhash-fingerprints")
    found = nodes(prints)
    least = found.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = found.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
