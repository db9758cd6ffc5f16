"""Token counts as additive totals, maintained by signed changes.

Totals are kept by source, language and tokenizer version. A batch of changes (inserts,
deletes, revised counts) becomes one signed delta table, written under the batch's own
name; its commit is Spark's _SUCCESS file, so a batch that was lost half-way has no effect and writes anew, and
one that is committed is not applied again. Totals are the sum of the committed deltas; compact() folds
deltas into a base that lists what it holds.

changes: op (insert, delete, revise), doc_id, source, lang, version, n_tokens, old_tokens for revise, and KEY where the
feed has it: what tells changes of one doc_id, or of none, from each other. Within a batch, rows that are equal in all
of these count once (feeds deliver some twice). Null counts are 0; null sources, languages and versions are
groups of their own; other ops are an error. Totals of groups that became empty stay out. Further columns are ignored.
An empty table gives no totals.
"""

from __future__ import annotations

from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, tokenfile
from .common import bounded_batches, scratch_path, text_or_empty, written

KEYS = ("source", "lang", "version")
KEY = "change_key"
SALTS = 32
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """The delta of a batch: one row for each group."""
    n, old = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
    once = changes.select("op", "doc_id", *KEYS, "n_tokens", "old_tokens", *(c for c in changes.columns if c == KEY)).distinct()
    each = once.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.alias("n_tokens"))
    return each.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Deltas and bases under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> dict[str, str]:
        """Name and path of each committed table."""
        top = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(top):
            return {}
        found = {s.getPath().getName(): s.getPath().toString() for s in self._fs.listStatus(top)}
        return {name: path for name, path in found.items() if self._fs.exists(self._path(f"{path}/_SUCCESS"))}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it was committed before."""
        name = quote(batch, safe="")
        if name in self._committed("deltas") or any(name in held for held in self._bases().values()):
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.folder}/deltas/{name}")
        return True

    def _bases(self) -> dict[str, list[str]]:
        """Of each base, the batches it holds."""
        return {path: [r[0] for r in self.spark.read.schema("batch string").parquet(f"{path}/batches").collect()] for path in self._committed("bases").values()}

    def _parts(self) -> tuple[list[str], list[str]]:
        """Paths to sum, and the names of the batches in them."""
        bases = self._bases()
        base = max(bases, key=lambda p: (len(bases[p]), p), default=None)
        held = set(bases.get(base, []))
        deltas = {n: p for n, p in self._committed("deltas").items() if n not in held}
        return ([f"{base}/totals"] if base else []) + list(deltas.values()), [*held, *deltas]

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of all committed batches."""
        paths, _ = self._parts()
        every = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        summed = every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs != 0 or n_tokens != 0")

    def compact(self, name: str) -> None:
        """A base of all that is committed. Its own _SUCCESS comes last; until then the old tables count."""
        _, batches = self._parts()
        path = f"{self.folder}/bases/{quote(name, safe='')}"
        self.totals().write.mode("overwrite").parquet(f"{path}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{path}/batches")
        self._fs.create(self._path(f"{path}/_SUCCESS"), True).close()


def _counts(batches, byte_path, word_path):
    byte, word = bpe.encoder(byte_path), tokenfile.encoder(word_path)
    for batch in batches:
        texts = batch["text"].to_pylist()
        n = [pa.array([len(x) // 4 for x in own(texts)], pa.int64()) for own in (byte.encode, word.ids)]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), *n], [*(c for c in batch.schema.names if c != "text"), "n_byte", "n_word"])


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, h1, h2 (hashes of the text), and token counts by both tokenizers, as a table in the shared folder."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    made = rows.mapInArrow(partial(_counts, byte_path=bpe.vocabulary(), word_path=bpe.vocabulary(tokenfile.VOCABULARY)), "doc_id long, source string, lang string, h1 long, h2 long, n_byte long, n_word long")
    return written(made, "token-counts")


def maintained(docs: DataFrame, folder: str) -> DataFrame:
    """The totals after four batches: all documents under byte_bpe_50k; all under word_bpe_49k; the end id added to the latter's counts; copies (the same text under a greater doc_id) deleted from both. The first and last are sent twice. Texts tell changes apart, so only rows of equal doc_id and text are one."""
    rows, store = counts(docs), Rollup(docs.sparkSession, folder)
    change = lambda frame, op, version, n, old=None: frame.select(
        F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), n.alias("n_tokens"), (F.lit(None).cast("long") if old is None else old).alias("old_tokens"), F.struct("h1", "h2").alias(KEY)
    )
    byte, word = F.col("n_byte"), F.col("n_word")
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A large group of copies meets its first document in as many parts as SALTS.
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"]).where("doc_id > first")
    batches = {
        "load": change(rows, "insert", "byte_bpe_50k", byte),
        "second-tokenizer": change(rows, "insert", "word_bpe_49k", word),
        "end-ids": change(rows, "revise", "word_bpe_49k", word + 1, word),
        "copies": change(copies, "delete", "byte_bpe_50k", byte).unionByName(change(copies, "delete", "word_bpe_49k", word + 1)),
    }
    for name in ("load", "load", "second-tokenizer", "end-ids", "copies", "copies"):
        store.apply(name, batches[name])
    return store.totals()


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "rollup"))
