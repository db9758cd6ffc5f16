"""A training corpus from raw documents, in stages that are each written as Parquet and read again.

Every stage but the last returns the columns of documents. Documents without doc_id count as documents of their own, and are dropped as such if they are copies.
Null texts are empty ones: they score as the classifier's prior, have one line, share fingerprint zero (so one row of them stays), and are never contaminated; after
line dedup they are written as empty texts. Rows that are equal in all columns are copies. Empty tables stay empty in every stage. Of other columns only those of documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, decontaminate, linededup, simhash, toxicity
from concord.llm.common import DOCUMENT_COLUMNS, scratch, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 4, fitted on the labelled ones among docs) scores under 0.5. All of them if labels of one class only, or none, taught it nothing."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights:
        return docs.select(*DOCUMENT_COLUMNS)
    return toxicity.score(docs.select(*DOCUMENT_COLUMNS), model).where("score < 0.5").select(*DOCUMENT_COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that operator 9 drops; n_chars follows the text."""
    return linededup.dedup(docs.select(*DOCUMENT_COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (operator 7), one row: that with the least doc_id, null being the greatest; of several such, that with the least hash of its columns; of equal rows, one."""
    marked = [x for c in DOCUMENT_COLUMNS for x in (F.col(c).isNull(), F.col(c))]  # a hash passes over nulls
    rows = docs.select(*DOCUMENT_COLUMNS, F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit(1), *marked).alias("h2"))
    prints = written(simhash.fingerprints(rows, keep=("h1", "h2")), "copies-fingerprints")
    # One row for each fingerprint meets its component, so no group of copies meets in one task.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("least")
    first = prints.groupBy("fp").agg(least)
    chosen = first.join(simhash.nodes(prints).select("fp", "component"), "fp").groupBy("component").agg(F.min("least").alias("least"))
    kept = written(chosen.select("least.h1", "least.h2"), "copies")
    # Only hashes are compared with hashes; the texts follow in one join, and equal rows lie together after it.
    return rows.join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select(*DOCUMENT_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 2 doesn't find contaminated by the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs.select(*DOCUMENT_COLUMNS), bench).where("not contaminated").select(*DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (operator 5), with digests of the ids and of what they decode to."""
    return bpe.encode(docs, keep=("lang", "source"), digests=True)


#: Name and function of each stage, in order.
STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: The toxicity stage's model is fitted, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted once its result is written, and so is that once the next one's is."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            before, path = path, kept.pop()
            kept += [before] * (before is not None)
    return docs
