"""Canonical exact digests of documents, by DataFrame functions only.

A text's canonical form is its NFKC, case-folded, with runs of white space as one
space and none at the ends. Two chained xxhash64 of it make 128 bits. Rows that fall
into one bucket of these are compared by the canonical bytes: buckets of one row are
left alone, the others are grouped by the bytes themselves, copies combining before they are shuffled, so that a
bucket of different texts (a collision) is told apart by an ordinal behind the fingerprint.

The edited text needs the next document by descending doc_id. Ids alone are dealt to
ranges for that, each range knows its own order, and the heads of the ranges, one row a partition,
link one range to the next; no task sees all ids.

Null texts are empty ones. Rows of one doc_id share the next lower doc_id; where several rows have
that, the least of their texts counts. A null doc_id comes after all others. One row alone follows itself.
An empty table gives an empty result. Only doc_id and text are read, so other columns clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, text_or_empty, written

NO_ID = -(1 << 63)
CELLS = 1 << 20


def canonical(text: Column) -> Column:
    """ASCII needs no normalisation; the rest goes through the ICU library that Spark itself uses for collation."""
    icu = lambda kind, method, c: F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), c, F.lit(True))
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text)))
    ascii_ = F.regexp_replace(F.lower(text), r"[\t-\r\x1C-\x20]+", " ")
    return F.trim(F.when(F.octet_length(text) == F.char_length(text), ascii_).otherwise(F.regexp_replace(folded, r"(?U)[\s\x1C-\x1F]+", " ")))


def wide(canon: Column) -> tuple[Column, Column]:
    """Two chained 64-bit hashes; the second starts from another seed."""
    return F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon)


def _print(h1: str, h2: str, ordinal: str) -> Column:
    """A fingerprint: 128 bits, and behind them the ordinal of all but the first text of a bucket."""
    bits = F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))
    return F.when(F.col(ordinal).isNotNull(), F.concat(bits, F.lit("-"), F.col(ordinal))).otherwise(bits)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty().alias("text"))


def hashed(rows: DataFrame, *keep: str) -> DataFrame:
    """id, keep, n (code points), canon, h1, h2."""
    rows = rows.select("id", *keep, "text", F.char_length("text").cast("long").alias("n"), canonical(F.col("text")).alias("canon"))
    h1, h2 = wide(F.col("canon"))
    return rows.withColumns({"h1": h1, "h2": h2})


def collisions(members: DataFrame) -> DataFrame:
    """h1, h2, canon_sha, ordinal > 0 of all but the first text, by bytes, in a bucket. members: h1, h2, canon of rows in buckets of several rows."""
    texts = members.groupBy("h1", "h2", "canon").agg(F.count(F.lit(1)).alias("rows"))
    ranked = texts.withColumn("ordinal", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1)
    return ranked.where("ordinal > 0").select("h1", "h2", F.sha2("canon", 256).alias("canon_sha"), "ordinal")


def told_apart(df: DataFrame, buckets: DataFrame, canon: str, h1: str, h2: str, ordinal: str) -> DataFrame:
    """Adds the ordinal of a text's bytes in its bucket (null: it is the first, or its bucket holds no other). buckets: h1, h2 and ordinals by digest; only texts that fall in one of them are digested."""
    other = buckets.select(F.col("h1").alias("_b1"), F.col("h2").alias("_b2"), "ordinals")
    met = df.join(other, (F.col(h1) == F.col("_b1")) & (F.col(h2) == F.col("_b2")), "left")
    return met.withColumn(ordinal, F.when(F.col("ordinals").isNotNull(), F.try_element_at("ordinals", F.sha2(canon, 256)))).drop("_b1", "_b2", "ordinals")


def crowded(slim: DataFrame) -> DataFrame:
    """cell: where the hashes of buckets with several rows fall; at most CELLS numbers, whatever the corpus."""
    buckets = slim.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return buckets.select(_cell().alias("cell")).distinct()


def _cell() -> Column:
    return F.pmod("h1", F.lit(CELLS)).cast("int")


def following(ids: DataFrame) -> DataFrame:
    """id and next_id: the next distinct id in descending order, after the least the greatest."""
    spark = ids.sparkSession
    dealt = ids.select("id").distinct().repartitionByRange(partitions(spark), F.desc("id")).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "id-ranges")  # what part an id is in must not change between its two uses
    heads = dealt.groupBy("part").agg(F.max("id").alias("head"))
    every = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = dealt.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id"))))
    return inside.join(after, "part").select("id", F.coalesce("next_id", "after").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once by id and, halved, once to the id before; all else is ids and hashes.
    """
    rows = _rows(docs)
    slim = written(hashed(rows).select("id", "n", "h1", "h2"), "digest-hashes")
    order = written(following(slim), "digest-order")
    members = hashed(rows).withColumn("cell", _cell()).join(F.broadcast(crowded(slim)), "cell", "left_semi").select("h1", "h2", "canon")
    found = collisions(members).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("canon_sha", "ordinal"))).alias("ordinals"))
    buckets = written(found, "digest-collisions")  # next to none, so Spark will broadcast it
    need = slim.join(order, "id").groupBy("next_id").agg(F.max(F.floor(F.col("n") / 2)).cast("int").alias("need"))
    about = written(order.join(need.withColumnRenamed("next_id", "id"), "id", "left").select("id", "next_id", F.coalesce("need", F.lit(0)).alias("need")), "digest-about")
    # Texts are hashed before the one exchange that both uses below share; it is one only while both read the same columns of it.
    held = told_apart(hashed(rows), buckets, "canon", "h1", "h2", "ordinal").drop("canon").repartition(partitions(docs.sparkSession), "id")
    own = held.join(about.select("id", "next_id"), "id").select("id", "next_id", "n", "h1", "h2", "ordinal", F.expr("left(text, cast(n - n div 2 as int))").alias("half"))
    later = held.join(about.select("id", "need"), "id").select(F.col("id").alias("next_id"), F.expr("left(text, least(need, cast(n as int)))").alias("lead"), _print("h1", "h2", "ordinal").alias("next_print"))
    later = later.groupBy("next_id").agg(F.min(F.struct("lead", "next_print")).alias("later")).select("next_id", "later.*")
    met = own.join(later, "next_id").withColumn("edited", F.concat("half", F.expr("left(lead, cast(n div 2 as int))")))
    met = met.withColumn("edited_canon", canonical(F.col("edited")))
    e1, e2 = wide(F.col("edited_canon"))
    told = told_apart(met.withColumns({"e1": e1, "e2": e2}), buckets, "edited_canon", "e1", "e2", "edited_ordinal")
    done = told.select("id", "n", F.sha2("edited", 256).alias("edited_sha256"), _print("h1", "h2", "ordinal").alias("fingerprint"), _print("e1", "e2", "edited_ordinal").alias("edited_fingerprint"), "next_print")
    like = lambda other: F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)
    return done.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        like("edited_fingerprint").alias("near_edited"),
        like("next_print").alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
