"""Namespaces: db.collection names, which of them belong to users, and how they map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Databases that aren't users' own.
SYSTEM_DATABASES = ("admin", "config", "local")
#: Prefixes of databases that tools keep for themselves, and the engine's own database.
INTERNAL_PREFIXES = ("__internal_",)
META_DATABASE = "concord_metadata"
SYSTEM_COLLECTIONS, BUCKETS = "system.", "system.buckets."


def database(ns: Column) -> Column:
    return F.substring_index(ns, ".", 1)


def collection(ns: Column) -> Column:
    """What follows the first dot; empty without one."""
    at = F.locate(".", ns)
    return F.when(at == 0, F.lit("")).otherwise(F.substr(ns, at + 1))


def exclude_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    """True if c starts with none of them."""
    held = F.lit(False)
    for p in prefixes:
        held = held | c.startswith(p)
    return ~held


def is_user(ns: Column, internal: Sequence[str] = INTERNAL_PREFIXES) -> Column:
    db, coll = database(ns), collection(ns)
    own_db = ~db.isin(*SYSTEM_DATABASES, META_DATABASE) & exclude_prefixes(db, internal)
    return own_db & (exclude_prefixes(coll, [SYSTEM_COLLECTIONS]) | coll.startswith(BUCKETS))


def union(src: DataFrame, dst: DataFrame) -> DataFrame:
    """namespace: the users' namespaces of either side."""
    return src.select("namespace").union(dst.select("namespace")).where(is_user(F.col("namespace"))).distinct()


def one_sided(src: DataFrame, dst: DataFrame, strict: bool = False) -> DataFrame:
    """namespace and cluster that lacks it. strict: an error names one instead."""
    a, b = (x.select("namespace").where(is_user(F.col("namespace"))).distinct() for x in (src, dst))
    lacking = a.join(b, "namespace", "left_anti").select("namespace", F.lit("dstClient").alias("cluster")).union(b.join(a, "namespace", "left_anti").select("namespace", F.lit("srcClient").alias("cluster")))
    if strict and (first := lacking.first()):
        raise ValueError(f"namespace {first['namespace']} does not exist on {first['cluster']}")
    return lacking


def remap(df: DataFrame, mapping: Mapping[str, str], column: str = "namespace") -> DataFrame:
    """Destination namespaces as the source's. The mapping is configuration, so it is broadcast; a namespace it lacks is an error, the engine's own database is skipped."""
    spark: SparkSession = df.sparkSession
    if not mapping:
        return df.where(database(F.col(column)) != META_DATABASE)
    if len(set(mapping.values())) != len(mapping):
        raise ValueError("two source namespaces map to one destination namespace")
    table = spark.createDataFrame([(d, s) for s, d in mapping.items()], f"`{column}` string, _src string")
    met = df.where(database(F.col(column)) != META_DATABASE).join(F.broadcast(table), column, "left")
    known = F.coalesce("_src", F.raise_error(F.concat(F.lit("unknown namespace "), column)).cast("string"))
    return met.withColumn(column, known).drop("_src")
