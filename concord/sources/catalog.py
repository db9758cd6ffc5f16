"""The two sides of a reconciliation: tables by namespace, and what is known about them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import namespaces
from concord.model import DST, SRC

SPECS = "namespace string, type string, read_only boolean, options string"
INDEXES = "namespace string, name string, spec string"
SHARD_KEYS = "namespace string, key string"


@dataclass
class Side:
    """tables: namespace to a frame, or to a function that reads it; it is called anew for each unit of a generation's work.

    A unit reads the files its frames had when they were made, however often it reads them; what is written meanwhile waits for the next generation, which events bring it to.
    """

    spark: SparkSession
    tables: Mapping[str, DataFrame | Callable[[], DataFrame]]
    specs: DataFrame | None = None
    indexes: DataFrame | None = None
    shard_keys: DataFrame | None = None
    sharded: bool = False
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    #: JSON files of change events, and their format: feed or log.
    feed: str | None = None
    feed_kind: str = "feed"

    def plain(self) -> bool:
        """Whether nothing is known of the tables' metadata but which there are."""
        return self.specs is None and self.indexes is None and self.shard_keys is None

    def read(self, namespace: str) -> DataFrame:
        found = self.tables[namespace]
        return found() if callable(found) else found

    def namespaces(self) -> DataFrame:
        """namespace: the users' own."""
        every = self.spark.createDataFrame([(n,) for n in self.tables], "namespace string")
        return every.where(namespaces.is_user(F.col("namespace")))

    def spec(self, namespace: str | None = None) -> DataFrame:
        if self.specs is None:
            every = self.namespaces().select("namespace", F.lit("collection").alias("type"), F.lit(False).alias("read_only"), F.lit("{}").alias("options"))
        else:
            every = self.specs
        return every if namespace is None else every.where(F.col("namespace") == namespace)

    def capped(self, namespace: str) -> bool:
        """Whether a table is kept in the order of its rows; it is read whole, as one partition."""
        found = self.spec(namespace).select(F.get_json_object("options", "$.capped")).first()
        return found is not None and found[0] == "true"

    def all_capped(self) -> set[str]:
        """The tables that are kept in the order of their rows."""
        if self.specs is None:
            return set()
        return {r[0] for r in self.specs.where(F.get_json_object("options", "$.capped") == "true").select("namespace").collect()}  # names of tables

    def index_list(self) -> DataFrame:
        """namespace, name, spec. Without a table of indexes, each table has the one on its key, under the key's name."""
        if self.indexes is not None:
            return self.indexes
        own = [(ns, "_id_", json.dumps({"key": {k: 1 for k in self.keys[ns]}})) for ns in self.tables if ns in self.keys]
        return self.spark.createDataFrame(own, INDEXES)

    def shard_key_list(self) -> DataFrame:
        """namespace, key of the users' sharded tables. A key that isn't a JSON object is an error."""
        if self.shard_keys is None:
            return self.spark.createDataFrame([], SHARD_KEYS)
        told = F.when(F.json_object_keys("key").isNotNull(), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("not a shard key: "), F.coalesce("key", F.lit("null")))).cast("string"))
        return self.shard_keys.where(namespaces.is_user(F.col("namespace"))).select("namespace", told.alias("key"))

    def key_of(self, namespace: str, default: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(self.keys.get(namespace, default))


def count(df: DataFrame, condition: Column | None = None) -> int:
    """Documents that pass a filter."""
    return (df if condition is None else df.where(condition)).count()


def top_row(df: DataFrame, row_id: str) -> DataFrame:
    """The greatest row id."""
    return df.agg(F.max(row_id).alias(row_id))


def range_scan(df: DataFrame, key: str, lower=None, upper=None) -> DataFrame:
    """Rows with lower <= key < upper; the bounds reach the files' statistics."""
    if lower is not None:
        df = df.where(F.col(key) >= F.lit(lower))
    return df if upper is None else df.where(F.col(key) < F.lit(upper))


def id_scan(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def natural_scan(df: DataFrame, file: str, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """Rows of one file by their place in it."""
    place = F.col("_metadata.row_index")
    found = df.where(F.col("_metadata.file_path") == file)
    if lower is not None:
        found = found.where(place >= lower)
    return found if upper is None else found.where(place < upper)


def natural_parts(df: DataFrame, rows: int, at: str = "_at") -> DataFrame:
    """Adds a column (file, part, place) to a table's rows: the natural order cut into stretches of so many rows, each within one file. One scan, whatever the number of files."""
    place = F.col("_metadata.row_index")
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.floor(place / rows).alias("part"), place.alias("place")).alias(at))


def indexes_of(specs: DataFrame) -> DataFrame:
    """namespace, name, spec of the indexes that tables' specifications list (column indexes: JSON), with the one on the key as _id. An index without a name is an error."""
    each = F.explode(F.from_json("indexes", "array<string>")).alias("spec")
    name = F.coalesce(F.get_json_object("spec", "$.name"), F.raise_error(F.lit("an index has no name")).cast("string"))
    listed = specs.select("namespace", each).select("namespace", name.alias("name"), "spec")
    own = specs.where(F.col("id_index").isNotNull()).select("namespace", F.lit("_id").alias("name"), F.col("id_index").alias("spec"))
    return listed.unionByName(own)


def one_spec(specs: DataFrame, namespace: str) -> dict | None:
    """The specification of a namespace: none if it isn't there, an error if it is there twice."""
    found = specs.where(F.col("namespace") == namespace).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"{namespace} is there more than once")
    return found[0].asDict() if found else None


def parquet_side(spark: SparkSession, paths: Mapping[str, str], **more) -> Side:
    """A side of Parquet tables by namespace."""
    return Side(spark, {ns: (lambda p=p: spark.read.parquet(p)) for ns, p in paths.items()}, **more)


CLUSTERS = (SRC, DST)
