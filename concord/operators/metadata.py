"""Differences of table metadata: kind, options, indexes, shard keys.

Inputs are small tables: specs (namespace, type, read_only, options as JSON), indexes (namespace, name, spec as JSON),
shard keys (namespace, key as JSON). Rows come out in the mismatch form: id, field, details, cluster, namespace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import ordering
from concord.model import DST, MISMATCH, MISSING, SRC

ROW = "array<struct<id:string,field:string,details:string,cluster:string>>"
TYPES = ("collection", "view", "timeseries")
VALUES = "map<string,string>"


def _row(id_, field, details, cluster: Column | str) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(id_).alias("id"), c(field).alias("field"), c(details).alias("details"), c(cluster).alias("cluster"))


def _values(json: Column) -> Column:
    """Top-level fields of a JSON object; nested ones as text with sorted keys."""
    entries = F.json_object_keys(json)
    value = lambda k: F.concat(F.to_json(F.variant_get(F.parse_json(json), F.concat(F.lit('$["'), k, F.lit('"]')), "variant")))
    return F.coalesce(F.map_from_arrays(entries, F.transform(entries, value)), F.create_map().cast(VALUES))


def _known(kind: Column) -> Column:
    return F.when(kind.isNull() | kind.isin(*TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown type of collection: "), kind)).cast("string"))


def _option_rows(src: Column, dst: Column) -> Column:
    a, b = F.map_keys(src), F.map_keys(dst)
    row = lambda k, details, cluster: _row("spec", F.concat(F.lit("options."), k), details, cluster)
    differs = F.filter(F.array_intersect(a, b), lambda k: src[k] != dst[k])
    return F.concat(
        F.transform(F.array_except(b, a), lambda k: row(k, MISSING, SRC)), F.transform(F.array_except(a, b), lambda k: row(k, MISSING, DST)), F.transform(differs, lambda k: row(k, MISMATCH, DST))
    )


def compare_specs(src: DataFrame, dst: DataFrame, verify_all: bool = True) -> DataFrame:
    """namespace, comparable (may its data be compared), rows. A namespace of one side only has one exist row.

    If types differ nothing else is told. Views' data is never compared, that of time series only with verify_all; a capped collection isn't comparable with one that isn't.
    """
    side = lambda df, p: df.select("namespace", F.struct(_known(F.col("type")).alias("type"), "read_only", "options").alias(p))
    met = side(src, "s").join(side(dst, "d"), "namespace", "full_outer")
    s, d = F.col("s"), F.col("d")
    so, do = _values(F.coalesce(s["options"], F.lit("{}"))), _values(F.coalesce(d["options"], F.lit("{}")))
    changed = lambda what, a, b: F.concat(F.lit(f"{MISMATCH}: src: "), a.cast("string"), F.lit(", dst: "), b.cast("string"))
    met = met.withColumns({"_so": so, "_do": do})
    named = F.col("_so"), F.col("_do")
    options = _option_rows(*named)
    order = F.when((F.size(options) == 0) & (s["options"] != d["options"]) & (F.json_object_keys(s["options"]) != F.json_object_keys(d["options"])), F.array(_row("spec", "options (field order only)", MISMATCH, DST))).otherwise(options)
    read_only = F.when(s["read_only"].eqNullSafe(d["read_only"]), F.array().cast(ROW)).otherwise(F.array(_row("", "readOnly", changed("readOnly", s["read_only"], d["read_only"]), DST)))
    rows = (
        F.when(s.isNull(), F.array(_row("", "", MISSING, SRC))).when(d.isNull(), F.array(_row("", "", MISSING, DST)))
        .when(s["type"] != d["type"], F.array(_row("", "type", changed("type", s["type"], d["type"]), DST)))
        .otherwise(F.concat(read_only, order))
    )
    capped = lambda o: F.coalesce(o["capped"], F.lit("false"))
    kind = s["type"]
    comparable = F.coalesce((kind == d["type"]) & ((kind == "collection") | ((kind == "timeseries") & F.lit(verify_all))) & (capped(named[0]) == capped(named[1])), F.lit(False))
    return met.select("namespace", comparable.alias("comparable"), rows.alias("rows"))


def rows(compared: DataFrame) -> DataFrame:
    """The rows of compare_specs, one each."""
    return compared.select("namespace", F.explode("rows").alias("r")).select("namespace", "r.*")


#: Parts of an index's specification that say nothing about it: its version, namespace, and how it was built.
IGNORED_INDEX_FIELDS = ("v", "ns", "background")


def _index_values(spec: Column) -> Column:
    """Parts of an index's specification that count: numbers by value (1 and 1.0 are one), true for any number but 0 where a flag is meant."""
    number = lambda v: F.when(v.rlike(r"^-?[0-9]+(\.0+)?$"), F.regexp_replace(v, r"\.0+$", "")).otherwise(v)
    flags = ("unique", "sparse", "hidden")
    kept = F.map_filter(_values(spec), lambda k, v: ~k.isin(*IGNORED_INDEX_FIELDS) & ~(k.isin(*flags) & v.isin("false", "0", "0.0")))
    return F.transform_values(kept, lambda k, v: F.when(k.isin(*flags), F.lit("true")).when(k == "key", v).otherwise(number(v)))


def _patch(src: Column, dst: Column) -> Column:
    """What would make the source's into the destination's, as a JSON patch."""
    a, b = F.map_keys(src), F.map_keys(dst)
    op = lambda kind, k, value=None: F.to_json(F.struct(F.lit(kind).alias("op"), F.concat(F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("path"), (F.lit(None).cast("string") if value is None else value).alias("value")))
    differs = F.filter(F.array_intersect(a, b), lambda k: src[k] != dst[k])
    ops = F.concat(F.transform(F.array_sort(differs), lambda k: op("replace", k, dst[k])), F.transform(F.array_sort(F.array_except(a, b)), lambda k: op("remove", k)), F.transform(F.array_sort(F.array_except(b, a)), lambda k: op("add", k, dst[k])))
    return F.when(F.size(ops) > 0, F.concat(F.lit("["), F.array_join(ops, ","), F.lit("]")))


def compare_indexes(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Index rows: id is the index's name, details Missing or a JSON patch. Indexes without a name are an error."""
    name = F.coalesce("name", F.raise_error(F.lit("index without a name")).cast("string"))
    side = lambda df, p: df.select("namespace", name.alias("name"), F.struct(_index_values(F.col("spec")).alias("v"), F.json_object_keys(F.get_json_object("spec", "$.key")).alias("k")).alias(p))
    met = side(src, "s").join(side(dst, "d"), ["namespace", "name"], "full_outer")
    s, d = F.col("s"), F.col("d")
    order = F.when(s["k"] != d["k"], F.lit('[{"op":"replace","path":"/key"}]'))
    details = F.when(s.isNull() | d.isNull(), F.lit(MISSING)).otherwise(F.coalesce(_patch(s["v"], d["v"]), order))
    return met.select("namespace", F.col("name").alias("id"), F.lit("index").alias("field"), details.alias("details"), F.when(s.isNull(), SRC).otherwise(DST).alias("cluster")).where("details is not null")


def _key_values(key: Column) -> Column:
    """The fields of a key in their order, each with its value in the order across types: numbers by value, and never equal to a text."""
    values = F.parse_json(key).cast("map<string,variant>")
    return F.transform(F.json_object_keys(key), lambda k: F.struct(k.alias("name"), ordering.encoded(F.try_element_at(values, k), T.VariantType()).alias("value")))


def compare_shard_keys(src: DataFrame, dst: DataFrame, both_sharded: bool = True) -> DataFrame:
    """Shard-key rows, if both sides are sharded. Numbers are equal by value, whatever their type; the order of fields counts."""
    if not both_sharded:
        return src.sparkSession.createDataFrame([], "namespace string, id string, field string, details string, cluster string")
    side = lambda df, p: df.select("namespace", F.col("key").alias(p))
    met = side(src, "s").join(side(dst, "d"), "namespace", "full_outer")
    s, d = F.col("s"), F.col("d")
    details = F.when(s.isNull() | d.isNull(), F.lit(MISSING)).when(_key_values(s) != _key_values(d), F.concat(F.lit(f"{MISMATCH}: src="), s, F.lit("; dst="), d))
    return met.select("namespace", F.lit("").alias("id"), F.lit("shard key").alias("field"), details.alias("details"), F.when(s.isNull(), SRC).otherwise(DST).alias("cluster")).where("details is not null")


def outcomes(compared: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """namespace, status: failed if its data can't be compared and something differs, mismatch if something differs, else completed."""
    every = rows(compared).select("namespace")
    for o in others:
        every = every.union(o.select("namespace"))
    bad = every.distinct().withColumn("bad", F.lit(True))
    differs = F.coalesce("bad", F.lit(False))
    return compared.select("namespace", "comparable").join(bad, "namespace", "left").select("namespace", F.when(differs & ~F.col("comparable"), "failed").when(differs, "mismatch").otherwise("completed").alias("status"))
