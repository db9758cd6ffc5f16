"""Ranges of the document key: how many, where they start, and what is in them.

Ranges are results (reports, audit rows); Spark's own partitioning does the work. They are half-open,
so a document on a bound is counted once. The first has no lower bound, the last no upper one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ideal(size_bytes: int, target_bytes: int, ratio: float = 1.0, capped: bool = False) -> int:
    """Number of partitions: one for a capped collection, else one more than whole targets fit."""
    return 1 if capped else int(size_bytes * ratio // target_bytes) + 1


def sample_rate(size_bytes: int, documents: int, target_bytes: int) -> float | None:
    """Share of keys to sample so that samples lie one partition apart; None: no need to."""
    if not documents or not size_bytes:
        return None
    per_partition = documents / (size_bytes / target_bytes)
    return 1 / per_partition if 1 < per_partition else None


def ideal_of(size_bytes: Column, target_bytes: int, ratio: Column, capped: Column) -> Column:
    """ideal(), of each row of a table of statistics."""
    return F.when(capped, F.lit(1).cast("long")).otherwise(F.floor(size_bytes * ratio / target_bytes) + 1)


def stats(df: DataFrame, size: Column) -> DataFrame:
    """documents and bytes."""
    return df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))


def shard_stats(rows: DataFrame) -> DataFrame:
    """namespace, size, count and capped of per-shard statistics."""
    return rows.groupBy("namespace").agg(F.sum("size").alias("size"), F.sum("count").alias("count"), F.first("capped").alias("capped"))


def _search(edges: DataFrame) -> DataFrame:
    """One row that places keys among sorted edges (column e) in two steps of about the square root of their number."""
    n, g = F.size("e"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("e"))).cast("int"))
    groups = F.when(n == 0, F.array().cast(f"array<{edges.schema['e'].dataType.simpleString()}>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / g).cast("int"), F.lit(0))), lambda i: F.slice("e", i * g + 1, g))
    )
    return edges.select(g.alias("_g"), groups.alias("_groups")).select("_g", "_groups", F.transform("_groups", lambda x: F.get(x, F.lit(0))).alias("_heads"))


def _place(key: str) -> Column:
    """How many edges are at most key."""
    heads = F.size(F.filter("_heads", lambda x: x <= F.col(key)))
    inside = F.size(F.filter(F.get("_groups", heads - 1), lambda x: x <= F.col(key)))
    return F.when(heads == 0, 0).otherwise((heads - 1) * F.col("_g") + inside)


#: Distinct keys that are sampled for each range, where a sample stands for quantiles.
EDGE_SAMPLE = 100


def ranked(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """key and rank (from 0) of all rows in the order of key, without a task that sees them all.

    Rows are dealt to ranges between approximate quantiles; each range ranks its own after the rows of the ranges before it, whose counts are one row a range.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")
    if isinstance(df.schema[key].dataType, T.StringType | T.BinaryType | T.BooleanType):
        # There are no approximate quantiles of these; a bounded sample of keys gives them.
        every = max(1, df.count() // (EDGE_SAMPLE * n))
        chosen = df.select(key).where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).distinct()
        tiles = chosen.select(key, F.ntile(n).over(Window.orderBy(key)).alias("_tile")).groupBy("_tile").agg(F.max(key).alias("_end"))
        edges = tiles.agg(F.coalesce(F.array_sort(F.collect_list("_end")), none).alias("e"))
    else:
        quantiles = F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)
        edges = df.agg(F.array_sort(F.array_distinct(F.coalesce(quantiles, none))).alias("e"))
    dealt = df.select(key).join(F.broadcast(_search(edges))).select(key, _place(key).alias("_range"))  # n - 1 edges
    before = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").select(key, (F.col("_own") + F.col("_before")).alias("rank"))


def bounds(df: DataFrame, key: str, parts: int) -> DataFrame:
    """part (from 0), lower, upper: as many rows in each as can be, the first ones a row more.

    Equal keys never straddle a bound.
    """
    order = ranked(df, key)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    place = order.join(F.broadcast(total))
    size, extra = F.floor(F.col("_total") / parts), F.col("_total") % parts
    big = extra * (size + 1)
    part = F.when(F.col("rank") < big, F.floor(F.col("rank") / (size + 1))).otherwise(extra + F.floor((F.col("rank") - big) / F.greatest(size, F.lit(1))))
    first = place.withColumn("part", part.cast("int")).groupBy("part").agg(F.min(key).alias("first"))
    w = Window.orderBy("part")
    return first.select("part", F.when(F.col("part") > 0, F.col("first")).alias("lower"), F.lead("first").over(w).alias("upper"))


def sampled_bounds(df: DataFrame, key: str, per_partition: int) -> DataFrame:
    """Bounds from a sample that is the same each time: keys whose hash is divisible. About so many rows lie between two."""
    chosen = df.select(key).where(F.pmod(F.xxhash64(key), F.lit(per_partition)) == 0).distinct()
    every = chosen.select(F.col(key).alias("upper")).union(df.sparkSession.createDataFrame([(None,)], f"upper {df.schema[key].dataType.simpleString()}"))
    w = Window.orderBy(F.asc_nulls_last("upper"))
    return every.select((F.row_number().over(w) - 1).alias("part"), F.lag("upper").over(w).alias("lower"), "upper")


#: What a sample for bounds takes at most, as a share of the documents and for each partition, and the fewest documents that are sampled.
SAMPLE_SHARE, SAMPLE_EACH, SAMPLE_LEAST = 0.04, 3, 101


def bucket_bounds(df: DataFrame, key: str, parts: int, documents: int | None = None) -> DataFrame:
    """part, lower, upper: bounds from a sample of keys, at most so many for each partition, dealt into buckets of equal size.

    One partition if fewer than two are asked for or there is too little to sample. Keys are sampled by their hash, so the same ones come each time;
    the buckets' last keys are the bounds, and the last of all is dropped. Whatever the sample is, the ranges hold all keys, nulls in the first.
    """
    kind = df.schema[key].dataType.simpleString()
    whole = df.sparkSession.createDataFrame([(0, None, None)], f"part int, lower {kind}, upper {kind}")
    n = df.count() if documents is None else documents
    if parts < 2 or n < SAMPLE_LEAST:
        return whole
    every = max(1, int(n / min(n * SAMPLE_SHARE, SAMPLE_EACH * parts)))
    chosen = df.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).distinct()
    dealt = chosen.select(key, F.ntile(parts).over(Window.orderBy(key)).alias("_tile"))  # about three keys a partition
    ends = dealt.groupBy("_tile").agg(F.max(key).alias("upper")).withColumn("_last", F.max("_tile").over(Window.partitionBy()))
    edges = ends.where("_tile < _last").select("upper")
    every_edge = edges.unionByName(df.sparkSession.createDataFrame([(None,)], f"upper {kind}"))
    last = Window.orderBy(F.asc_nulls_last("upper"))
    return every_edge.select((F.row_number().over(last) - 1).cast("int").alias("part"), F.lag("upper").over(last).alias("lower"), "upper")


def sampled(df: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    """Each key with this probability: what bounds are made of where the table is too large to rank."""
    return df.select(key).sample(withReplacement=False, fraction=rate, seed=seed)


def within(key: Column, lower, upper) -> Column:
    """Rows of one range by its bounds' values, which reach the files' statistics. Null keys are in the first."""
    if lower is None and upper is None:
        return F.lit(True)
    if lower is None:
        return key.isNull() | (key < F.lit(upper))
    return key >= F.lit(lower) if upper is None else (key >= F.lit(lower)) & (key < F.lit(upper))


def inside(key: Column, lower: Column, upper: Column) -> Column:
    return (lower.isNull() | (key >= lower)) & (upper.isNull() | (key < upper))


def counts(df: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """part, lower, upper, documents. ranges has a row for each partition of hundreds of MB; their bounds reach all tasks as one row."""
    edges = ranges.agg(F.array_sort(F.collect_list("upper")).alias("e"))
    placed = df.select(key).join(F.broadcast(_search(edges))).select(_place(key).alias("part"))
    n = placed.groupBy("part").agg(F.count(F.lit(1)).alias("documents"))
    return ranges.join(n, "part", "left").select("part", "lower", "upper", F.coalesce("documents", F.lit(0)).alias("documents"))


def resume_after(tasks: DataFrame) -> DataFrame:
    """upper: the greatest bound that is already there."""
    return tasks.agg(F.max("upper").alias("upper"))


def physical(df: DataFrame) -> DataFrame:
    """What natural order is on files: file, rows."""
    return df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
