"""Rechecks: what the queue says about each document, and tasks made of it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduced(queue: DataFrame) -> DataFrame:
    """db, coll, doc_id, data_size, src_ts, dst_ts, first_mismatch_time: one row for each document.

    An event on a document clears the time at which it was first found to differ, whatever came first.
    """
    event = F.col("change_op_time").isNotNull()
    return (
        queue.groupBy("db", "coll", "doc_id")
        .agg(
            F.max("data_size").alias("data_size"),
            F.max(F.when(~F.col("from_dst"), F.col("change_op_time"))).alias("src_ts"),
            F.max(F.when(F.col("from_dst"), F.col("change_op_time"))).alias("dst_ts"),
            F.max(event).alias("_event"),
            F.min("first_mismatch_time").alias("_first"),
        )
        .withColumn("first_mismatch_time", F.when(~F.col("_event"), F.col("_first")))
        .drop("_event", "_first")
    )


def by_count(rows: DataFrame, by: str, order: str, most: int, ranges: int | None = None) -> DataFrame:
    """Adds chunk: tasks of at most so many ids of one namespace, in their order. Exact.

    Rows are dealt to ranges and numbered within each; a row for each namespace of a range says what stands before it, so no task sees a whole namespace.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, by, order).sortWithinPartitions(by, order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    heads = dealt.groupBy("_part", by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_part", by, (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero"))
    return dealt.join(F.broadcast(heads), ["_part", by]).withColumn("chunk", F.floor((F.col("_at") - F.col("_zero")) / most).cast("long")).drop("_part", "_at", "_zero")


def _greedy(frames, most_ids, most_id_bytes, most_bytes, times):
    part, at, chunk, ids, id_bytes, size, k = None, None, -1, 0, 0, 0, 1
    for frame in frames:
        out = []
        for ns, doc_id, data in zip(frame["namespace"], frame["doc_id"], frame["data_size"], strict=True):
            if ns != at or ids >= k * most_ids or id_bytes >= k * most_id_bytes or size >= k * most_bytes:
                at, chunk, ids, id_bytes, size, k = ns, chunk + 1, 0, 0, 0, times.get(ns, 1)
            ids, id_bytes, size = ids + 1, id_bytes + len((doc_id or "").encode()), size + int(data or 0)
            out.append(chunk)
        if part is None:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
        yield pd.DataFrame({"namespace": frame["namespace"], "doc_id": frame["doc_id"], "data_size": frame["data_size"], "task": [f"{part}-{c}" for c in out]})


def greedy(rows: DataFrame, most_ids: int = 10_000, most_id_bytes: int = 1 << 20, most_bytes: int = 400 << 20, ranges: int | None = None, times: Mapping[str, int] | None = None) -> DataFrame:
    """namespace, doc_id, data_size, task: a task ends where the namespace does or once it has so many ids, bytes of ids, or bytes of documents.

    Ranges of (namespace, doc_id) are walked in order, a batch at a time; a task also ends where a range does, so a hot namespace has several ranges.
    times: by what the limits are multiplied in some namespaces.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("namespace", "doc_id", F.col("data_size").cast("long").alias("data_size")).repartitionByRange(n, "namespace", "doc_id").sortWithinPartitions("namespace", "doc_id")
    return dealt.mapInPandas(partial(_greedy, most_ids=most_ids, most_id_bytes=most_id_bytes, most_bytes=most_bytes, times=dict(times or {})), "namespace string, doc_id string, data_size long, task string")


def tasks(chunked: DataFrame) -> DataFrame:
    """namespace, task, ids, bytes, lower, upper of greedy()'s tasks."""
    return chunked.groupBy("namespace", "task").agg(F.count(F.lit(1)).alias("ids"), F.sum("data_size").alias("bytes"), F.min("doc_id").alias("lower"), F.max("doc_id").alias("upper"))


def from_mismatches(mismatches: DataFrame, generation: int) -> DataFrame:
    """Rechecks of the next generation for what was found to differ."""
    from concord.functions.namespaces import collection, database

    once = mismatches.groupBy("namespace", "id").agg(F.max("data_size").alias("data_size"), F.min("first_ts").alias("first_mismatch_time"))
    none = F.lit(None).cast("struct<t:bigint,i:int>")
    return once.select(
        F.lit(generation + 1).alias("generation"), database(F.col("namespace")).alias("db"), collection(F.col("namespace")).alias("coll"), F.col("id").alias("doc_id"), "data_size",
        none.alias("change_op_time"), F.lit(False).alias("from_dst"), "first_mismatch_time",
    )
