"""Progress: counts over tasks, events and mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.model import DDL_OPS, DOCUMENT_OPS, Status, TaskType


def _sum(value: Column | str, when: Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")


def finished() -> Column:
    return F.col("status").isin(Status.COMPLETED.value, Status.FAILED.value)


def status_counts(tasks: DataFrame, generation: int) -> DataFrame:
    """added, processing, completed, failed, mismatch, total: of all tasks but the primary one."""
    own = tasks.where((F.col("generation") == generation) & (F.col("type") != TaskType.PRIMARY.value))
    each = [_sum(F.lit(1), F.col("status") == s.value).alias(s.value) for s in Status]
    return own.agg(*each, F.count(F.lit(1)).alias("total"))


def namespace_progress(tasks: DataFrame, generation: int) -> DataFrame:
    """Per namespace: docsCompared, totalDocs, bytesCompared, totalBytes, partitionsAdded, partitionsProcessing, partitionsDone."""
    docs, coll = F.col("type") == TaskType.DOCUMENTS.value, F.col("type") == TaskType.COLLECTION.value
    own = tasks.where((F.col("generation") == generation) & (docs | coll))
    return (
        own.groupBy("namespace")
        .agg(
            _sum("found_source_documents_count", docs & finished()).alias("docsCompared"),
            _sum("documents_count", coll if generation == 0 else docs).alias("totalDocs"),
            _sum("source_bytes_count", docs & finished()).alias("bytesCompared"),
            _sum("source_bytes_count", coll).alias("totalBytes"),
            _sum(F.lit(1), docs & (F.col("status") == Status.ADDED.value)).alias("partitionsAdded"),
            _sum(F.lit(1), docs & (F.col("status") == Status.PROCESSING.value)).alias("partitionsProcessing"),
            _sum(F.lit(1), docs & finished()).alias("partitionsDone"),
        )
        .orderBy("namespace")
    )


def total_progress(progress: DataFrame, ended: bool = False) -> DataFrame:
    """Totals over namespaces. completedNss: nothing is left and, until the generation has ended, at least one partition is done."""
    names = ["docsCompared", "totalDocs", "bytesCompared", "totalBytes"]
    left = F.col("partitionsAdded") + F.col("partitionsProcessing")
    done = (left == 0) if ended else (left == 0) & (F.col("partitionsDone") > 0)
    one = F.lit(1)
    return progress.agg(
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.count(one).alias("totalNss"), _sum(one, done).alias("completedNss"), _sum(one, (left > 0) & (F.col("partitionsDone") + F.col("partitionsProcessing") > 0)).alias("activeNss")
    )


def with_workers(progress: DataFrame, live: DataFrame) -> DataFrame:
    """Adds what running work has done so far (namespace, docs, bytes) to the live view."""
    own = live.groupBy("namespace").agg(F.sum("docs").alias("_d"), F.sum("bytes").alias("_b"))
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    met = progress.join(own, "namespace", "left")
    return met.select(*(add(c, "_d") if c == "docsCompared" else add(c, "_b") if c == "bytesCompared" else c for c in progress.columns))


def rechecks_done(tasks: DataFrame) -> DataFrame:
    """documents: rechecked by finished tasks of all generations but the first."""
    own = (F.col("generation") > 0) & (F.col("type") == TaskType.DOCUMENTS.value) & finished()
    return tasks.where(own).agg(F.coalesce(F.sum("documents_count"), F.lit(0)).alias("documents"))


def last_rechecked(tasks: DataFrame) -> DataFrame:
    """src_ts, dst_ts: latest event of each side whose document a finished task has rechecked."""
    own = tasks.where((F.col("type") == TaskType.DOCUMENTS.value) & finished())
    return own.agg(F.max("src_ts").alias("src_ts"), F.max("dst_ts").alias("dst_ts"))


def event_counts(events: DataFrame, latest: bool = False) -> DataFrame:
    """cluster, namespace, and counts by kind of event, with subtotals of schema events and the total. latest: the last event's time, too."""
    ns = F.concat_ws(".", "db", F.nullif("coll", F.lit("")))
    count = lambda ops: F.sum(F.when(F.col("op_type").isin(*ops), 1).otherwise(0)).cast("long")
    each = [count([op]).alias(op) for op in DOCUMENT_OPS]
    last = [F.max("cluster_time").alias("last")] if latest else []
    real = F.coalesce(F.col("op_type") != "noop", F.lit(True))
    return events.groupBy("cluster", ns.alias("namespace")).agg(*each, count(DDL_OPS).alias("ddl"), F.count_if(real).alias("total"), *last)


def folded_counts(counted: DataFrame) -> DataFrame:
    """Counts of events by cluster and namespace, of several of event_counts(latest=True)."""
    names = [*DOCUMENT_OPS, "ddl", "total"]
    return counted.groupBy("cluster", "namespace").agg(*(F.sum(n).cast("long").alias(n) for n in names), F.max("last").alias("last"))


def feed_totals(counted: DataFrame) -> DataFrame:
    """cluster, counts by kind of event, and the latest event's time, over all namespaces and batches."""
    names = [*DOCUMENT_OPS, "ddl", "total"]
    return counted.groupBy("cluster").agg(*(F.sum(n).alias(n) for n in names), F.max("last").alias("last"))


def busiest(counted: DataFrame, n: int = 10) -> DataFrame:
    """The namespaces with the most events."""
    return counted.groupBy("namespace").agg(F.sum("total").alias("total")).orderBy(F.desc("total"), "namespace").limit(n)


def namespaces_of(tasks: DataFrame) -> DataFrame:
    return tasks.select("namespace").distinct()


def rates(samples: DataFrame, now: Column, window_seconds: int = 60) -> DataFrame:
    """What is done in a second: sum of the samples (time, n) of the window over the time since the oldest of them; 0 if there is none."""
    own = samples.where(F.col("time") >= now - F.make_dt_interval(secs=F.lit(window_seconds)))
    passed = (F.unix_millis(now) - F.unix_millis(F.min("time"))) / 1000
    return own.agg(F.when(passed > 0, F.sum("n") / passed).otherwise(F.lit(0.0)).alias("per_second"))


def event_rate(samples: DataFrame) -> DataFrame:
    """The oldest sample only marks the time from which events count; null with fewer than two times."""
    ends = samples.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    met = samples.join(F.broadcast(ends))
    passed = (F.unix_millis(F.first("hi")) - F.unix_millis(F.first("lo"))) / 1000
    return met.agg(F.when(passed > 0, F.sum(F.when(F.col("time") > F.col("lo"), F.col("n")).otherwise(0)) / passed).alias("per_second"))


def eta_seconds(phase: str, pending: float, per_second: float) -> float | None:
    """Seconds until the first check is done, at so much work a second; None where that can't be told."""
    if phase != "check":
        return None
    if pending <= 0:
        return 0.0
    return pending / per_second if per_second > 0 else None


def phase(running: bool, generation: int) -> str:
    return "idle" if not running else "recheck" if generation > 0 else "check"
