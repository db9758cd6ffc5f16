"""The run of a reconciliation: generation 0 compares everything, each further one what is in the recheck queue.

The queue is fed by what a generation finds, and by the change feeds of both sides, which are followed as streams while generations run.

State is a small file; mismatches, tasks and rechecks are tables by generation in a folder that all machines share. A generation's work is cut into
units: metadata, and tables or key ranges of large ones. The units are noted before work begins, several are worked on at a time, and each replaces what an attempt before it left and
is noted when it is whole, so a run that was cut off repeats open units only. The generation moves on after all of them.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor, wait
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.functions import filters, keys, namespaces, ordering
from concord.functions.history import Last
from concord.model import DST, MISMATCHES, RECHECKS, SRC, TASKS, Options, Phase, Status, TaskType
from concord.operators import classify, diff, metadata, partitioning, recheck, statistics
from concord.sources import catalog, keyindex, store
from concord.sources.catalog import Side
from concord.sources.retry import Retry, TransientError
from concord.streaming import changes

from . import reports

log = logging.getLogger("concord")

#: What unit the tables' metadata are.
META = "meta"


class Engine:
    def __init__(self, src: Side, dst: Side, folder: str, options: Options | None = None):
        self.spark, self.src, self.dst, self.options = src.spark, src, dst, options or Options()
        self.folder = folder.rstrip("/")
        self.fence = store.Fence(self.spark, self.folder)
        self.state = store.State(self.spark, self.folder, self.fence)
        self.running, self.began = False, None
        self.streams: dict[str, StreamingQuery] = {}
        self.rates = {SRC: Last(), DST: Last()}
        self._queue_lock, self._still = threading.RLock(), threading.Event()
        self._index_locks: dict[tuple[str, str], threading.Lock] = defaultdict(threading.Lock)
        self._warning = reports.SchemaWarning()

    # Tables.

    def mismatches(self) -> DataFrame:
        return store.table(self.spark, f"{self.folder}/mismatches", MISMATCHES)

    def tasks(self) -> DataFrame:
        return store.table(self.spark, f"{self.folder}/tasks", TASKS)

    def queue(self, generation: int) -> DataFrame:
        """Rechecks of a generation. plain: doc_id is the id as a change feed gives it, else the key's canonical text, as mismatches have it."""
        every = self.spark.createDataFrame([], RECHECKS).withColumn("plain", F.lit(False))
        for kind in ("rechecks", "changes"):
            path = f"{self.folder}/{kind}/generation={generation}"
            if store.exists(self.spark, path):
                found = self.spark.read.option("recursiveFileLookup", "true").schema(RECHECKS).parquet(path)
                every = every.unionByName(found.withColumn("plain", F.lit(kind == "changes")))
        return every.withColumn("generation", F.lit(generation))

    def event_counts(self) -> DataFrame:
        """Change events by cluster, namespace and kind."""
        return changes.counts(self.spark, f"{self.folder}/changes")

    def generation(self) -> int:
        return self.state.read()["generation"]

    def phase(self) -> Phase:
        return Phase(statistics.phase(self.running, self.generation()))

    # Change feeds.

    def _feeds(self) -> list[tuple[str, Side]]:
        return [(cluster, side) for cluster, side in ((SRC, self.src), (DST, self.dst)) if side.feed]

    def _stream(self, cluster: str, side: Side, until_now: bool) -> StreamingQuery:
        mapped = self.options.namespaces
        only = None if not mapped else list(mapped if cluster == SRC else mapped.values())
        parse = {"feed": changes.from_feed, "log": changes.from_log}[side.feed_kind]
        events = parse(changes.read(self.spark, side.feed, side.feed_kind, max_files=self.options.feed_files), cluster, only, marks=True)
        writer = changes.RecheckWriter(f"{self.folder}/changes", self.generation, cluster, self.options.src_ddl, mapped or None, self.options.ddl_until, self._queue_lock)
        return changes.start(events, writer, f"{self.folder}/checkpoints/{cluster}", until_now=until_now)

    def follow(self) -> None:
        """Begins to follow the sides' change feeds, from where an earlier run ended."""
        for cluster, side in self._feeds():
            if cluster not in self.streams or not self.streams[cluster].isActive:
                self.streams[cluster] = self._stream(cluster, side, until_now=False)

    def unfollow(self) -> None:
        """Stops following. A batch that is cut off is handled anew by whoever follows next."""
        for query in self.streams.values():
            query.stop()
        self.streams.clear()

    def drain(self) -> None:
        """Handles all events that the feeds hold now, as after the last write. If writes went off at a logical time, until each feed has come so far, however late its files are."""
        self.unfollow()
        until, began = self.state.read().get("final") or {}, time.monotonic()
        left = dict(self._feeds())
        while left:
            queries = [self._stream(cluster, side, until_now=True) for cluster, side in left.items()]
            try:
                for query in queries:
                    query.awaitTermination()
            except StreamingQueryException as e:
                raise self._failure(e) from e
            finally:
                for query in queries:
                    query.stop()
            left = {c: side for c, side in left.items() if until.get(c) and (changes.mark(self.spark, f"{self.folder}/changes", c) or (-1, 0)) < tuple(until[c])}
            if left and time.monotonic() - began > self.options.drain_seconds:
                raise TimeoutError(f"after {self.options.drain_seconds} seconds these feeds haven't come to where writes went off: {', '.join(left)}")
            if left:
                time.sleep(min(1.0, self.options.pause_seconds))

    @staticmethod
    def _failure(e: Exception) -> Exception:
        text = str(e)
        return changes.SchemaChange(text) if changes.SchemaChange.__name__ in text else e

    def _look_at_feeds(self) -> None:
        """A feed that failed ends the run; what the others say is kept for reports."""
        for cluster, query in self.streams.items():
            if (e := query.exception()) is not None:
                raise self._failure(e) from e
            self.rates[cluster].add(changes.rates(query))

    # Work.

    def clean(self) -> None:
        store.delete(self.spark, self.folder)

    def _pairs(self) -> list[tuple[str, str]]:
        """Source and destination namespaces to compare."""
        if self.options.namespaces:
            return list(self.options.namespaces.items())
        src, dst = self.src.namespaces(), self.dst.namespaces()
        namespaces.one_sided(src, dst, self.options.strict_namespaces)
        return [(r["namespace"], r["namespace"]) for r in namespaces.union(src, dst).orderBy("namespace").collect()]  # names of tables

    def compare_metadata(self, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows of all differences of metadata, and each namespace's (status, comparable). scratch: a folder for the tables (rows by namespace) that both are read from."""
        kept = lambda df, name: df if scratch is None else store.kept(df, f"{scratch}/{name}")
        named = lambda df: namespaces.remap(df, self.options.namespaces) if self.options.namespaces else df
        specs = kept(metadata.compare_specs(self.src.spec(), named(self.dst.spec()), self.options.verify_all), "specs")
        indexes = kept(metadata.compare_indexes(self.src.index_list(), named(self.dst.index_list())), "indexes")
        shards = kept(metadata.compare_shard_keys(self.src.shard_key_list(), named(self.dst.shard_key_list()), self.src.sharded and self.dst.sharded), "shard-keys")
        found = metadata.rows(specs).select("namespace", "id", "field", "details", "cluster").unionByName(indexes).unionByName(shards)
        return found, metadata.outcomes(specs, [indexes, shards]).join(specs.select("namespace", "comparable"), "namespace")

    def _ranges(self, ns: str, capped: set[str]) -> list[dict]:
        """Bounds (order-preserving texts) of the ranges that a table is compared in: as many as its size asks for, within options.ranges; one for capped tables. Keys of several fields are ranged by their texts."""
        key, df = self.src.key_of(ns, self.options.keys), self.src.read(ns)
        size = store.bytes_of(df)
        parts = min(self.options.ranges, partitioning.ideal(size, self.options.partition_bytes)) if size else 1
        if parts < 2 or ns in capped:
            return [{"lower": None, "upper": None, "bytes": size}]
        if len(key) == 1 and key[0] in df.columns and ordering.reads_back(df.schema[key[0]].dataType):
            found = partitioning.bucket_bounds(df, key[0], parts).select("part", *(F.when(F.col(b).isNotNull(), ordering.encoded(F.col(b), df.schema[key[0]].dataType)).alias(b) for b in ("lower", "upper")))
        else:
            found = partitioning.bucket_bounds(df.select(keys.order_text(df, key).alias("k")), "k", parts)
        return [{"lower": r["lower"], "upper": r["upper"], "bytes": size // parts} for r in found.orderBy("part").collect()]  # options.ranges at most

    def _inside(self, df: DataFrame, key: tuple[str, ...], unit: dict) -> DataFrame:
        """The rows of a unit's range. Bounds of one plain field become values of its type, so that they reach the files' statistics."""
        if unit["lower"] is None and unit["upper"] is None:
            return df
        kind = df.schema[key[0]].dataType if len(key) == 1 and key[0] in df.columns else None
        if kind is not None and ordering.reads_back(kind):
            own, read = F.col(f"`{key[0]}`"), lambda b: ordering.literal(b, kind)
        else:
            own, read = keys.order_text(df, key), F.lit
        return df.where(partitioning.within(own, *(None if unit[b] is None else read(unit[b]) for b in ("lower", "upper"))))

    def _due(self, g: int, pairs: list[tuple[str, str]]) -> list[dict]:
        """Units of a generation of rechecks: of each table that the queue names, as many as its ids and bytes ask for, about options.ranges at most: where they ask for more, each takes so many times more. The queue is read once and written by table, in the order of its keys."""
        queue = self.queue(g).withColumn("namespace", F.concat_ws(".", "db", "coll"))
        named = {r["namespace"] for r in queue.select("namespace").distinct().collect()}  # a row a table
        to = {ns: other for ns, other in pairs if ns in named}
        shapes: dict[tuple, list[str]] = {}
        for ns in to:
            key, schema = self.src.key_of(ns, self.options.keys), self.src.read(ns).schema
            shapes.setdefault((key, tuple(keys.path(schema, k)[1].json() for k in key)), []).append(ns)
        if not shapes:
            return []
        which = self.spark.createDataFrame([(ns, i) for i, own in enumerate(shapes.values()) for ns in own], "namespace string, shape int")
        text = F.lit(None).cast("string")
        for i, ((key, _), own) in enumerate(shapes.items()):
            text = F.when(F.col("shape") == i, keys.text_of_plain_keys(F.col("doc_id"), self.src.read(own[0]).schema, key)).otherwise(text)
        keyed = queue.join(F.broadcast(which), "namespace").withColumn("doc_id", F.when(F.col("plain"), text).otherwise(F.col("doc_id")))
        known = recheck.reduced(keyed).withColumn("namespace", F.concat_ws(".", "db", "coll")).drop("db", "coll")
        path = f"{self.folder}/due/generation={g}"
        known.repartitionByRange("namespace", "doc_id").sortWithinPartitions("namespace", "doc_id").write.mode("overwrite").partitionBy("namespace").parquet(path)
        kept = self.spark.read.schema(known.schema).parquet(path)
        sizes = kept.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("data_size").cast("long")).alias("bytes")).collect()  # a row a table
        o, units = self.options, []
        asked = {r["namespace"]: max(-(-r["n"] // o.recheck_unit_ids), -(-(r["bytes"] or 0) // o.partition_bytes)) for r in sizes}
        parts = {ns: min(o.ranges, n) for ns, n in asked.items()}
        many = [ns for ns, n in parts.items() if n > 1]
        cut: dict[str, list] = {}
        if many:
            rows = kept.where(F.col("namespace").isin(many)).select("namespace", "doc_id", "data_size")
            greedy = recheck.greedy(rows, o.recheck_unit_ids, 1 << 62, o.partition_bytes, ranges=sum(parts[ns] for ns in many), times={ns: -(-asked[ns] // parts[ns]) for ns in many})
            for r in recheck.tasks(greedy).orderBy("namespace", "lower").collect():  # a row a unit
                cut.setdefault(r["namespace"], []).append({"first": r["lower"], "last": r["upper"]})
        for ns in sorted(parts):
            units += [{"namespace": ns, "to": to[ns], "lower": None, "upper": None} | ids for ids in cut.get(ns, [{"first": None, "last": None}])]
        return units

    def _plan(self, g: int, moment: Column) -> dict:
        """The generation's units, noted before the first begins, and the metadata's outcome, whose rows are written. An attempt that was cut off left them."""
        path = f"{self.folder}/plans/{g}.json"
        if noted := store.text(self.spark, path):
            return json.loads(noted)
        for kind in ("mismatches", "tasks", "done"):
            store.delete(self.spark, f"{self.folder}/{kind}/generation={g}")
        if self._nothing_to_say():
            bad = {ns: ("completed", True) for ns, _ in self._pairs()}
            store.touch(self.spark, path, json.dumps(plan := self._units_of(g, bad)))
            return json.loads(json.dumps(plan))
        found, status = self.compare_metadata(scratch := f"{self.folder}/scratch/{g}-{META}")
        times = {"first_ts": moment, "duration_ms": F.lit(0).cast("long"), "data_size": F.lit(0)}
        rows = found.select(F.lit(TaskType.COLLECTION.value).alias("task_type"), F.concat(F.lit(f"{g}-meta-"), "namespace").alias("task_id"), "id", "field", "details", "cluster", "namespace").withColumns(times)
        store.replace_part(self._shaped(rows, g), f"{self.folder}/mismatches", g, META)
        bad = {r["namespace"]: (r["status"], r["comparable"]) for r in status.collect()}  # a row a table
        plan = self._units_of(g, bad)
        store.touch(self.spark, path, json.dumps(plan))
        store.delete(self.spark, scratch)
        return json.loads(json.dumps(plan))

    def _nothing_to_say(self) -> bool:
        """Whether both sides have the same tables and keys, and no other metadata, so that there is nothing to compare."""
        mapped = self.options.namespaces
        same = mapped.keys() <= self.src.tables.keys() and set(mapped.values()) <= self.dst.tables.keys() if mapped else self.src.tables.keys() == self.dst.tables.keys()
        return same and self.src.plain() and self.dst.plain() and (dict(self.src.keys) == dict(self.dst.keys) if not mapped else not self.src.keys and not self.dst.keys)

    def _units_of(self, g: int, bad: dict[str, tuple[str, bool]]) -> dict:
        """A generation's plan, by the metadata's outcome (status, comparable) of each table."""
        pairs = [(ns, to) for ns, to in self._pairs() if ns in self.src.tables and to in self.dst.tables and bad.get(ns, ("", True))[1]]
        if g:
            units = self._due(g, pairs)
        else:
            capped = self.src.all_capped()
            units = [{"namespace": ns, "to": to} | r for ns, to in pairs for r in self._ranges(ns, capped)]
        return {"units": [{"unit": str(i)} | u for i, u in enumerate(units)], "status": {ns: s for ns, (s, _) in bad.items()}}

    def _known(self, g: int, unit: dict) -> DataFrame:
        """What the queue says of a unit's documents, by key text."""
        kind = "doc_id string, data_size int, src_ts struct<t:bigint,i:int>, dst_ts struct<t:bigint,i:int>, first_mismatch_time timestamp, namespace string"
        own = self.spark.read.schema(kind).parquet(f"{self.folder}/due/generation={g}").where(F.col("namespace") == unit["namespace"])
        return own if unit["first"] is None else own.where(F.col("doc_id").between(unit["first"], unit["last"]))

    def _rows_of(self, cluster: str, ns: str, df: DataFrame, ids: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """A table's rows with these keys (column key: texts): of the files that hold any, by plain key columns where the keys' types can be read back, else by their texts."""
        index = keyindex.KeyIndex(self.spark, f"{self.folder}/index/{cluster}/{ns}", self._index_locks[cluster, ns])  # units of one table work side by side
        df = keyindex.narrowed(df, index, ids, key, self.options.indexed_files)
        few = diff.restricted_rows(df, ids, key)
        return few if few is not None else df.join(ids.select("key").distinct(), keys.key_text(df, key) == F.col("key"), "left_semi")

    def _shaped(self, rows: DataFrame, g: int, src_ts: Column | None = None, dst_ts: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("struct<t:bigint,i:int>")
        every = rows.withColumns({"generation": F.lit(g), "src_ts": none if src_ts is None else src_ts, "dst_ts": none if dst_ts is None else dst_ts})
        return every.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MISMATCHES.fields))

    def _work_unit(self, g: int, unit: dict, moment: Column) -> None:
        """Compares one range of one table, or rechecks some of its documents, writes its mismatches and its audit row, and notes that it is whole. Work whose files changed meanwhile is done anew."""
        done = f"{self.folder}/done/generation={g}/{unit['unit']}"
        if store.exists(self.spark, done):
            return
        src, dst = self.src.read(unit["namespace"]), self.dst.read(unit["to"])
        pinned = store.Pinned(self.spark, src, dst)
        try:
            self._compare_unit(g, unit, moment, src, dst)
        except Exception as e:
            if changed := pinned.changed():
                raise TransientError(f"files changed while they were read: {changed[0]}") from e
            raise
        if changed := pinned.changed():
            raise TransientError(f"files changed while they were read: {changed[0]}")
        self.fence.own()
        store.touch(self.spark, done)

    def _compare_unit(self, g: int, unit: dict, moment: Column, src: DataFrame, dst: DataFrame) -> None:
        ns, to = unit["namespace"], unit["to"]
        key = self.src.key_of(ns, self.options.keys)
        scratch = f"{self.folder}/scratch/{g}-{unit['unit']}"
        written = lambda df, name: store.kept(df, f"{scratch}/{name}")
        times, prior = {"src_ts": None, "dst_ts": None}, None
        if g:
            known = self._known(g, unit)
            times = known.agg(F.max("src_ts").alias("src_ts"), F.max("dst_ts").alias("dst_ts")).first().asDict(recursive=True)
            prior = known.where("first_mismatch_time is not null").select(F.col("doc_id").alias("id"), "first_mismatch_time")
            ids, whole = known.select(F.col("doc_id").alias("key")), (src, dst)
            # The rows are few by the units' bounds. They are read once, and what follows reads them from here.
            src, dst = (written(self._rows_of(c, n, df, ids, key), c) for c, n, df in ((SRC, ns, src), (DST, to, dst)))
            self._check_lost(prior, (src, dst), whole, key)
        else:
            src, dst = self._inside(src, key, unit), self._inside(dst, key, unit)
        made, seen = [diff.documents(x, key, filter=self.options.filter) for x in (src, dst)], Observation()
        rows = diff.compare(*made, self.options.method, natural=self.options.natural, settle=written, seen=seen)
        aged = diff.aged(rows, moment, prior)
        own = aged.select(F.lit(TaskType.DOCUMENTS.value).alias("task_type"), F.lit(f"{g}-{unit['unit']}-{ns}").alias("task_id"), *aged.columns, F.lit(ns).alias("namespace"))
        store.replace_part(self._shaped(own, g), f"{self.folder}/mismatches", g, unit["unit"])
        differs = not self.spark.read.parquet(f"{self.folder}/mismatches/generation={g}/unit={unit['unit']}").isEmpty()
        self._task(g, unit["unit"], TaskType.DOCUMENTS, Status.FAILED if differs else Status.COMPLETED, ns, to, unit["lower"], unit["upper"], *self._counted(seen, made[0]), times["src_ts"], times["dst_ts"])
        store.delete(self.spark, scratch)

    @staticmethod
    def _counted(seen: Observation, docs: DataFrame) -> tuple[int, int]:
        """Documents and bytes that were seen on the way. An execution that found no rows at all may leave no observation behind; then they are counted."""
        try:
            found = seen.get
        except Py4JError:
            found = {}
        if "documents" not in found:
            found = partitioning.stats(docs, F.col("size")).first()
        return found["documents"], found["bytes"]

    def _check_lost(self, prior: DataFrame, few: tuple[DataFrame, DataFrame], whole: tuple[DataFrame, DataFrame], key: tuple[str, ...]) -> None:
        """Documents that were found to differ and that neither side has now were deleted on both. If either side still has one by its key's text, they were looked for in the wrong way, and that is an error."""
        found = few[0].select(keys.key_text(few[0], key).alias("id")).union(few[1].select(keys.key_text(few[1], key).alias("id")))
        lost = prior.select("id").join(found, "id", "left_anti")
        if lost.isEmpty():
            return
        for df in whole:
            still = df.select(keys.key_text(df, key).alias("id")).join(lost, "id", "left_semi").first()
            if still is not None:
                raise RuntimeError(f"a recheck didn't find the document {still['id']}, which is there")

    def _task(self, g: int, unit: str, kind: TaskType, status: Status | str, ns: str, to: str, lower, upper, n: int, size: int, src_ts, dst_ts) -> None:
        text = lambda x: None if x is None else str(x)
        status = status.value if isinstance(status, Status) else status
        row = (f"{g}-{kind.value}-{ns}-{unit}", kind.value, status, g, ns, to, text(lower), text(upper), None, n, n, size, src_ts, dst_ts)
        store.replace_part(self.spark.createDataFrame([row], TASKS).coalesce(1), f"{self.folder}/tasks", g, f"{unit}-{kind.value}")

    def run_generation(self, now: datetime | None = None) -> dict:
        """Works one generation through; returns its counts of mismatch rows by class."""
        self.fence.own()
        self.running, self.began = True, time.monotonic()
        try:
            return self._work(self.generation(), now or datetime.now(timezone.utc))
        finally:
            self.running = False

    def _work(self, g: int, now: datetime) -> dict:
        moment, retry = F.lit(now), lambda work: Retry().run(work)
        plan = retry(lambda: self._plan(g, moment))
        with ThreadPoolExecutor(max(1, self.options.workers)) as pool:
            left = {pool.submit(retry, lambda u=u: self._work_unit(g, u, moment)) for u in plan["units"]}
            try:
                while left:
                    ended, left = wait(left, timeout=1.0, return_when="FIRST_EXCEPTION")
                    for work in ended:
                        work.result()
                    self._look_at_feeds()  # a feed that fails ends the work at once
            except BaseException:
                for work in left:
                    work.cancel()
                raise
        mine = self.mismatches().where((F.col("generation") == g) & (F.col("task_type") == TaskType.DOCUMENTS.value))
        store.replace_generation(recheck.from_mismatches(mine, g), f"{self.folder}/rechecks", g + 1)
        self._record_metadata(g, plan)
        return classify.counts(mine).first().asDict()

    def _record_metadata(self, g: int, plan: dict) -> None:
        """Audit rows of the tables' metadata, with the totals of their documents."""
        docs = self.tasks().where((F.col("generation") == g) & (F.col("type") == TaskType.DOCUMENTS.value))
        totals = docs.groupBy("namespace").agg(F.sum("documents_count").alias("n"), F.sum("source_bytes_count").alias("b"))
        known = self.spark.createDataFrame(list(plan["status"].items()), "namespace string, status string").coalesce(1)
        null = lambda kind: F.lit(None).cast(kind)
        shaped = known.join(totals, "namespace", "left").select(
            F.concat_ws("-", F.lit(g), F.lit(TaskType.COLLECTION.value), "namespace").alias("task_id"), F.lit(TaskType.COLLECTION.value).alias("type"), "status", F.lit(g).alias("generation"), "namespace", F.col("namespace").alias("to_namespace"),
            null("string").alias("lower"), null("string").alias("upper"), null("array<string>").alias("ids"), F.col("n").alias("documents_count"), F.col("n").alias("found_source_documents_count"), F.col("b").alias("source_bytes_count"),
            null("struct<t:bigint,i:int>").alias("src_ts"), null("struct<t:bigint,i:int>").alias("dst_ts"),
        )
        store.replace_part(shaped, f"{self.folder}/tasks", g, META)

    def recheck_tasks(self, generation: int) -> DataFrame:
        """namespace, task, ids, bytes, lower, upper: how the queue of a generation falls into tasks limited by ids, bytes of ids, and bytes of documents."""
        rows = recheck.reduced(self.queue(generation)).select(F.concat_ws(".", "db", "coll").alias("namespace"), "doc_id", "data_size")
        o = self.options
        return recheck.tasks(recheck.greedy(rows, o.recheck_ids, o.recheck_id_bytes, o.partition_bytes))

    def finish_generation(self, last: bool | None = None) -> int:
        """Drops the generation's consumed queue, after all it led to is written, and moves on. Change batches wait meanwhile. last: whether the next one is the last; without it, if writes are off."""
        with self._queue_lock:
            state = self.state.read()
            g = state["generation"]
            moved = self.state.write(generation=g + 1, last=state["writes_off"] if last is None else last, started=True)["generation"]
        if g:
            for kind in ("rechecks", "changes", "due"):
                store.delete(self.spark, f"{self.folder}/{kind}/generation={g}")
        return moved

    def writes_off(self, final: dict[str, tuple[int, int]] | None = None) -> None:
        """Says that both sides are still. Once only. final: the logical time of each cluster's last write, to which its feed must come."""
        with self._queue_lock:  # the state is read and written at once
            if self.state.read()["writes_off"]:
                raise RuntimeError("writes are off already")
            self.state.write(writes_off=True, final={c: list(t) for c, t in (final or {}).items()})
        self._still.set()

    def run(self, most: int | None = None) -> dict:
        """Generations until the last one, which is the one after writes went off and the feeds were drained. Without feeds a run also ends when nothing is left to recheck."""
        counts: dict = {}
        self.follow()
        try:
            while most is None or most > 0:
                began = datetime.now(timezone.utc)
                counts = self.run_generation()
                self._look_at_feeds()
                state = self.state.read()
                if state["writes_off"] and not state["last"]:
                    self.drain()
                g = self.finish_generation(state["writes_off"])
                log.info(self.report((datetime.now(timezone.utc) - began).total_seconds()))
                if state["last"] or (not self._feeds() and self.queue(g).isEmpty() and not self.state.read()["writes_off"]):
                    break
                most = None if most is None else most - 1
                self._still.wait(self.options.pause_seconds)  # documents in flight have time to arrive, unless writes are off
        finally:
            self.unfollow()
        return counts

    # Reports.

    def reported(self, min_seconds: float = 0) -> DataFrame:
        """Mismatches of the last whole generation."""
        g = classify.reported_generation(self.generation(), min_seconds)
        rows = self.mismatches().where(F.lit(False) if g is None else F.col("generation") == g)
        return rows.where(classify.at_least(min_seconds)) if min_seconds else rows

    def doc_mismatches(self, min_seconds: float = 0) -> DataFrame:
        return classify.document_rows(classify.by_age(self.reported(min_seconds).where(F.col("task_type") == TaskType.DOCUMENTS.value)))

    def ns_mismatches(self, tolerances: tuple[str, ...] | None = None) -> DataFrame:
        own = self.reported().where(F.col("task_type") == TaskType.COLLECTION.value)
        return classify.namespace_rows(classify.without_tolerated(own, self.options.index_tolerances if tolerances is None else tolerances))

    def progress(self) -> dict:
        """Phase, generation, totals, task counts and the longest mismatch."""
        g = self.generation()
        shown = max(0, g - 1) if not self.running else g
        tasks = self.tasks().where(F.col("generation") == shown)
        totals = statistics.total_progress(statistics.namespace_progress(tasks, shown), ended=not self.running).first().asDict()
        longest = classify.longest(self.mismatches().where(F.col("task_type") == TaskType.DOCUMENTS.value), g).first()
        last = statistics.last_rechecked(self.tasks()).first().asDict(recursive=True)
        feeds = {r["cluster"]: r.asDict(recursive=True) for r in statistics.feed_totals(self.event_counts()).collect()}  # two rows at most
        return {
            "phase": self.phase().value, "generation": g, "generationStats": totals, "verificationStatus": statistics.status_counts(tasks, shown).first().asDict(), "totalRechecks": statistics.rechecks_done(self.tasks()).first()[0],
            "longestDocMismatch": longest and {"namespace": longest["namespace"], "id": longest["id"], "durationSecs": longest["duration_ms"] / 1000}, "srcLastRecheckedTS": last["src_ts"], "dstLastRecheckedTS": last["dst_ts"],
            "srcChangeStats": self._feed_stats(SRC, feeds), "dstChangeStats": self._feed_stats(DST, feeds),
        }

    def _feed_stats(self, cluster: str, totals: dict) -> dict:
        """Counts of a feed's events, how fast they are handled, and how far behind now that is."""
        own, recent = totals.get(cluster), self.rates[cluster].items
        rates = recent[-1] if recent else {}
        last = own and own["last"]
        return {
            "totalEvents": {k: v for k, v in (own or {}).items() if k not in ("cluster", "last")}, "eventsPerSecond": rates.get("processed_rows_per_second"), "bufferSaturation": rates.get("saturation"), "lastHandledTS": last,
            "lagSecs": changes.lag_seconds(int(datetime.now(timezone.utc).timestamp()), last["t"]) if last else None,
        }

    def document_counts(self) -> str:
        """How many documents pass the filter on each side, by namespace of the source: a count of each table."""
        passed = lambda df: None if self.options.filter is None else filters.condition(self.options.filter, df.schema)
        pairs = self._pairs()
        counted = lambda df: catalog.count(df, passed(df))
        src = {ns: counted(self.src.read(ns)) for ns, _ in pairs if ns in self.src.tables}
        dst = {ns: counted(self.dst.read(to)) for ns, to in pairs if to in self.dst.tables}
        return reports.document_counts(src, dst)

    def report(self, seconds: float) -> str:
        """What a generation's end says: mismatches, progress by namespace, change events, and how the feeds keep up."""
        g = max(0, self.generation() - 1)
        rows, tasks = self.reported(), self.tasks()
        docs = rows.where(F.col("task_type") == TaskType.DOCUMENTS.value)
        by_namespace = statistics.namespace_progress(tasks, g)
        totals = statistics.total_progress(by_namespace, ended=True).first().asDict()
        found = classify.counts(docs).first()
        counted = self.event_counts()
        events = {r["cluster"]: r.asDict(recursive=True) for r in statistics.feed_totals(counted).collect()}  # two rows at most
        last = statistics.last_rechecked(tasks).first().asDict(recursive=True)
        lines = [
            reports.metadata_mismatches(rows.where(F.col("task_type") == TaskType.COLLECTION.value), self.options.index_tolerances),
            reports.document_mismatches(docs, g, self.options.failure_display_size),
            reports.progress(by_namespace),
            reports.generation_end(totals, g, seconds),
        ]
        if self._feeds():
            lines.append(reports.change_events(counted))
            for cluster, time in ((SRC, last["src_ts"]), (DST, last["dst_ts"])):
                stats = self._feed_stats(cluster, events)
                lines += reports.reader_status(cluster, {"processed_rows_per_second": stats["eventsPerSecond"], "saturation": stats["bufferSaturation"]}, stats["lagSecs"], time and str(time["t"]))
            warning = self._warning.text(datetime.now(timezone.utc).timestamp(), sum(e["ddl"] for e in events.values()))
            lines += [warning] if warning else []
        if log.isEnabledFor(logging.DEBUG):
            lines.append(reports.workers(self.spark))
        oldest = docs.agg(F.max("duration_ms")).first()[0] or 0
        lines.append(reports.status(found["documents"] > 0, oldest / 1000, rows.count() > docs.count(), False, bool(events), self.state.read()["writes_off"]))
        return "\n".join(lines)

    def summary(self, min_seconds: float = 0) -> dict:
        """Progress with counts of mismatches by class and namespace; the age filter is for documents only."""
        docs = classify.summary(self.reported(min_seconds).where(F.col("task_type") == TaskType.DOCUMENTS.value)).collect()  # a row a namespace
        progress = self.progress()
        return progress | {
            "docMismatches": {"total": next((r["n"] for r in docs if r["namespace"] is None and r["class"] is None), 0), "byType": {r["class"]: r["n"] for r in docs if r["class"]}, "byNamespace": {r["namespace"]: r["n"] for r in docs if r["namespace"]}},
            "nsMismatches": self.ns_mismatches().count(), "etaSecs": self._eta(progress["phase"]),
        }

    def _units(self) -> tuple[int, int]:
        """What is left of this generation's units and what is whole: bytes of their tables, or units if a table's bytes aren't known."""
        g = self.generation()
        noted = store.text(self.spark, f"{self.folder}/plans/{g}.json")
        units = json.loads(noted)["units"] if noted else []
        whole = set(store.names(self.spark, f"{self.folder}/done/generation={g}"))
        known = all(u.get("bytes") for u in units)
        done = sum(u["bytes"] if known else 1 for u in units if u["unit"] in whole)
        return sum(u["bytes"] if known else 1 for u in units) - done, done

    def _eta(self, phase: str) -> float | None:
        """Seconds until the first check is done, by how long what is whole took."""
        left, done = self._units()
        passed = time.monotonic() - self.began if self.began is not None else 0.0
        return statistics.eta_seconds(phase, left, done / passed if passed > 0 else 0.0)
