"""Change feeds: two formats of events become one, and events become rechecks.

Everything works on streaming and on batch frames alike.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from contextlib import AbstractContextManager, nullcontext

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from concord.functions import namespaces
from concord.model import DDL_OPS, DEFAULT_SIZE, DOCUMENT_OPS, EVENTS, RECHECKS, DdlPolicy

#: A feed event: ns, operation, key (all its fields, as plain texts), size of the full document (or the document itself) and logical time.
FEED = "operationType string, ns struct<db:string,coll:string>, documentKey map<string,string>, fullDocument string, fullDocLen bigint, clusterTime struct<t:bigint,i:int>"

#: An operation-log entry: op is i, u, d, c or n; o and o2 hold ids; applyOps nests entries.
_OP = "op:string,ns:string,o:struct<_id:string>,o2:struct<_id:string>,docLen:bigint,isReplacement:boolean"
LOG = f"op string, ts struct<t:bigint,i:int>, ns string, o struct<_id:string>, o2 struct<_id:string>, docLen bigint, isReplacement boolean, cmdName string, applyOps array<struct<{_OP}>>"

#: An event that says nothing but how far a feed has come.
NOOP = "noop"

#: Letters of the operation log.
LETTERS = {"i": "insert", "u": "update", "r": "replace", "d": "delete"}
#: Commands of the log by which an index is built, which say nothing new.
IGNORED_COMMANDS = ("startIndexBuild", "abortIndexBuild", "commitIndexBuild")


def _key_of(key: Column) -> Column:
    """The id of a key of the one field _id; of any other key all its fields, as JSON."""
    return F.when((F.size(key) == 1) & F.map_contains_key(key, "_id"), F.try_element_at(key, F.lit("_id"))).when(F.size(key) > 0, F.to_json(key))


def from_feed(feed: DataFrame, cluster: str, only: Sequence[str] | None = None, *, marks: bool = False) -> DataFrame:
    """Events of a change feed. marks: with those that only say how far the feed has come. The document itself is replaced by its length at once. only: namespaces; others are dropped. User filters don't apply here: a document may enter or leave them."""
    has = F.col("fullDocument").isNotNull() | F.col("fullDocLen").isNotNull()
    made = feed.select(
        F.lit(cluster).alias("cluster"), F.col("operationType").alias("op_type"), F.col("ns.db").alias("db"), F.col("ns.coll").alias("coll"), (_key_of(F.col("documentKey")) if isinstance(feed.schema["documentKey"].dataType, T.MapType) else F.col("documentKey._id")).alias("doc_id"),
        F.coalesce("fullDocLen", F.octet_length("fullDocument").cast("long")).alias("full_doc_len"), has.alias("has_doc"), F.col("clusterTime").alias("cluster_time"),
    )
    noop = F.col("op_type") == NOOP
    return _of_namespaces(made.where(~noop), only).unionByName(made.where(noop)) if marks else _of_namespaces(made.where(~F.coalesce(noop, F.lit(False))), only)


def _of_namespaces(events: DataFrame, only: Sequence[str] | None) -> DataFrame:
    own = events.where(namespaces.is_user(F.concat_ws(".", "db", "coll")))
    return own if only is None else own.where(F.concat_ws(".", "db", "coll").isin(*only) | ~F.col("op_type").isin(*DOCUMENT_OPS))


def _op_type(op: Column, replacement: Column) -> Column:
    letter = F.when((op == "u") & F.coalesce(replacement, F.lit(False)), "r").otherwise(op)
    out = letter
    for a, b in LETTERS.items():
        out = F.when(letter == a, b).otherwise(out)
    return out


def from_log(log: DataFrame, cluster: str, only: Sequence[str] | None = None, *, marks: bool = False) -> DataFrame:
    """Events of an operation log. Transactions and vectored writes are flattened, their entries filtered within; an update that carries a whole document is a replace."""
    nested = F.col("cmdName") == "applyOps"
    wanted = lambda ns: (F.lit(True) if only is None else ns.isin(*only)) & namespaces.is_user(ns)
    entry = lambda e, cmd: F.struct(
        F.when(cmd.isNotNull(), cmd).otherwise(_op_type(e["op"], e["isReplacement"])).alias("op_type"), e["ns"].alias("ns"), F.coalesce(e["o2"]["_id"], e["o"]["_id"]).alias("doc_id"), e["docLen"].alias("len")
    )
    flat = F.transform(F.filter(F.coalesce("applyOps", F.array().cast(f"array<struct<{_OP}>>")), lambda e: e["op"].isin(*"iud") & wanted(e["ns"])), lambda e: entry(e, F.lit(None).cast("string")))
    own = F.struct(*(F.col(c) for c in ("op", "ns", "o", "o2", "docLen", "isReplacement")))
    alone = F.array(entry(own, F.when(F.col("op") == "c", F.col("cmdName"))))
    ops = F.when(nested, flat).otherwise(alone)
    kept = log.where(F.col("op") != "n").where(~F.coalesce(F.col("cmdName").isin(*IGNORED_COMMANDS), F.lit(False)))
    made = kept.select("ts", F.explode(ops).alias("e")).where((F.col("e.op_type").isin(*DOCUMENT_OPS) & wanted(F.col("e.ns"))) | (~F.col("e.op_type").isin(*DOCUMENT_OPS) & ~F.col("e.ns").startswith("config.")))
    whole = F.col("e.op_type").isin("insert", "replace")
    out = made.select(
        F.lit(cluster).alias("cluster"), "e.op_type", namespaces.database(F.col("e.ns")).alias("db"), namespaces.collection(F.col("e.ns")).alias("coll"), "e.doc_id",
        F.when(whole, F.col("e.len")).alias("full_doc_len"), whole.alias("has_doc"), F.col("ts").alias("cluster_time"),
    )
    if not marks:
        return out
    none = lambda kind: F.lit(None).cast(kind)
    still = log.where(F.col("op") == "n").select(
        F.lit(cluster).alias("cluster"), F.lit(NOOP).alias("op_type"), none("string").alias("db"), none("string").alias("coll"), none("string").alias("doc_id"), none("long").alias("full_doc_len"), F.lit(False).alias("has_doc"), F.col("ts").alias("cluster_time"),
    )
    return out.unionByName(still)


def read(spark: SparkSession, path: str, kind: str = "feed", *, streaming: bool = True, max_files: int | None = None) -> DataFrame:
    """JSON files of events, as a stream or a table. max_files bounds what one micro-batch takes in."""
    schema = {"feed": FEED, "log": LOG}[kind]
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


class SchemaChange(RuntimeError):
    """A schema event that the policy doesn't let pass."""


def schema_events(events: DataFrame) -> DataFrame:
    return events.where(~F.col("op_type").isin(*DOCUMENT_OPS, NOOP))


def fatal(events: DataFrame, policy: DdlPolicy, allowed_until: tuple[int, int] | None = None) -> DataFrame:
    """Schema events that end the run: of the source, those not on the list with warnMost, all with fail. Those up to allowed_until are old news."""
    found = schema_events(events).where(F.col("cluster") == "srcClient")
    if policy is DdlPolicy.WARN_MOST:
        found = found.where(~F.col("op_type").isin(*DDL_OPS))
    if allowed_until is not None:
        found = found.where(F.col("cluster_time") > F.struct(F.lit(allowed_until[0]).cast("long").alias("t"), F.lit(allowed_until[1]).alias("i")))
    return found


def size_of(events_len: Column, has_doc: Column) -> Column:
    """What an event's document counts: its length if told, a fixed size if there is no document."""
    return F.when(events_len > 0, events_len).when(~has_doc, F.lit(DEFAULT_SIZE)).otherwise(F.coalesce(events_len, F.lit(0))).cast("int")


def rechecks(events: DataFrame, generation: int | Column, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rechecks of document events, under the source's names. mapping: source namespace to destination namespace."""
    own = events.where(F.col("op_type").isin(*DOCUMENT_OPS))
    named = own.withColumn("namespace", F.concat_ws(".", "db", "coll"))
    if mapping:
        dst = namespaces.remap(named.where(F.col("cluster") == "dstClient"), mapping)
        named = named.where(F.col("cluster") != "dstClient").unionByName(dst)
    ns = F.col("namespace")
    return named.select(
        (generation if isinstance(generation, Column) else F.lit(generation)).cast("int").alias("generation"), namespaces.database(ns).alias("db"), namespaces.collection(ns).alias("coll"), "doc_id",
        size_of(F.col("full_doc_len"), F.col("has_doc")).alias("data_size"), F.col("cluster_time").alias("change_op_time"), (F.col("cluster") == "dstClient").alias("from_dst"),
        F.lit(None).cast("timestamp").alias("first_mismatch_time"),
    )


#: Batches whose generation and counts are kept for a replay (a stream replays none that is older), and batches of one generation that are folded into one table.
REMEMBERED, FOLDED = 100, 64


def by_document(queued: DataFrame) -> DataFrame:
    """Rechecks with one row for each document and side, whatever its events: the latest of them, and the greatest size."""
    key = ["db", "coll", "doc_id", "from_dst"]
    return queued.groupBy(*key).agg(F.max("data_size").alias("data_size"), F.max("change_op_time").alias("change_op_time"), F.min("first_mismatch_time").alias("first_mismatch_time")).select(
        "db", "coll", "doc_id", "data_size", "change_op_time", "from_dst", "first_mismatch_time"
    )


class RecheckWriter:
    """foreachBatch: each batch's rechecks go to the generation after the one that holds when it begins, under a folder of the batch's own, a row a document and side.

    Where a batch goes is noted before it is written, and that it is written after that. A whole batch that is replayed overwrites what it wrote,
    in the generation it first had; one that was cut off goes to a generation that isn't read yet. Offsets are committed after that, so no event is lost.
    The notes of a feed are one file. Its counts are one small table after each batch, made of the one before and the batch; the last REMEMBERED are kept. Every FOLDED batches, those of a generation become one table,
    in which a document has one row again. So the number of files doesn't grow with the number of batches.
    lock: held meanwhile, so that the generation doesn't move on in the middle of a batch. once: without it, each event is a row, and no batches are folded.
    """

    def __init__(
        self, folder: str, generation, feed: str, policy: DdlPolicy = DdlPolicy.FAIL, mapping: Mapping[str, str] | None = None, allowed_until: tuple[int, int] | None = None, lock: AbstractContextManager | None = None,
        once: bool = True,
    ):
        self.once = once
        self.folder, self.generation, self.feed, self.policy, self.mapping, self.allowed_until = folder.rstrip("/"), generation, feed, policy, mapping, allowed_until
        self.lock = lock or nullcontext()

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        from concord.sources import store

        spark = events.sparkSession
        events = events.persist(StorageLevel.DISK_ONLY)  # read once, used three times
        try:
            if bad := fatal(events, self.policy, self.allowed_until).first():
                raise SchemaChange(f"{bad['op_type']} on {bad['db']}.{bad['coll']}")
            with self.lock:
                notes = self._notes(spark)
                first, done = notes.get(str(batch_id), (None, False))
                now = self.generation() + 1
                generation = now if first is None else first
                if first is not None and not done and generation < now:
                    store.delete(spark, self._place(generation, batch_id))
                    generation = now
                self._note(spark, notes, batch_id, generation, False)
                queued = rechecks(events, generation, self.mapping).drop("generation")
                (by_document(queued) if self.once else queued).write.mode("overwrite").parquet(self._place(generation, batch_id))
                self._count(events, batch_id)
                self._note(spark, notes, batch_id, generation, True)
                if first is None and self.once:
                    self._fold(spark, generation, batch_id)
        finally:
            events.unpersist()

    def _place(self, generation: int, batch: int | str) -> str:
        return f"{self.folder}/generation={generation}/batch={self.feed}-{batch}"

    def _notes(self, spark: SparkSession) -> dict[str, tuple[int, bool]]:
        from concord.sources import store

        found = store.text(spark, f"{self.folder}-noted/{self.feed}.json")
        return {k: tuple(v) for k, v in json.loads(found).items()} if found else {}

    def _note(self, spark: SparkSession, notes: dict, batch_id: int, generation: int, done: bool) -> None:
        from concord.sources import store

        notes[str(batch_id)] = (generation, done)
        kept = sorted(notes, key=int)[-REMEMBERED:]
        store.touch(spark, f"{self.folder}-noted/{self.feed}.json", json.dumps({k: notes[k] for k in kept}))

    def _count(self, events: DataFrame, batch_id: int) -> None:
        """Counts up to this batch: those up to the one before and its own."""
        from concord.operators.statistics import event_counts, folded_counts
        from concord.sources import store

        spark, root = events.sparkSession, f"{self.folder}-counts/{self.feed}"
        own, before = event_counts(events, latest=True), f"{root}/{batch_id - 1}"
        if store.exists(spark, before):
            own = folded_counts(own.unionByName(spark.read.parquet(before)))
        own.coalesce(1).write.mode("overwrite").parquet(f"{root}/{batch_id}")
        store.delete(spark, f"{root}/{batch_id - REMEMBERED}")

    def _fold(self, spark: SparkSession, generation: int, batch_id: int) -> None:
        """Makes one table of a generation's batches, now and then. What it was made of goes after it is whole; until then rows are there twice, which says nothing new."""
        from concord.sources import store

        if (batch_id + 1) % FOLDED:
            return
        folder = f"{self.folder}/generation={generation}"
        old = [f"{folder}/{n}" for n in store.names(spark, folder) if n.startswith(f"batch={self.feed}-") and n != f"batch={self.feed}-{batch_id}"]
        if len(old) > 1:
            by_document(spark.read.parquet(*old)).write.mode("overwrite").parquet(self._place(generation, f"upto-{batch_id}"))
            for path in old:
                store.delete(spark, path)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all events that a folder's writers have handled, by cluster and namespace: of each feed the table after its last batch."""
    from concord.operators.statistics import event_counts, folded_counts
    from concord.sources import store

    root = f"{folder.rstrip('/')}-counts"
    last = [f"{root}/{feed}/{max((n for n in store.names(spark, f'{root}/{feed}') if n.isdigit()), key=int)}" for feed in store.names(spark, root) if any(n.isdigit() for n in store.names(spark, f"{root}/{feed}"))]
    return folded_counts(spark.read.parquet(*last)) if last else event_counts(empty(spark), latest=True)


def mark(spark: SparkSession, folder: str, cluster: str) -> tuple[int, int] | None:
    """How far a cluster's feed has been handled: the latest logical time of its events, those that say nothing else among them."""
    found = counts(spark, folder).where(F.col("cluster") == cluster).agg(F.max("last")).first()[0]
    return None if found is None else (found["t"], found["i"])


def start(events: DataFrame, writer: RecheckWriter, checkpoint: str, *, until_now: bool = True, every: str = "1 second") -> StreamingQuery:
    """Follows a stream of events. until_now: ends when all that is there now is handled, as after the last write; the checkpoint resumes it."""
    stream = events.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if until_now else stream.trigger(processingTime=every)).start()


def lag_seconds(last_operation: int, last_handled: int) -> int:
    return max(0, last_operation - last_handled)


def rates(query: StreamingQuery) -> dict:
    """Rows a second and backlog of a running stream."""
    progress = query.lastProgress
    if not progress:
        return {"input_rows_per_second": None, "processed_rows_per_second": None, "saturation": None}
    asked, done = progress["inputRowsPerSecond"] or 0.0, progress["processedRowsPerSecond"] or 0.0
    return {"input_rows_per_second": asked, "processed_rows_per_second": done, "saturation": min(1.0, asked / done) if done else None}


def empty(spark: SparkSession, what: str = "events") -> DataFrame:
    return spark.createDataFrame([], {"events": EVENTS, "rechecks": RECHECKS}[what])
