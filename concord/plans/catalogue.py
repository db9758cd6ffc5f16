"""Named queries over the driver's tables, and what DuckDB says to the same question.

There is one copy of each table, so the destination is made by the drift rule (plans/drift.py), and tasks,
mismatches and change events are read out of the events table by rules that both engines state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import expressions as X
from concord.functions import filters, keys, namespaces
from concord.model import DdlPolicy
from concord.operators import classify, diff, metadata, partitioning, recheck, statistics
from concord.sources.catalog import Side
from concord.streaming import changes

from .drift import drifted, drifted_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return orders, drifted(orders, "o_orderkey", "o_totalprice", "o_orderstatus")


_REST = "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_ORDERS = f"d AS ({drifted_sql('orders', 'o_orderkey', _REST, 'o_totalprice', 'o_orderstatus')})"
_FIELDS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _rows_sql(src: str = "orders", dst: str = "d", join: str = "FULL OUTER") -> str:
    """Mismatch rows of orders against d."""
    fields = " UNION ALL ".join(f"SELECT s.o_orderkey, '{f}' AS field, 'Mismatch' AS details, 'dstClient' AS cluster FROM {src} s JOIN {dst} d USING (o_orderkey) WHERE s.{f} IS DISTINCT FROM d.{f}" for f in _FIELDS)
    extra = f" UNION ALL SELECT d.o_orderkey, '', 'Missing', 'srcClient' FROM {dst} d WHERE d.o_orderkey NOT IN (SELECT o_orderkey FROM {src})" if join != "LEFT" else ""
    return f"SELECT s.o_orderkey, '' AS field, 'Missing' AS details, 'dstClient' AS cluster FROM {src} s WHERE s.o_orderkey NOT IN (SELECT o_orderkey FROM {dst}){extra} UNION ALL {fields}"


_CLASS = "CASE WHEN details = 'Missing' AND field = '' THEN CASE cluster WHEN 'dstClient' THEN 'missingOnDst' ELSE 'extraOnDst' END ELSE 'contentDiffers' END"


@query(f"WITH {_ORDERS}, m AS ({_rows_sql()}) SELECT {_CLASS} AS class, count(*)::BIGINT AS n FROM m GROUP BY 1")
def doc_diff_summary(spark, sf_dir):
    src, dst = both_orders(spark, sf_dir)
    return diff.compare_columns(src, dst, ["o_orderkey"]).groupBy(classify.class_of().alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ORDERS} {_rows_sql()}")
def doc_diff_rows(spark, sf_dir):
    src, dst = both_orders(spark, sf_dir)
    return diff.compare_columns(src, dst, ["o_orderkey"])


@query(f"WITH {_ORDERS}, m AS ({_rows_sql()}) SELECT count(*) FILTER (k = 'contentDiffers')::BIGINT AS \"contentDiffers\", count(*) FILTER (k = 'missingOnDst')::BIGINT AS \"missingOnDst\", count(*) FILTER (k = 'extraOnDst')::BIGINT AS \"extraOnDst\", count(DISTINCT o_orderkey)::BIGINT AS documents FROM (SELECT *, {_CLASS} AS k FROM m)")
def mismatch_class_counts(spark, sf_dir):
    src, dst = both_orders(spark, sf_dir)
    return classify.counts(diff.compare_columns(src, dst, ["o_orderkey"]).withColumnRenamed("o_orderkey", "id"))


@query(f"WITH {_ORDERS} {_rows_sql(join='LEFT')}")
def doc_diff_natural(spark, sf_dir):
    """Only what the source has is looked for."""
    src, dst = both_orders(spark, sf_dir)
    return diff.compare_columns(src, dst, ["o_orderkey"], natural=True)


@query(f"WITH {_ORDERS}, a AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT * FROM d WHERE o_orderstatus = 'F') {_rows_sql('a', 'b')}")
def filtered_diff(spark, sf_dir):
    """The filter holds on each side for itself: a row whose status was lost is missing."""
    src, dst = both_orders(spark, sf_dir)
    return diff.compare_columns(src, dst, ["o_orderkey"], filter={"o_orderstatus": "F"})


_GENERIC = f"WITH {_ORDERS}, m AS ({_rows_sql()})"


@query(f"{_GENERIC} SELECT 'l' || o_orderkey || ';' AS id, '' AS field, min(details) AS details, min(cluster) AS cluster FROM (SELECT o_orderkey, CASE WHEN field = '' THEN 'Missing' ELSE 'Mismatch' END AS details, cluster FROM m) GROUP BY o_orderkey")
def hash_compare(spark, sf_dir):
    """Documents by hash and size only: one opaque row each."""
    src, dst = (diff.documents(x, ["o_orderkey"]) for x in both_orders(spark, sf_dir))
    return diff.compare(src, dst, "toHashedIndexKey").drop("data_size")


@query(f"{_GENERIC} SELECT 'l' || o_orderkey || ';' AS id, field, CASE WHEN field = 'o_orderstatus' THEN 'Mismatch : type mismatch: src=string, dst=null' ELSE details END AS details, cluster FROM m")
def unordered_compare(spark, sf_dir):
    """Whole documents, whatever their schema: types are told apart, and null from text."""
    src, dst = (diff.documents(x, ["o_orderkey"]) for x in both_orders(spark, sf_dir))
    return diff.compare(src, dst, "ignoreOrder").drop("data_size")


@query("SELECT 'l' || c_custkey || ';' AS id, CASE WHEN c_custkey % 3 = 0 THEN 'c_nationkey' ELSE '' END AS field, CASE WHEN c_custkey % 3 = 0 THEN 'Mismatch : type mismatch: src=int, dst=long' ELSE 'Mismatch : only field order differs' END AS details, 'dstClient' AS cluster FROM customer")
def binary_compare(spark, sf_dir):
    """A third of the documents differ in a number's type, the rest in the order of fields only."""
    customer = table(spark, sf_dir, "customer")
    third = F.col("c_custkey") % 3 == 0
    turned = ["c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey", "c_name"]
    same, other = customer.where(~third), customer.where(third)
    dst = same.select(*turned), other.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    src = diff.documents(customer, ["c_custkey"])
    found = diff.by_fields(diff.documents(dst[0], ["c_custkey"])).unionByName(diff.by_fields(diff.documents(dst[1], ["c_custkey"])))
    return diff.compare(src, found, "binary").drop("data_size")


@query(
    "WITH r AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM orders), f AS (SELECT part, min(o_orderkey) AS first FROM r GROUP BY part)"
    " SELECT part::INT AS part, CASE WHEN part > 0 THEN first END AS lower, lead(first) OVER (ORDER BY part) AS upper FROM f"
)
def partition_bounds(spark, sf_dir):
    return partitioning.bounds(table(spark, sf_dir, "orders"), "o_orderkey", 7)


@query(
    "WITH r AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM orders), f AS (SELECT part, min(o_orderkey) AS first FROM r GROUP BY part),"
    " b AS (SELECT part, CASE WHEN part > 0 THEN first END AS lower, lead(first) OVER (ORDER BY part) AS upper FROM f)"
    " SELECT part::INT AS part, lower, upper, count(o_orderkey)::BIGINT AS documents FROM b LEFT JOIN orders ON (lower IS NULL OR o_orderkey >= lower) AND (upper IS NULL OR o_orderkey < upper) GROUP BY ALL"
)
def partition_row_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return partitioning.counts(orders, "o_orderkey", partitioning.bounds(orders, "o_orderkey", 7))


@query("SELECT count(*)::BIGINT AS documents, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages")
def collection_stats(spark, sf_dir):
    return partitioning.stats(table(spark, sf_dir, "pages"), F.octet_length("html"))


_NS = "'db' || (user_id % 3) || '.c' || (user_id % 7)"


def _queue(spark, sf_dir) -> DataFrame:
    """Errors are mismatches, all else is an event of one side or the other."""
    e, error = table(spark, sf_dir, "events"), F.col("event_type") == "error"
    time = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 10).cast("int").alias("i"))
    return e.select(
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("db"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("coll"), F.col("user_id").cast("string").alias("doc_id"),
        (F.col("event_id") % 5000).cast("int").alias("data_size"), F.when(~error, time).alias("change_op_time"), (F.col("event_id") % 2 == 1).alias("from_dst"), F.when(error, F.col("ts").cast("timestamp")).alias("first_mismatch_time"),
    )


_QUEUE = "q AS (SELECT 'db' || (user_id % 3) AS db, 'c' || (user_id % 7) AS coll, user_id::VARCHAR AS doc_id, event_id % 5000 AS data_size, CASE WHEN event_type <> 'error' THEN (epoch_us(ts) // 1000000) * 100 + event_id % 10 END AS t, event_id % 2 = 1 AS from_dst, CASE WHEN event_type = 'error' THEN ts END AS first FROM events)"
_REDUCED = f"{_QUEUE}, r AS (SELECT db, coll, doc_id, max(data_size) AS data_size, max(t) FILTER (NOT from_dst) AS src, max(t) FILTER (from_dst) AS dst, CASE WHEN count(t) = 0 THEN min(first) END AS first FROM q GROUP BY ALL)"


@query(f"WITH {_REDUCED} SELECT db, coll, doc_id, data_size::BIGINT AS data_size, src AS src_op, dst AS dst_op, epoch_us(first) AS first_us FROM r")
def recheck_reduce(spark, sf_dir):
    """What the queue says of each document."""
    number = lambda c: F.col(f"{c}.t") * 100 + F.col(f"{c}.i")
    return recheck.reduced(_queue(spark, sf_dir)).select("db", "coll", "doc_id", F.col("data_size").cast("long").alias("data_size"), number("src_ts").alias("src_op"), number("dst_ts").alias("dst_op"), F.unix_micros("first_mismatch_time").alias("first_us"))


@query(
    f"WITH {_REDUCED}, n AS (SELECT *, row_number() OVER (PARTITION BY db || '.' || coll ORDER BY doc_id) - 1 AS k FROM r)"
    " SELECT db || '.' || coll AS namespace, (k // 100)::BIGINT AS chunk, count(*)::BIGINT AS ids, min(doc_id) AS lower, max(doc_id) AS upper FROM n GROUP BY ALL"
)
def recheck_chunks(spark, sf_dir):
    """Tasks of 100 ids at most."""
    rows = recheck.reduced(_queue(spark, sf_dir)).withColumn("namespace", F.concat_ws(".", "db", "coll"))
    return recheck.by_count(rows, "namespace", "doc_id", 100).groupBy("namespace", "chunk").agg(F.count(F.lit(1)).alias("ids"), F.min("doc_id").alias("lower"), F.max("doc_id").alias("upper"))


_OP = "CASE event_type WHEN 'view' THEN 'insert' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'replace' WHEN 'signup' THEN 'delete' ELSE 'create' END"


def _feed(spark, sf_dir) -> DataFrame:
    """The events as a change feed; errors are schema events."""
    kind = X.switch([(F.col("event_type") == a, b) for a, b in (("view", "insert"), ("click", "update"), ("purchase", "replace"), ("signup", "delete"))], "create")
    user = lambda n: (F.col("user_id") % n).cast("string")
    return table(spark, sf_dir, "events").select(
        kind.alias("operationType"), F.struct(F.concat(F.lit("db"), user(3)).alias("db"), F.concat(F.lit("c"), user(7)).alias("coll")).alias("ns"), F.struct(F.col("user_id").cast("string").alias("_id")).alias("documentKey"),
        F.when(kind.isin("insert", "replace"), F.col("props")).alias("fullDocument"), F.lit(None).cast("long").alias("fullDocLen"), F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.lit(1).alias("i")).alias("clusterTime"),
    )


@query(f"SELECT {_OP} AS op_type, 'db' || (user_id % 3) AS db, 'c' || (user_id % 7) AS coll, user_id::VARCHAR AS doc_id, CASE WHEN event_type IN ('view', 'purchase') THEN strlen(props) END::BIGINT AS full_doc_len, epoch_us(ts) // 1000000 AS t FROM events")
def change_feed_events(spark, sf_dir):
    return changes.from_feed(_feed(spark, sf_dir), "srcClient").select("op_type", "db", "coll", "doc_id", "full_doc_len", F.col("cluster_time.t").alias("t"))


@query(f"SELECT 'db' || (user_id % 3) AS db, 'c' || (user_id % 7) AS coll, user_id::VARCHAR AS doc_id, CASE WHEN event_type IN ('view', 'purchase') THEN strlen(props) ELSE 1024 END::INT AS data_size FROM events WHERE event_type <> 'error'")
def event_rechecks(spark, sf_dir):
    """Document events as rechecks; where the document isn't known a fixed size counts."""
    return changes.rechecks(changes.from_feed(_feed(spark, sf_dir), "srcClient"), 1).select("db", "coll", "doc_id", "data_size")


@query(
    f"SELECT {_NS} AS namespace, count(*) FILTER (event_type = 'view')::BIGINT AS \"insert\", count(*) FILTER (event_type = 'click')::BIGINT AS \"update\", count(*) FILTER (event_type = 'purchase')::BIGINT AS \"replace\","
    " count(*) FILTER (event_type = 'signup')::BIGINT AS \"delete\", count(*) FILTER (event_type = 'error')::BIGINT AS ddl, count(*)::BIGINT AS total FROM events GROUP BY 1"
)
def event_counts_by_ns(spark, sf_dir):
    return statistics.event_counts(changes.from_feed(_feed(spark, sf_dir), "srcClient")).drop("cluster")


@query(f"SELECT {_NS} AS namespace, count(*)::BIGINT AS total FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def busiest_namespaces(spark, sf_dir):
    return statistics.busiest(statistics.event_counts(changes.from_feed(_feed(spark, sf_dir), "srcClient")))


@query(f"SELECT {_OP} AS op_type, event_type = 'error' AS ddl, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def ddl_split(spark, sf_dir):
    """Schema events stand apart from those of documents."""
    events = changes.from_feed(_feed(spark, sf_dir), "srcClient")
    ddl = changes.schema_events(events).withColumn("ddl", F.lit(True))
    docs = events.where(F.col("op_type").isin("insert", "update", "replace", "delete")).withColumn("ddl", F.lit(False))
    return ddl.unionByName(docs).groupBy("op_type", "ddl").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS allowed, count(*)::BIGINT AS fatal FROM events WHERE event_type = 'error'")
def ddl_policy(spark, sf_dir):
    """Which schema events end a run: all of them, or with the milder policy none of these."""
    events = changes.from_feed(_feed(spark, sf_dir), "srcClient")
    one = lambda policy, allowed: changes.fatal(events, policy).select(F.lit(int(allowed)).cast("long").alias("allowed"), F.lit(int(not allowed)).cast("long").alias("fatal"))
    both = one(DdlPolicy.WARN_MOST, True).unionByName(one(DdlPolicy.FAIL, False))
    return both.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("allowed"), F.coalesce(F.sum("fatal"), F.lit(0)).alias("fatal"))


@query(
    "WITH u AS (SELECT l_orderkey, unnest(list({'op': CASE WHEN l_linenumber % 3 = 0 THEN 'd' WHEN l_linenumber % 3 = 1 THEN 'i' ELSE 'u' END, 'ns': CASE WHEN l_suppkey % 5 = 0 THEN 'config.x' ELSE 'db.c' || (l_suppkey % 4) END, 'id': l_partkey, 'r': l_returnflag = 'R'})) AS e FROM lineitem GROUP BY l_orderkey)"
    " SELECT l_orderkey AS t, CASE e.op WHEN 'd' THEN 'delete' WHEN 'i' THEN 'insert' ELSE CASE WHEN e.r THEN 'replace' ELSE 'update' END END AS op_type, substr(e.ns, 4) AS coll, e.id::VARCHAR AS doc_id FROM u WHERE e.ns <> 'config.x'"
)
def apply_ops_flatten(spark, sf_dir):
    """Each order is a transaction whose lines are its operations."""
    line = F.col("l_linenumber") % 3
    op = F.struct(
        F.when(line == 0, "d").when(line == 1, "i").otherwise("u").alias("op"), F.when(F.col("l_suppkey") % 5 == 0, "config.x").otherwise(F.concat(F.lit("db.c"), (F.col("l_suppkey") % 4).cast("string"))).alias("ns"),
        F.struct(F.col("l_partkey").cast("string").alias("_id")).alias("o"), F.lit(None).cast("struct<_id:string>").alias("o2"), F.lit(100).cast("long").alias("docLen"), (F.col("l_returnflag") == "R").alias("isReplacement"),
    )
    log = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(op).alias("applyOps"))
    none = lambda kind: F.lit(None).cast(kind)
    log = log.select(
        F.lit("c").alias("op"), F.struct(F.col("l_orderkey").alias("t"), F.lit(1).alias("i")).alias("ts"), F.lit("admin.$cmd").alias("ns"), none("struct<_id:string>").alias("o"), none("struct<_id:string>").alias("o2"), none("long").alias("docLen"),
        none("boolean").alias("isReplacement"), F.lit("applyOps").alias("cmdName"), "applyOps",
    )
    return changes.from_log(log, "srcClient").select(F.col("cluster_time.t").alias("t"), "op_type", "coll", "doc_id")


def _tasks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = X.switch([(F.col("event_type") == a, b) for a, b in (("view", "completed"), ("click", "added"), ("purchase", "processing"), ("signup", "failed"))], "mismatch")
    kind = F.when(F.col("event_id") % 97 == 0, "primary").when(F.col("event_id") % 5 == 0, "verifyCollection").otherwise("verifyDocuments")
    time = lambda n: F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % n).cast("int").alias("i"))
    return e.select(
        F.col("event_id").cast("string").alias("task_id"), kind.alias("type"), status.alias("status"), (F.col("event_id") % 2).cast("int").alias("generation"), F.concat(F.lit("db.c"), (F.col("user_id") % 7).cast("string")).alias("namespace"),
        (F.col("event_id") % 1000).alias("documents_count"), (F.col("event_id") % 900).alias("found_source_documents_count"), (F.col("event_id") % 5000).alias("source_bytes_count"), time(7).alias("src_ts"), time(11).alias("dst_ts"),
    )


_TASKS = (
    "t AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'primary' WHEN event_id % 5 = 0 THEN 'verifyCollection' ELSE 'verifyDocuments' END AS type, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'added' WHEN 'purchase' THEN 'processing' WHEN 'signup' THEN 'failed' ELSE 'mismatch' END AS status,"
    " event_id % 2 AS generation, 'db.c' || (user_id % 7) AS namespace, event_id % 1000 AS docs, event_id % 900 AS found, event_id % 5000 AS bytes, epoch_us(ts) // 1000000 AS s FROM events)"
)


@query(f"WITH {_TASKS} SELECT {', '.join(f'count(*) FILTER (status = {s!r})::BIGINT AS {s}' for s in ('added', 'processing', 'completed', 'failed', 'mismatch'))}, count(*)::BIGINT AS total FROM t WHERE generation = 0 AND type <> 'primary'")
def task_status_counts(spark, sf_dir):
    return statistics.status_counts(_tasks(spark, sf_dir), 0)


def _progress_sql(generation: int) -> str:
    docs, done = "type = 'verifyDocuments'", "status IN ('completed', 'failed')"
    s = lambda value, when: f"coalesce(sum({value}) FILTER ({when}), 0)::BIGINT"
    total = "type = 'verifyCollection'" if generation == 0 else docs
    return (
        f"WITH {_TASKS} SELECT namespace, {s('found', f'{docs} AND {done}')} AS \"docsCompared\", {s('docs', total)} AS \"totalDocs\", {s('bytes', f'{docs} AND {done}')} AS \"bytesCompared\", {s('bytes', 'type = ' + chr(39) + 'verifyCollection' + chr(39))} AS \"totalBytes\","
        f" {s('1', docs + ' AND status = ' + chr(39) + 'added' + chr(39))} AS \"partitionsAdded\", {s('1', docs + ' AND status = ' + chr(39) + 'processing' + chr(39))} AS \"partitionsProcessing\", {s('1', f'{docs} AND {done}')} AS \"partitionsDone\" FROM t WHERE generation = {generation} AND type <> 'primary' GROUP BY namespace"
    )


@query(_progress_sql(0))
def namespace_progress(spark, sf_dir):
    return statistics.namespace_progress(_tasks(spark, sf_dir), 0)


@query(_progress_sql(1))
def namespace_progress_rechecks(spark, sf_dir):
    return statistics.namespace_progress(_tasks(spark, sf_dir), 1)


@query(f"WITH p AS ({_progress_sql(0)}) SELECT sum(\"docsCompared\")::BIGINT AS \"docsCompared\", sum(\"totalDocs\")::BIGINT AS \"totalDocs\", sum(\"bytesCompared\")::BIGINT AS \"bytesCompared\", sum(\"totalBytes\")::BIGINT AS \"totalBytes\", count(*)::BIGINT AS \"totalNss\", count(*) FILTER (\"partitionsAdded\" + \"partitionsProcessing\" = 0 AND \"partitionsDone\" > 0)::BIGINT AS \"completedNss\", count(*) FILTER (\"partitionsAdded\" + \"partitionsProcessing\" > 0 AND \"partitionsDone\" + \"partitionsProcessing\" > 0)::BIGINT AS \"activeNss\" FROM p")
def total_progress(spark, sf_dir):
    return statistics.total_progress(statistics.namespace_progress(_tasks(spark, sf_dir), 0))


@query(f"WITH {_TASKS} SELECT max(s * 100 + event_id % 7) AS src, max(s * 100 + event_id % 11) AS dst FROM t WHERE type = 'verifyDocuments' AND status IN ('completed', 'failed')")
def last_rechecked_ts(spark, sf_dir):
    return statistics.last_rechecked(_tasks(spark, sf_dir)).select((F.col("src_ts.t") * 100 + F.col("src_ts.i")).alias("src"), (F.col("dst_ts.t") * 100 + F.col("dst_ts.i")).alias("dst"))


@query(f"WITH {_TASKS} SELECT coalesce(sum(docs), 0)::BIGINT AS documents FROM t WHERE generation > 0 AND type = 'verifyDocuments' AND status IN ('completed', 'failed')")
def total_rechecks(spark, sf_dir):
    return statistics.rechecks_done(_tasks(spark, sf_dir))


def _mismatches(spark, sf_dir) -> DataFrame:
    """Each event is a mismatch whose duration is its number, in a class by its kind."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.when(kind.isin("view", "click"), "").otherwise("f").alias("field"), F.when(kind.isin("view", "click", "signup"), "Missing").otherwise("Mismatch").alias("details"),
        F.when(kind == "click", "srcClient").otherwise("dstClient").alias("cluster"), F.concat(F.lit("db.c"), (F.col("user_id") % 7).cast("string")).alias("namespace"), (F.col("event_id") * 37 % 5000).alias("duration_ms"), (F.col("event_id") % 4).cast("int").alias("generation"),
    )


_MISMATCHES = "m AS (SELECT event_id::VARCHAR AS id, CASE WHEN event_type IN ('view', 'click') THEN '' ELSE 'f' END AS field, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'Missing' ELSE 'Mismatch' END AS details, CASE WHEN event_type = 'click' THEN 'srcClient' ELSE 'dstClient' END AS cluster, 'db.c' || (user_id % 7) AS namespace, event_id * 37 % 5000 AS duration_ms, event_id % 4 AS generation FROM events)"


@query(f"WITH {_MISMATCHES}, k AS (SELECT *, {_CLASS} AS class FROM m) SELECT class, id, duration_ms FROM k QUALIFY row_number() OVER (PARTITION BY class ORDER BY duration_ms DESC, id, field) <= 20")
def top_mismatches_per_class(spark, sf_dir):
    return classify.top(_mismatches(spark, sf_dir), 20).select("class", "id", "duration_ms")


@query(f"WITH {_MISMATCHES} SELECT id, duration_ms FROM m WHERE generation IN (2, 3) ORDER BY duration_ms DESC, id LIMIT 1")
def longest_mismatch(spark, sf_dir):
    return classify.longest(_mismatches(spark, sf_dir), 3).select("id", "duration_ms")


@query(f"WITH {_MISMATCHES} SELECT id, duration_ms FROM m WHERE duration_ms >= 2500")
def min_duration_filter(spark, sf_dir):
    return _mismatches(spark, sf_dir).where(classify.at_least(2.5)).select("id", "duration_ms")


@query(f"WITH {_MISMATCHES}, k AS (SELECT *, {_CLASS} AS class FROM m) SELECT namespace, id, CASE class WHEN 'contentDiffers' THEN 'content' ELSE class END AS type, nullif(field, '') AS field, CASE WHEN class = 'contentDiffers' THEN details END AS detail, duration_ms::BIGINT AS ms FROM k")
def doc_api_rows(spark, sf_dir):
    rows = classify.document_rows(_mismatches(spark, sf_dir))
    return rows.withColumn("ms", F.round(F.col("durationSecs") * 1000).cast("long")).drop("durationSecs")


@query(f"WITH {_MISMATCHES}, k AS (SELECT *, {_CLASS} AS class FROM m) SELECT namespace, class, count(*)::BIGINT AS n FROM k GROUP BY GROUPING SETS ((namespace), (class), ())")
def mismatch_summary(spark, sf_dir):
    return classify.summary(_mismatches(spark, sf_dir))


_ASPECT = ["type", "shard key", "index", "readOnly", ""]


@query(
    "WITH m AS (SELECT s_suppkey AS k, 'db.c' || s_suppkey AS namespace, CASE s_suppkey % 6 WHEN 5 THEN 'spec' WHEN 2 THEN 'x_1' ELSE '' END AS id, CASE s_suppkey % 6 WHEN 0 THEN 'type' WHEN 1 THEN 'shard key' WHEN 2 THEN 'index' WHEN 3 THEN 'readOnly' WHEN 4 THEN '' ELSE 'options.capped' END AS field, CASE WHEN s_nationkey % 2 = 0 THEN 'Missing' ELSE 'Mismatch' END AS details, CASE WHEN s_nationkey % 4 = 0 THEN 'srcClient' ELSE 'dstClient' END AS cluster FROM supplier)"
    " SELECT namespace, CASE WHEN details <> 'Missing' THEN 'content' WHEN cluster = 'srcClient' THEN 'extraOnDst' ELSE 'missingOnDst' END AS type, CASE WHEN id = 'spec' THEN 'spec' WHEN field = '' THEN 'exist' ELSE field END AS aspect, CASE WHEN id = 'spec' THEN field WHEN field = 'index' THEN id END AS component, CASE WHEN details <> 'Missing' THEN details END AS detail FROM m"
)
def ns_api_rows(spark, sf_dir):
    k = F.col("s_suppkey") % 6
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("db.c"), F.col("s_suppkey").cast("string")).alias("namespace"), F.when(k == 5, "spec").when(k == 2, "x_1").otherwise("").alias("id"),
        F.when(k == 0, "type").when(k == 1, "shard key").when(k == 2, "index").when(k == 3, "readOnly").when(k == 4, "").otherwise("options.capped").alias("field"),
        F.when(F.col("s_nationkey") % 2 == 0, "Missing").otherwise("Mismatch").alias("details"), F.when(F.col("s_nationkey") % 4 == 0, "srcClient").otherwise("dstClient").alias("cluster"),
    )
    return classify.namespace_rows(rows)


@query(
    f"WITH {_ORDERS}, m AS ({_rows_sql()}) SELECT o_orderkey, field, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 3600000 * (1 + o_orderkey % 24) END::BIGINT AS duration_ms FROM m"
)
def mismatch_ageing(spark, sf_dir):
    """Documents with odd keys were known to differ for hours before."""
    src, dst = both_orders(spark, sf_dir)
    now = F.timestamp_millis(F.lit(1_700_000_000_000))
    rows = diff.compare_columns(src, dst, ["o_orderkey"]).withColumn("id", F.col("o_orderkey"))
    prior = rows.where(F.col("id") % 2 != 0).select("id", F.timestamp_millis(F.lit(1_700_000_000_000) - 3_600_000 * (1 + F.col("id") % 24)).alias("first_mismatch_time")).distinct()
    return diff.aged(rows, now, prior).select("o_orderkey", "field", "duration_ms")


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_partkey % 53 <> 0 GROUP BY ALL)"
    " SELECT 'l' || l_orderkey || ';i' || l_linenumber || ';' AS id, (s.n - coalesce(d.n, 0))::BIGINT AS missing FROM s LEFT JOIN d USING (l_orderkey, l_linenumber) WHERE s.n > coalesce(d.n, 0)"
)
def duplicate_key_diff(spark, sf_dir):
    """Keys repeat: copies are paired by occurrence, and as many as one side has more are missing."""
    key = ["l_orderkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(*key, "l_partkey")
    src, dst = diff.documents(lines.select(*key), key), diff.documents(lines.where("l_partkey % 53 <> 0").select(*key), key)
    return diff.compare(src, dst).where(classify.missing_on_dst()).groupBy("id").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT (starts_with(p_name, 'small') OR starts_with(p_name, 'large') OR starts_with(p_name, 'red'))")
def exclude_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "part").where(namespaces.exclude_prefixes(F.col("p_name"), ["small", "large", "red"])).select("p_partkey", "p_name")


_INDEX_SQL = (
    "SELECT 'db.s' || (s_suppkey % 5) AS namespace, 'i' || s_suppkey AS id, 'index' AS field,"
    " CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'Missing' WHEN s_nationkey % 3 = 0 THEN '[{\"op\":\"replace\",\"path\":\"/expireAfterSeconds\",\"value\":\"' || (s_nationkey + 1) || '\"}]' END AS details,"
    " CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 11 = 0 THEN 'srcClient' ELSE 'dstClient' END AS cluster FROM supplier"
    " WHERE NOT (s_suppkey % 7 = 0 AND s_suppkey % 11 = 0) AND (s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 OR s_nationkey % 3 = 0)"
)


@query(_INDEX_SQL)
def index_style_map_diff(spark, sf_dir):
    """An index for each supplier; expiry differs for a third, background builds for all, which says nothing."""
    s = table(spark, sf_dir, "supplier")
    spec = lambda expiry, more: F.concat(F.lit('{"v":2,"key":{"a":1},'), F.lit(more), F.lit('"expireAfterSeconds":'), expiry.cast("string"), F.lit("}"))
    base = lambda df, e, more: df.select(F.concat(F.lit("db.s"), (F.col("s_suppkey") % 5).cast("string")).alias("namespace"), F.concat(F.lit("i"), F.col("s_suppkey").cast("string")).alias("name"), spec(e, more).alias("spec"))
    n = F.col("s_nationkey")
    src = base(s.where("s_suppkey % 11 <> 0"), n, "")
    dst = base(s.where("s_suppkey % 7 <> 0"), F.when(n % 3 == 0, n + 1).otherwise(n), '"background":true,')
    return metadata.compare_indexes(src, dst)


@query("SELECT 'db.s' || s_suppkey AS namespace, s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 AS comparable, CASE WHEN s_suppkey % 3 = 0 THEN 'type' ELSE 'options.capped' END AS field, CASE WHEN s_suppkey % 3 = 0 THEN 'Mismatch: src: collection, dst: view' ELSE 'Mismatch' END AS details FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 <> 0")
def spec_diff(spark, sf_dir):
    """A third of the tables is a view on the destination, half of the rest is capped there."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("db.s"), F.col("s_suppkey").cast("string")).alias("namespace"))
    src = s.select("namespace", F.lit("collection").alias("type"), F.lit(False).alias("read_only"), F.lit('{"capped":false,"size":1}').alias("options"))
    dst = s.select("namespace", F.when(F.col("s_suppkey") % 3 == 0, "view").otherwise("collection").alias("type"), F.lit(False).alias("read_only"), F.when(F.col("s_suppkey") % 2 == 0, '{"capped":false,"size":1}').otherwise('{"capped":true,"size":1}').alias("options"))
    found = metadata.compare_specs(src, dst)
    return found.select("namespace", "comparable", F.explode("rows").alias("r")).select("namespace", "comparable", "r.field", "r.details")


@query("SELECT 'db.s' || s_suppkey AS namespace, CASE WHEN s_suppkey % 5 = 0 THEN 'Missing' ELSE 'Mismatch: src={\"k\": 1}; dst={\"k\": \"hashed\"}' END AS details FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 4 = 0")
def shard_key_diff(spark, sf_dir):
    """1 and 1.0 are one key; a hashed one differs."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("db.s"), F.col("s_suppkey").cast("string")).alias("namespace"))
    src = s.select("namespace", F.lit('{"k": 1}').alias("key"))
    dst = s.where("s_suppkey % 5 <> 0").select("namespace", F.when(F.col("s_suppkey") % 4 == 0, '{"k": "hashed"}').otherwise('{"k":1.0}').alias("key"))
    return metadata.compare_shard_keys(src, dst).select("namespace", "details")


@query("WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events) SELECT 'l' || event_id || ';' AS id, 'props' AS field, CASE WHEN event_id % 13 = 0 THEN 'Mismatch : type mismatch: src=object, dst=null' ELSE 'Mismatch' END AS details FROM e WHERE event_id % 13 = 0 OR k % 10 = 0")
def nested_doc_diff(spark, sf_dir):
    """A nested object that differs is one row, of its top-level field."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    k = F.col("props.k")
    changed = F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.struct(F.when(k % 10 == 0, k + 1).otherwise(k).alias("k")))
    found = diff.compare(diff.documents(e, ["event_id"]), diff.documents(e.withColumn("props", changed), ["event_id"]))
    return found.select("id", "field", "details")


@query("SELECT vec_id, 'embedding' AS field, 'Mismatch' AS details, 'dstClient' AS cluster FROM embeddings WHERE vec_id % 10 = 0")
def array_doc_diff(spark, sf_dir):
    """Arrays keep their order: turned round they differ."""
    v = table(spark, sf_dir, "embeddings")
    dst = v.withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    return diff.compare_columns(v, dst, ["vec_id"])


@query("SELECT doc_id, 'text' AS field, 'Mismatch' AS details, 'dstClient' AS cluster FROM documents WHERE doc_id % 13 = 0")
def text_doc_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    dst = d.withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return diff.compare_columns(d, dst, ["doc_id"])


@query("SELECT conv_id, turn, '' AS field, 'Missing' AS details, 'dstClient' AS cluster FROM conversations WHERE (conv_id + turn) % 7 = 0")
def composite_key_missing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return diff.compare_columns(c, c.where("(conv_id + turn) % 7 <> 0"), ["conv_id", "turn"])


@query("SELECT event_id, CASE WHEN props IS NULL THEN 'z;' ELSE 'l' || event_id || ';l' || (props->>'$.k') || ';z;' END AS key FROM events")
def document_keys(spark, sf_dir):
    """Dotted paths descend; what isn't there is null."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return e.select("event_id", keys.key_text(e, ["event_id", "props.k", "props.k.none"]).alias("key"))


@query("WITH e AS (SELECT event_id, event_type, value, user_id FROM events) SELECT event_id FROM e WHERE (event_type IS DISTINCT FROM 'view') AND (value >= 10 OR user_id IN (1, 2, 3)) AND NOT coalesce(value > 100, false)")
def filter_compiler(spark, sf_dir):
    q = {"event_type": {"$ne": "view"}, "$or": [{"value": {"$gte": 10}}, {"user_id": {"$in": [1, 2, 3]}}], "value": {"$not": {"$gt": 100}}}
    return table(spark, sf_dir, "events").where(filters.condition(q)).select("event_id")


@query(
    "WITH s AS (SELECT DISTINCT 'db' || (user_id % 3) || '.' || event_type AS namespace FROM events), d AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN 'admin.x' WHEN 1 THEN 'db.system.views' WHEN 2 THEN 'db.system.buckets.b' ELSE 'local.x' END AS namespace FROM events)"
    " SELECT namespace FROM s UNION SELECT namespace FROM d WHERE namespace = 'db.system.buckets.b'"
)
def namespace_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("user_id") % 4
    src = e.select(F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string"), F.lit("."), "event_type").alias("namespace"))
    dst = e.select(F.when(n == 0, "admin.x").when(n == 1, "db.system.views").when(n == 2, "db.system.buckets.b").otherwise("local.x").alias("namespace"))
    return namespaces.union(src, dst)


@query("SELECT 'ns' || (user_id % 5) AS namespace, count(*)::BIGINT AS n FROM events GROUP BY 1")
def namespace_remap(spark, sf_dir):
    """Destination names become the source's."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("other"), (F.col("user_id") % 5).cast("string")).alias("namespace"))
    return namespaces.remap(e, {f"ns{i}": f"other{i}" for i in range(5)}).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(CASE WHEN ts > lo THEN user_id ELSE 0 END) * 1000.0 / (epoch_ms(max(hi)) - epoch_ms(max(lo))))::BIGINT AS per_second FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events)")
def event_rate(spark, sf_dir):
    """user_id stands for a count of events; the oldest sample only marks the time."""
    samples = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), F.col("user_id").alias("n"))
    return statistics.event_rate(samples).select(F.round("per_second").cast("long").alias("per_second"))


@query("SELECT user_id, max(event_id) AS last, list_slice(list(event_id ORDER BY event_id), 1, 3)::VARCHAR AS first3, list_slice(list(event_id ORDER BY event_id DESC), 1, 2)::VARCHAR AS top2, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def accumulators(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    i = F.col("event_id")
    return e.groupBy("user_id").agg(X.max_(i).alias("last"), text(X.first_n(i, i, 3)).alias("first3"), text(X.top_n(i, i, 2)).alias("top2"), X.sum_(i).alias("total"))


@query(
    "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 9 END AS sw, event_type IN ('view', 'error') AS isin, starts_with(event_type, 'pur') AS prefix, (event_id - user_id)::BIGINT AS sub,"
    " list_extract([event_id, user_id], -1) AS last, len(list_filter([event_id, user_id, 5], lambda x: x > 4))::INT AS kept FROM events"
)
def expression_builders(spark, sf_dir):
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    both = F.array("event_id", "user_id")
    return e.select(
        "event_id", X.switch([(X.eq(t, "view"), 1), (X.eq(t, "click"), 2)], 9).alias("sw"), X.in_(t, ["view", "error"]).alias("isin"), X.has_prefix(t, "pur").alias("prefix"), X.subtract(F.col("event_id"), F.col("user_id")).alias("sub"),
        X.array_elem_at(both, -1).alias("last"), F.size(X.filter_(F.array(F.col("event_id"), F.col("user_id"), F.lit(5).cast("long")), lambda x: X.gt(x, 4))).alias("kept"),
    )


@query("SELECT 'db' || (user_id % 3) AS db, 'c' || (user_id % 7) AS coll, user_id::VARCHAR AS doc_id, count(*)::BIGINT AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def streaming_rechecks(spark, sf_dir):
    """The change feed as a stream: what its batches wrote for generation 1, counted by document."""
    from concord.sources import store

    folder = f"{_shared(spark)}/stream"
    feed = changes.from_feed(_feed(spark, sf_dir), "srcClient").where(F.col("op_type").isin("insert", "update", "replace", "delete"))
    feed.write.mode("overwrite").parquet(f"{folder}/feed")
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/feed")
    writer = changes.RecheckWriter(f"{folder}/changes", lambda: 0, "src", once=False)
    changes.start(stream, writer, f"{folder}/checkpoint").awaitTermination()
    if not store.exists(spark, f"{folder}/changes/generation=1"):
        return spark.createDataFrame([], "db string, coll string, doc_id string, n long")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/changes/generation=1")
    return rows.groupBy("db", "coll", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def engine_generations(spark, sf_dir):
    """A whole run over orders: generation 0 finds the drift, generation 1 rechecks it. Rows of mismatches by generation and class."""
    from .engine import Engine

    src, dst = both_orders(spark, sf_dir)
    sides = [Side(spark, {"db.orders": x}, keys={"db.orders": ("o_orderkey",)}) for x in (src, dst)]
    engine = Engine(*sides, f"{_shared(spark)}/engine")
    for _ in range(2):
        engine.run_generation()
        engine.finish_generation()
    return engine.mismatches().groupBy("generation", classify.class_of().alias("class")).agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["engine_generations"] = f"WITH {_ORDERS}, m AS ({_rows_sql()}), c AS (SELECT {_CLASS} AS class, count(*)::BIGINT AS n FROM m GROUP BY 1) SELECT g::INT AS generation, class, n FROM c, unnest([0, 1]) AS u(g)"


def _shared(spark: SparkSession) -> str:
    """A new folder where all machines of the cluster see it. Only on a single machine a temporary folder takes the place of spark.checkpoint.dir."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.gettempdir()}/concord"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@query("SELECT user_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT AS place, event_type FROM events")
def occurrence_index(spark, sf_dir):
    """Place of each row among those of its key."""
    return table(spark, sf_dir, "events").select("user_id", (keys.occurrence("event_type", ["event_id"]) - 1).cast("long").alias("place"), "event_type")
