"""Schemas, enumerations and options of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

CLUSTER_TIME = T.StructType([T.StructField("t", T.LongType()), T.StructField("i", T.IntegerType())])

MISMATCHES = T.StructType(
    [
        T.StructField("generation", T.IntegerType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("data_size", T.IntegerType()),
        T.StructField("src_ts", CLUSTER_TIME),
        T.StructField("dst_ts", CLUSTER_TIME),
    ]
)

RECHECKS = T.StructType(
    [
        T.StructField("generation", T.IntegerType()),
        T.StructField("db", T.StringType()),
        T.StructField("coll", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("data_size", T.IntegerType()),
        T.StructField("change_op_time", CLUSTER_TIME),
        T.StructField("from_dst", T.BooleanType()),
        T.StructField("first_mismatch_time", T.TimestampType()),
    ]
)

TASKS = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("to_namespace", T.StringType()),
        T.StructField("lower", T.StringType()),
        T.StructField("upper", T.StringType()),
        T.StructField("ids", T.ArrayType(T.StringType())),
        T.StructField("documents_count", T.LongType()),
        T.StructField("found_source_documents_count", T.LongType()),
        T.StructField("source_bytes_count", T.LongType()),
        T.StructField("src_ts", CLUSTER_TIME),
        T.StructField("dst_ts", CLUSTER_TIME),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("cluster", T.StringType()),
        T.StructField("op_type", T.StringType()),
        T.StructField("db", T.StringType()),
        T.StructField("coll", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("full_doc_len", T.LongType()),
        T.StructField("has_doc", T.BooleanType()),
        T.StructField("cluster_time", CLUSTER_TIME),
    ]
)

SRC, DST = "srcClient", "dstClient"
MISSING, MISMATCH = "Missing", "Mismatch"


class Method(str, Enum):
    """How two documents are compared."""

    BINARY = "binary"
    IGNORE_ORDER = "ignoreOrder"
    HASH = "toHashedIndexKey"

    @classmethod
    def of(cls, name: str | Method) -> Method:
        """The method by its name; ignoreFieldOrder is another name of ignoreOrder."""
        return cls.IGNORE_ORDER if name == "ignoreFieldOrder" else cls(name)


class Status(str, Enum):
    ADDED = "added"
    PROCESSING = "processing"
    COMPLETED = "completed"
    FAILED = "failed"
    MISMATCH = "mismatch"


class TaskType(str, Enum):
    """Apart from primary, the order of the names is the order of work."""

    RECHECK_QUEUE = "processRecheckQueue"
    COLLECTION = "verifyCollection"
    DOCUMENTS = "verifyDocuments"
    PRIMARY = "primary"


class DdlPolicy(str, Enum):
    FAIL = "fail"
    WARN_MOST = "warnMost"


class Phase(str, Enum):
    IDLE = "idle"
    CHECK = "check"
    RECHECK = "recheck"


#: Document operations, and schema operations that may be warned about instead of failing.
DOCUMENT_OPS = ("insert", "update", "replace", "delete")
DDL_OPS = ("create", "drop", "rename", "createIndexes", "dropIndexes", "modify", "shardCollection")

#: Fixed value: size that an event counts as if its document's size isn't known.
DEFAULT_SIZE = 1024


@dataclass
class Options:
    """Settings of one reconciliation. Sizes are bytes."""

    method: Method = Method.IGNORE_ORDER
    natural: bool = False
    keys: tuple[str, ...] = ("_id",)
    filter: str | dict | None = None
    namespaces: dict[str, str] = field(default_factory=dict)
    strict_namespaces: bool = False
    partition_bytes: int = 400 << 20
    ranges: int = 64  # of one table at most, about so many in a generation of rechecks; each is jobs of its own, and what a run that was cut off repeats
    workers: int = 10
    pause_seconds: float = 1.0
    feed_files: int = 100  # of a change feed, that one batch takes in at most
    recheck_ids: int = 10_000
    recheck_id_bytes: int = 1 << 20
    recheck_unit_ids: int = 1_000_000  # of one table that one unit of a generation rechecks; partition_bytes bounds it, too; a table that asks for more units than ranges has larger ones
    indexed_files: int = 16  # tables of so many files or more get an index of which file holds which keys
    ddl_until: tuple[int, int] | None = None  # schema events of the source up to this logical time are old news
    drain_seconds: float = 600.0  # that feeds are waited for, if writes went off at a logical time they haven't reached
    src_ddl: DdlPolicy = DdlPolicy.FAIL
    verify_all: bool = True
    index_tolerances: tuple[str, ...] = ()
    failure_display_size: int = 20

    def __post_init__(self) -> None:
        self.method = Method.of(self.method)
        self.src_ddl = DdlPolicy(self.src_ddl)
        if len(set(self.namespaces.values())) != len(self.namespaces):
            raise ValueError("two source namespaces map to one destination namespace")
