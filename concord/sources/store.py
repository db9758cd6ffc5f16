"""The engine's own state on any Hadoop file system: small text files, and tables by generation."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.delete(p, True)


def text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def touch(spark: SparkSession, path: str, content: str = "") -> None:
    """Writes a small file: beside its place first, then by a rename that replaces what is there. Readers see the old content or the new."""
    p, fs = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(beside, True)
    out.write(bytearray(content.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), over)


def create(spark: SparkSession, path: str) -> bool:
    """Makes an empty file if there is none; of several that try at once, one does."""
    p, fs = _fs(spark, path)
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    return True


#: What a Hadoop file status says of a file: its path, length and time of change.
_STATUS = re.compile(r"path=([^;]*); isDirectory=false; length=(\d+);[^{}]*?modification_time=(\d+)")


def manifest(spark: SparkSession, df: DataFrame) -> dict[str, list[int]]:
    """Length and time of change of each file that a frame reads, from one listing of each of their folders; files that are gone have neither."""
    files = [f.rsplit("/", 1) for f in df.inputFiles()]
    listed = {}
    for parent in {p for p, _ in files}:
        p, fs = _fs(spark, unquote(re.sub(r"^file:/+", "file:/", parent)))
        said = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(p)) if fs.exists(p) else ""  # one call a folder, however many files
        listed[parent] = {path.rsplit("/", 1)[-1]: [int(size), int(time)] for path, size, time in _STATUS.findall(said)}
    return {f"{parent}/{name}": listed[parent].get(unquote(name), []) for parent, name in files}


class Pinned:
    """The files of some frames as they were: what one piece of work reads, however often, is one snapshot, or the work isn't whole."""

    def __init__(self, spark: SparkSession, *frames: DataFrame):
        self.spark, self.frames = spark, frames
        self.before = [manifest(spark, df) for df in frames]

    def changed(self) -> list[str]:
        return sorted(f for df, was in zip(self.frames, self.before, strict=True) for f, state in manifest(self.spark, df).items() if was[f] != state)


class FencedError(RuntimeError):
    """Another driver has taken this folder over."""


class Fence:
    """Numbers the drivers that have worked in a folder. The last one owns it; the others can't write its state any more."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.mine = spark, f"{folder.rstrip('/')}/epochs", None

    def _all(self) -> list[int]:
        return [int(n) for n in names(self.spark, self.folder) if n.isdigit()]

    def own(self) -> None:
        """Takes the folder over the first time; after that, an error if another driver has."""
        if self.mine is None:
            n = max(self._all(), default=0) + 1
            while not create(self.spark, f"{self.folder}/{n:08d}"):
                n += 1
            self.mine = n
        elif (last := max(self._all(), default=0)) > self.mine:
            raise FencedError(f"driver {last} works in {self.folder}; this one is {self.mine}")


VERSION = 1


class State:
    """Generation, whether it is the last, and whether writes are off."""

    def __init__(self, spark: SparkSession, folder: str, fence: Fence | None = None):
        self.spark, self.path, self.fence = spark, f"{folder.rstrip('/')}/state.json", fence

    def read(self) -> dict:
        found = text(self.spark, self.path)
        state = json.loads(found) if found else {"version": VERSION, "generation": 0, "last": False, "writes_off": False, "started": False}
        if state["version"] != VERSION:
            raise ValueError(f"state of version {state['version']}; start clean")
        return state

    def write(self, **changes) -> dict:
        if self.fence is not None:
            self.fence.own()
        state = self.read() | changes
        touch(self.spark, self.path, json.dumps(state))
        return state


def table(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of a table kept by generation; empty if there is none yet."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).select(*schema.fieldNames())


def kept(df: DataFrame, path: str) -> DataFrame:
    """df as a table of its own, in place of what an attempt before left there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int | None:
    """Bytes that a frame's tables take, as the optimizer knows them from the listing of their files; None if it doesn't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def replace_part(df: DataFrame, folder: str, generation: int, unit: str) -> None:
    """Writes the rows of one unit of a generation's work in place of those that an attempt before left."""
    columns = [c for c in df.columns if c != "generation"]
    df.select(*columns).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/generation={generation}/unit={unit}")


def replace_generation(df: DataFrame, folder: str, generation: int) -> None:
    """Writes a generation's rows in place of those that an attempt before left."""
    columns = [c for c in df.columns if c != "generation"]
    df.select(*columns).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/generation={generation}")
