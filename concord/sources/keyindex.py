"""Which files hold which keys, so that a recheck opens only those.

The index of one side of a table has a row for each file and each key hash in it, dealt to folders by the hash. Files are indexed once, by a scan of their key columns alone; a file that is new, or
isn't as it was, is indexed before the next lookup, and what is no longer there is passed over. Hashes of 64 bits may name a file too many, never one too few.
Of several that look into one index at a time, one indexes what is new and the others wait for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from contextlib import AbstractContextManager, nullcontext
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import keys

from . import store

BUCKETS = 64
FILE = "_metadata.file_path"


def _as_metadata(file: str) -> str:
    """A file's name as the column FILE has it."""
    return re.sub(r"^file:/+", "file:/", unquote(file))


class KeyIndex:
    def __init__(self, spark: SparkSession, folder: str, lock: AbstractContextManager | None = None):
        self.spark, self.folder, self.lock = spark, folder.rstrip("/"), lock or nullcontext()

    def _known(self) -> dict[str, list[int]]:
        found = store.text(self.spark, f"{self.folder}/files.json")
        return json.loads(found) if found else {}

    @staticmethod
    def _hashed(text: Column) -> list[Column]:
        h = F.xxhash64(text)
        return [h.alias("hash"), F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket")]

    def update(self, df: DataFrame, key: Sequence[str]) -> dict[str, list[int]]:
        """Indexes the files of df that aren't yet. Returns the files of df, as they are."""
        now = {_as_metadata(f): state for f, state in store.manifest(self.spark, df).items()}
        with self.lock:
            known = self._known()
            new = [f for f, state in now.items() if known.get(f) != state]
            if new:
                rows = df.where(F.col(FILE).isin(new)).select(*self._hashed(keys.key_text(df, key)), F.col(FILE).alias("file"))
                # Rows that are the same lie in one bucket, so telling them apart needs no other exchange.
                rows.repartition("bucket").distinct().sortWithinPartitions("bucket", "hash").write.partitionBy("bucket").mode("append").parquet(f"{self.folder}/keys")
                store.touch(self.spark, f"{self.folder}/files.json", json.dumps({f: s for f, s in known.items() if f in now} | now))
        return now

    def files(self, ids: DataFrame, now: dict[str, list[int]]) -> list[str]:
        """Files among these that hold any of the key texts (column key)."""
        if not now:
            return []
        asked = ids.select(*self._hashed(F.col("key"))).distinct()
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = self.spark.read.schema("hash long, file string, bucket int").parquet(f"{self.folder}/keys").where(F.col("bucket").isin(buckets))
        found = stored.join(asked.select("hash"), "hash", "left_semi").select("file").distinct().collect()  # names of files of one table
        return sorted({r[0] for r in found} & now.keys())


def narrowed(df: DataFrame, index: KeyIndex, ids: DataFrame, key: Sequence[str], least: int) -> DataFrame:
    """df without the files that hold none of the ids. Tables of few files stay as they are, and so do frames whose rows don't come straight from files."""
    if len(df.inputFiles()) < least:
        return df
    try:
        df.select(FILE)
    except AnalysisException:
        return df
    return df.where(F.col(FILE).isin(index.files(ids, index.update(df, key))))
