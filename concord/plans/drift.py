"""A destination that drifted from its source by rule, so that there is something to find.

Keys divisible by 97 are gone, amounts of those by 101 are one more, states of those by 103 are null, and each
divisible by 499 is there once more under a key of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT = 10_000_000


def drifted(df: DataFrame, key: str, amount: str | None = None, state: str | None = None) -> DataFrame:
    k = F.col(key)
    kept = df.where(k % 97 != 0)
    if amount:
        kept = kept.withColumn(amount, F.when(k % 101 == 0, F.col(amount) + 1).otherwise(F.col(amount)))
    if state:
        kept = kept.withColumn(state, F.when(k % 103 == 0, F.lit(None)).otherwise(F.col(state)))
    return kept.unionByName(df.where(k % 499 == 0).withColumn(key, k + SHIFT))


def drifted_sql(table: str, key: str, columns: str, amount: str | None = None, state: str | None = None) -> str:
    """The same for DuckDB; columns: the other columns, comma-separated."""
    other = columns
    if amount:
        other = other.replace(amount, f"CASE WHEN {key} % 101 = 0 THEN {amount} + 1 ELSE {amount} END AS {amount}")
    if state:
        other = other.replace(state, f"CASE WHEN {key} % 103 = 0 THEN NULL ELSE {state} END AS {state}")
    return f"SELECT {key}, {other} FROM {table} WHERE {key} % 97 <> 0 UNION ALL SELECT {key} + {SHIFT} AS {key}, {columns} FROM {table} WHERE {key} % 499 = 0"
