"""Classes of mismatches, and the rows that reports show of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.model import DST, MISSING, SRC

from .diff import first_of_each

CLASSES = ("contentDiffers", "missingOnDst", "extraOnDst")


def missing() -> Column:
    """A whole document is missing; a field that is missing is a difference of content."""
    return (F.col("details") == MISSING) & (F.col("field") == "")


def missing_on_dst() -> Column:
    return missing() & (F.col("cluster") == DST)


def extra_on_dst() -> Column:
    return missing() & (F.col("cluster") == SRC)


def content_differs() -> Column:
    return ~missing()


def class_of() -> Column:
    return F.when(missing_on_dst(), "missingOnDst").when(extra_on_dst(), "extraOnDst").otherwise("contentDiffers")


def counts(mismatches: DataFrame) -> DataFrame:
    """contentDiffers, missingOnDst, extraOnDst (rows) and documents (distinct)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return mismatches.agg(n(content_differs()).alias("contentDiffers"), n(missing_on_dst()).alias("missingOnDst"), n(extra_on_dst()).alias("extraOnDst"), F.countDistinct("id").alias("documents"))


def at_least(seconds: float) -> Column:
    return F.col("duration_ms") >= F.lit(int(seconds * 1000))


def by_age(mismatches: DataFrame) -> DataFrame:
    """The longest first, ids in order."""
    return mismatches.orderBy(F.desc("duration_ms"), F.asc("id"))


def top(mismatches: DataFrame, n: int) -> DataFrame:
    """The first n of each class by age."""
    return first_of_each(mismatches.withColumn("class", class_of()), ["class"], [F.desc("duration_ms"), F.asc("id"), F.asc("field")], n)


def longest(mismatches: DataFrame, generation: int) -> DataFrame:
    """The one longest mismatch of this generation and the one before."""
    return by_age(mismatches.where(F.col("generation").isin(generation, generation - 1))).limit(1)


def reported_generation(generation: int, min_seconds: float = 0) -> int | None:
    """Whose mismatches reports show: those of the last whole generation. None: nothing yet."""
    if generation > 0:
        return generation - 1
    return None if min_seconds > 0 else 0


def document_rows(mismatches: DataFrame) -> DataFrame:
    """namespace, id, type, field, detail, durationSecs."""
    whole = missing()
    return mismatches.select(
        "namespace",
        "id",
        F.when(missing_on_dst(), "missingOnDst").when(extra_on_dst(), "extraOnDst").otherwise("content").alias("type"),
        F.nullif("field", F.lit("")).alias("field"),
        F.when(~whole, F.col("details")).alias("detail"),
        (F.col("duration_ms") / 1000).alias("durationSecs"),
    )


def namespace_rows(mismatches: DataFrame) -> DataFrame:
    """namespace, type, aspect, component, detail."""
    gone, field, spec = F.col("details") == MISSING, F.col("field"), F.col("id") == "spec"
    aspect = (
        F.when(spec, "spec").when(field == "", "exist").when(field == "type", "type").when(field == "shard key", "shard key").when(field == "index", "index").when(field == "readOnly", "readOnly")
        .otherwise(F.raise_error(F.concat(F.lit("unknown namespace mismatch: "), field)))
    )
    return mismatches.select(
        "namespace",
        F.when(gone & (F.col("cluster") == SRC), "extraOnDst").when(gone, "missingOnDst").otherwise("content").alias("type"),
        aspect.alias("aspect"),
        F.when(spec, field).when(field == "index", F.col("id")).alias("component"),
        F.when(~gone, F.col("details")).alias("detail"),
    )


#: What of an index's specification may be let differ, and the path of it.
TOLERANCES = {"expireAfterSeconds": "/expireAfterSeconds", "unique": "/unique", "sparse": "/sparse", "hidden": "/hidden", "collation": "/collation", "partialFilterExpression": "/partialFilterExpression"}
PATCH = "array<struct<op:string,path:string>>"


def tolerated(details: Column, tolerances: Sequence[str]) -> Column:
    """Whether all of a JSON patch touches tolerated parts only. A detail that is no patch, or an empty one, isn't tolerated."""
    if not tolerances:
        return F.lit(False)
    paths = [TOLERANCES.get(t, f"/{t}") for t in tolerances]
    ops = F.from_json(details, PATCH)
    inside = lambda op: F.coalesce(F.array_contains(F.array(*map(F.lit, paths)), op["path"]) | F.exists(F.array(*(F.lit(f"{p}/") for p in paths)), lambda p: op["path"].startswith(p)), F.lit(False))
    return F.coalesce((F.size(ops) > 0) & F.forall(ops, inside), F.lit(False))


def without_tolerated(mismatches: DataFrame, tolerances: Sequence[str]) -> DataFrame:
    return mismatches.where(~((F.col("field") == "index") & (F.col("details") != MISSING) & tolerated(F.col("details"), tolerances)))


def summary(mismatches: DataFrame) -> DataFrame:
    """namespace (null: all), class (null: all), n: counts by each and in total, in one aggregation."""
    return mismatches.withColumn("class", class_of()).groupingSets([["namespace"], ["class"], []], "namespace", "class").agg(F.count(F.lit(1)).alias("n"))
