"""Text and NDJSON reports of what the tables say."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import formats
from concord.operators import classify


def table(header: Iterable[str], rows: Iterable[Iterable]) -> str:
    """Columns side by side."""
    cells = [[str(c) for c in header]] + [["" if c is None else str(c) for c in r] for r in rows]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    body = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |" for r in cells]
    return "\n".join([line, body[0], line, *body[1:], line])


def ndjson(df: DataFrame) -> Iterator[str]:
    """A JSON line for each row, absent values left out; rows come a partition at a time."""
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator(prefetchPartitions=True):
        yield row["j"]


def metadata_mismatches(rows: DataFrame, tolerances: tuple[str, ...] = (), limit: int = 1000) -> str:
    """Mismatches of metadata, and how many more are tolerated."""
    kept = classify.without_tolerated(rows, tolerances)
    gone = rows.count() - kept.count() if tolerances else 0
    shown = kept.orderBy("namespace", "field", "id").limit(limit).collect()
    if not shown:
        return f"No metadata mismatches found{f' ({gone} tolerated)' if gone else ''}."
    text = table(["Namespace", "Field", "Name", "Details", "Cluster"], [(r["namespace"], r["field"], r["id"], r["details"], r["cluster"]) for r in shown])
    return f"{text}\n{gone} more tolerated." if gone else text


def document_mismatches(rows: DataFrame, generation: int, limit: int) -> str:
    """Up to limit rows of each class, the longest first; durations from the first recheck on."""
    titles = {"contentDiffers": "Documents with differing content", "missingOnDst": "Documents missing on the destination", "extraOnDst": "Documents missing on the source"}
    found: dict[str, list] = {}
    for r in classify.by_age(classify.top(rows, limit)).collect():  # at most three times limit
        found.setdefault(r["class"], []).append(r)
    out = []
    for kind, title in titles.items():
        if own := found.get(kind):
            header = ["Namespace", "ID", *(["Field", "Details"] if kind == "contentDiffers" else []), *(["Duration"] if generation else [])]
            cells = [(r["namespace"], r["id"], *((r["field"], r["details"]) if kind == "contentDiffers" else ()), *((formats.duration(r["duration_ms"] / 1000),) if generation else ())) for r in own]
            out.append(f"{title}:\n{table(header, cells)}")
    return "\n\n".join(out) or "No document mismatches found."


def progress(rows: DataFrame, limit: int = 1000) -> str:
    """Namespaces in work, with shares done."""
    cells = [
        (r["namespace"], f"{formats.number(r['docsCompared'])} / {formats.number(r['totalDocs'])} ({formats.percent(r['docsCompared'], r['totalDocs'])}%)", f"{formats.bytes_(r['bytesCompared'])} / {formats.bytes_(r['totalBytes'])}", r["partitionsDone"], r["partitionsProcessing"], r["partitionsAdded"])
        for r in rows.orderBy("namespace").limit(limit).collect()
    ]
    return table(["Namespace", "Documents", "Bytes", "Done", "In work", "To do"], cells)


def generation_end(totals: dict, generation: int, seconds: float) -> str:
    rate = totals["docsCompared"] / seconds if seconds else 0.0
    return (
        f"Generation {generation} ended after {formats.duration(seconds)}: {formats.number(totals['docsCompared'])} documents ({formats.bytes_(totals['bytesCompared'])}) in {totals['completedNss']} of {totals['totalNss']} namespaces, {formats.number(rate)} documents/s."
    )


def change_events(counted: DataFrame, n: int = 10) -> str:
    """Change events by namespace, the busiest first."""
    from concord.operators.statistics import busiest

    rows = busiest(counted, n).collect()
    if not rows:
        return "No change events."
    return table(["Namespace", "Events"], [(r["namespace"], formats.number(r["total"])) for r in rows])


def document_counts(src: dict[str, int], dst: dict[str, int]) -> str:
    return table(["Namespace", "Source", "Destination"], [(ns, src.get(ns), dst.get(ns)) for ns in sorted(src.keys() | dst.keys())])


def reader_status(cluster: str, rates: dict, lag_seconds: int | None, last_rechecked: str | None) -> list[str]:
    """How a change feed keeps up; more than two minutes behind or over 90 % busy is a warning."""
    rate = rates.get("processed_rows_per_second")
    out = [f"{cluster}: {formats.number(rate)} events/s" if rate is not None else f"{cluster}: no events yet"]
    if lag_seconds is not None:
        out.append(f"{'⚠ ' if lag_seconds > 120 else ''}{cluster}: {formats.duration(lag_seconds)} behind")
    busy = rates.get("saturation")
    if busy is not None:
        out.append(f"{'⚠ ' if busy > 0.9 else ''}{cluster}: {formats.percent(int(10_000 * busy), 10_000)}% busy")
    out.append(f"{cluster}: rechecked until {last_rechecked}" if last_rechecked else f"{cluster}: nothing rechecked yet")
    return out


def workers(spark) -> str:
    """Jobs and stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    rows = []
    for job in tracker.getActiveJobsIds():
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if at := tracker.getStageInfo(stage):
                rows.append((job, stage, at.name, f"{at.numCompletedTasks} / {at.numTasks}", at.numActiveTasks))
    return table(["Job", "Stage", "Work", "Tasks done", "Running"], rows) if rows else "Nothing runs."


class SchemaWarning:
    """Says that schema events were seen, once a minute at most."""

    def __init__(self, seconds: float = 60):
        self.seconds, self.at = seconds, None

    def text(self, now: float, n: int) -> str | None:
        if not n or (self.at is not None and now - self.at < self.seconds):
            return None
        self.at = now
        return f"⚠ {formats.number(n)} schema events were seen; differences of metadata may come from them."


def status(doc_mismatch: bool, longest_seconds: float, ns_mismatch: bool, incomplete: bool, events: bool, writes_off: bool) -> str:
    """The line at a generation's end."""
    if doc_mismatch and writes_off:
        return "❗ Documents differ although writes are off; investigate."
    if doc_mismatch:
        return "❓ Documents differ again; if writes go on they may still be fixed." if longest_seconds > 0 else "❓ Documents differ; they will be rechecked."
    if ns_mismatch:
        return f"{'❗' if writes_off else '❓'} Metadata differs."
    if incomplete:
        return "ⓘ Some work isn't done yet."
    return "ⓘ Nothing differs; changed documents will be rechecked." if events else "✅ Nothing differs."


def to_json(value: dict) -> str:
    return json.dumps(value, default=str)
