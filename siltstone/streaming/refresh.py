"""Keeping an index fresh from a stream of change events (path, ts, deleted).

Events of one path are gathered by session windows, so a burst of edits is one refresh, and a watermark closes windows and
drops late ones.  Each micro-batch replaces the rows of its files, and the new version holds the batch's number: a batch that is replayed after a failure
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.encoder import Encoder, HashedEncoder, embedded
from siltstone.plans.indexing import build, now
from siltstone.sources.files import java_files, present
from siltstone.sources.store import Store
from siltstone.sources.workspace import Workspace


def debounced(events: DataFrame, gap: str = "2 seconds", late: str | None = "10 seconds", key: str = "path") -> DataFrame:
    """(key, first, last, n, deleted): one row per burst of events that are less than ``gap`` apart; deleted is that of the last event."""
    own = events.withWatermark("ts", late) if late and events.isStreaming else events
    window = F.session_window("ts", gap)
    out = own.groupBy(window.alias("w"), key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.max_by("deleted", "ts").alias("deleted"))
    return out.drop("w")


def refresh(spark: SparkSession, store: Store, bursts: DataFrame, *, repo_root: str, workspace: Workspace | None = None, encoder: Encoder | None = None, batch: tuple[str, int] | None = None) -> int | None:
    """Applies one batch of bursts: changed files are parsed anew, deleted ones leave the index.  Returns the new version; None if there is nothing to do, or if the
    index holds ``batch`` (the stream's name and the batch's number) already."""
    if batch is not None and store.applied(batch):
        return None
    last = bursts.groupBy("path").agg(F.max_by("deleted", "last").alias("deleted"))
    rows = last.collect()  # one row per file that was edited in this batch
    if not rows:
        return None
    encoder, at = encoder or HashedEncoder(), now()
    there = present(spark, [r["path"] for r in rows if not r["deleted"]])
    documents, _ = build(java_files(spark, there), repo_root, workspace, spark, at)
    changed = spark.createDataFrame([(r["path"][len(repo_root.rstrip("/")) + 1 :],) for r in rows], "file_path STRING")
    return store.replace_files(changed, documents, embedded(documents, encoder), encoder.name, at, batch=batch)


def watch(spark: SparkSession, store: Store, events: DataFrame, checkpoint: str, *, repo_root: str, workspace: Workspace | None = None, encoder: Encoder | None = None, gap: str = "2 seconds", late: str = "10 seconds", once: bool = False):
    """Starts the stream; with ``once`` it takes what is there and ends."""

    def apply(batch: DataFrame, number: int) -> None:
        refresh(spark, store, batch, repo_root=repo_root, workspace=workspace, encoder=encoder, batch=(checkpoint, number))

    writer = debounced(events, gap, late).writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
