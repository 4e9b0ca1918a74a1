"""Incremental ingest: files seen once, merged batch by batch into the store's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.functions.normalize import snapshot_hash
from bidweave.jobs import stage_awards, stage_snapshots
from bidweave.operators import versions
from bidweave.operators.rows import cut
from bidweave.sources.awards import read_award_files
from bidweave.store import Store, Transaction


def _run(store: Store, stream: DataFrame, checkpoint: str, take: Callable[[Transaction, DataFrame], None]) -> None:
    """Take in what is there, batch by batch; what a batch changes and its number are one commit, so none is taken in twice."""

    def batch(rows: DataFrame, number: int) -> None:
        t = store.begin()
        if int(t.entry["tags"].get(f"batch {checkpoint}", -1)) < number:
            take(t, rows)
            t.commit({f"batch {checkpoint}": str(number)})

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay_awards(store: Store, folder: str, checkpoint: str, vertical: tuple[str, ...], files_per_batch: int = 64) -> None:
    """Merge every award file and zip of a folder that hasn't been seen; older records never replace newer ones.

    The stream hands on the names of new files, a bounded number a batch; each is then read by its own header, by ranges
    or members, so columns may stand in any order, and any others beside the wanted ones. Files without the key column
    are passed over.
    """
    spark = store.spark
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.{csv,zip}").load(folder).select("path")

    def take(t: Transaction, names: DataFrame) -> None:
        raw = read_award_files(spark, [r["path"] for r in names.orderBy("path").collect()])[0]
        if raw is not None:
            stage_awards(t, raw, vertical)

    _run(store, stream, checkpoint, take)


def without_repeats(snapshots: DataFrame, at: str, delay: str) -> DataFrame:
    """A stream of snapshots without those that came before, word for word, within the delay: pages served again, or late."""
    hashed = snapshots.withColumn("_hash", snapshot_hash(versions.fields(), "snapshot"))
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["notice_id", "_hash"]).drop("_hash")


def replay_snapshots(store: Store, folder: str, schema, checkpoint: str, authoritative: Sequence[str] | None = None, at: str | None = None, delay: str = "2 days") -> None:
    """Fold incoming notice snapshots (Parquet: notice_id, seq, text, snapshot) into the version history.

    With ``at``, a column of when each was fetched, repeats within ``delay`` are dropped before they reach a batch. A
    batch reads and writes the buckets of its notices only.
    """
    stream = store.spark.readStream.schema(schema).parquet(folder)
    if at:
        stream = without_repeats(stream, at, delay)

    def take(t: Transaction, batch: DataFrame) -> None:
        stage_snapshots(t, cut(batch.select("notice_id", "seq", "text", "snapshot")), authoritative)

    _run(store, stream, checkpoint, take)
