"""Scans as a stream: listings arrive in micro-batches and only what changed reaches the catalogue.

The comparison is with the catalogue as it is at each batch (a file source would notice new paths,
but not changed files), so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelloom.operators.catalogue import changed_since, upsert_files
from pixelloom.sinks.store import Store

LISTING = "path string, size bigint, mtime bigint"


def follow(listings: DataFrame, store: Store, describe: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream: of every batch of ``listings`` (path, size, mtime) the changed rows, described
    by ``describe`` as catalogue rows, are merged into the store's files.  ``once`` stops after what
    is there; otherwise it keeps running."""

    def merge(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime"), "mtime").alias("_l")).select("path", "_l.*")
        files = store.read("files")
        store.write("files", upsert_files(files, describe(changed_since(latest, files))))

    writer = listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
