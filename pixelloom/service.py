"""The commands of a catalogue application on a :class:`~pixelloom.sinks.store.Store`.

Queries return DataFrames; changes write new versions of tables and return their counts.
"""

from __future__ import annotations

import base64
import os
import struct
import time
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import catalogue, classify, duplicates, indexing, organize
from pixelloom.session import progress, staging
from pixelloom.sinks import files as sink
from pixelloom.sinks.store import Store
from pixelloom.sources import images, scan
from pixelloom.sources.labels import read_labels


class Service:
    """One catalogue; its tables are created if they aren't there."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        store.create()
        self._finish()  # moves that a lost driver left half way

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # ------------------------------------------------------------ scanning
    def scan_dir(self, folder: str, on_progress: Callable[[int, int], None] | None = None) -> dict[str, int]:
        """Indexes a folder: scanned, added, skipped, errors.  ``on_progress`` hears of the tasks done."""
        if on_progress is not None:
            with progress(self.spark, on_progress):
                return self.scan_dir(folder)
        began = int(time.time())
        skips = [r["path"] for r in self._table("skip_dirs").collect()]
        files = self._table("files")
        rows, stats = indexing.index(scan.enumerate_images(self.spark, folder, skips), files, folder)
        self.store.write("files", catalogue.upsert_files(files, rows))
        self.store.write("hashes", catalogue.upsert_hashes(self._table("hashes"), rows.select("path", "blake3", "dhash"), self._table("files")))
        now = self.spark.createDataFrame([(folder, began, *(stats[k] for k in ("scanned", "added", "skipped", "errors")))], "path string, last_scan_ts bigint, scanned bigint, added bigint, skipped bigint, errors bigint")
        self.store.write("scan_roots", catalogue.record_scan_root(self._table("scan_roots"), now))
        return stats

    def scan_roots(self) -> DataFrame:
        """Roots, the last scanned first."""
        return self._table("scan_roots").orderBy(F.desc("last_scan_ts"), "path")

    def skip_dirs(self) -> DataFrame:
        return self._table("skip_dirs").orderBy("path")

    def add_skip_dir(self, path: str) -> None:
        self.store.write("skip_dirs", catalogue.add_skip_dir(self._table("skip_dirs"), path))

    def remove_skip_dir(self, path: str) -> None:
        self.store.write("skip_dirs", catalogue.remove_skip_dir(self._table("skip_dirs"), path))

    # ------------------------------------------------------------ duplicates
    def exact_dupes(self) -> tuple[DataFrame, DataFrame]:
        """The report and its members."""
        members = duplicates.exact_members(self._table("files"), self._table("hashes"))
        return duplicates.report(members, 0), members

    def near_dupes(self, k: int = 5, method: str = "bands") -> tuple[DataFrame, DataFrame]:
        members = duplicates.with_catalogue(duplicates.near_groups(self._table("hashes"), k, method), self._table("files"))
        return duplicates.report(members, k), members

    def thumbnail(self, path: str, edge: int = 256) -> str | None:
        """A file's thumbnail as a data URL; None if it can't be decoded."""
        try:
            with open(path, "rb") as f:
                data = f.read()
        except OSError:
            return None
        try:
            small = images.thumbnail(data, edge)
        except (ValueError, struct.error, zlib.error):
            decoded = images.decoded_thumbnails(self.spark, os.path.abspath(path), edge).first()
            if decoded is None:
                return None
            small = decoded["thumbnail"]
        return "data:image/png;base64," + base64.b64encode(small).decode()

    # ------------------------------------------------------------ moving
    def _carry_out(self, plan: DataFrame, op: str) -> dict[str, int]:
        """Moves or copies, the log and the catalogue's paths as one: what is to be done is stored first
        and forgotten last, and every step between may be repeated."""
        after = self._table("undo_log").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self.store.write("pending", plan.select("file_id", "src", "dst", F.lit(op).alias("op"), F.lit(after).cast("bigint").alias("after"), F.lit(int(time.time())).alias("ts")))
        return self._finish()

    def _finish(self) -> dict[str, int]:
        pending = self._table("pending")
        begun = pending.first()
        if begun is None:
            return {"moved": 0, "errors": 0}
        with staging(self.spark, "moves") as area:
            done = area.write(sink.execute(pending, begun["op"]))
            log = self._table("undo_log").filter(F.col("id") <= begun["after"])
            self.store.write("undo_log", log.unionByName(sink.log_entries(done, begun["after"], begun["ts"])))
            if begun["op"] == "move":
                self.store.write("files", organize.after_moves(self._table("files"), done.filter("error is null").select("file_id", "dst")))
            counts = organize.outcome_counts(done).first().asDict()
            self.store.write("pending", pending.limit(0))
            return counts

    def organize_plan(self, target: str) -> DataFrame:
        return organize.plan_by_date(self._table("files"), target)

    def organize(self, target: str, copy: bool = False) -> dict[str, int]:
        """Carries the plan out: moved, errors."""
        return self._carry_out(self.organize_plan(target), "copy" if copy else "move")

    def move_to_duplicates(self, paths: list[str], dest_dir: str | None = None) -> dict[str, int]:
        """Moves selected files into a folder, by default one beside the first of them."""
        if not paths:
            return {"moved": 0, "errors": 0}
        chosen = self.spark.createDataFrame([(p,) for p in paths], "path string")
        folder = dest_dir or self.spark.range(1).select(organize.duplicates_folder(F.lit(paths[0]))).first()[0]
        return self._carry_out(organize.plan_into(chosen, self._table("files"), folder), "move")

    def undo_moves(self, n: int = 1) -> dict[str, int]:
        """Takes the newest ``n`` moves back, and out of the log."""
        with staging(self.spark, "undo") as area:
            log = self._table("undo_log")
            done = area.write(sink.undo(area.write(organize.last_moves(log, n))))
            back = done.filter("error is null")
            self.store.write("files", organize.after_undo(self._table("files"), back))
            self.store.write("undo_log", log.join(back.select("id"), "id", "left_anti"))
            return organize.outcome_counts(done).first().asDict()

    # ------------------------------------------------------------ labels
    def run_classifier(self) -> dict[str, int]:
        """Labels all files without a manual decision: photo, non_photo, ambiguous."""
        files = self._table("files")
        counts = classify.label_counts(classify.classified(files)).first().asDict()
        self.store.write("files", classify.relabelled(files))
        return counts

    def review_queue(self, n: int = 500) -> DataFrame:
        return classify.review_queue(self._table("files"), n)

    def set_label(self, file_id: int, label: str) -> None:
        """A manual decision; only photo and non_photo are labels."""
        if label not in (classify.PHOTO, classify.NON_PHOTO):
            raise ValueError(f"unknown label: {label}")
        one = self.spark.createDataFrame([(file_id, label)], "id bigint, label string")
        self.store.write("files", classify.with_manual_labels(self._table("files"), one))

    def export_labels(self, folder: str) -> int:
        return sink.write_labels(classify.manual_label_lines(self._table("files")), folder)

    def accuracy(self, labels: str) -> dict[str, float]:
        return classify.accuracy(read_labels(self.spark, labels), self._table("files")).first().asDict()

    def status(self) -> dict[str, int]:
        return {name: self._table(name).count() for name in ("files", "hashes", "undo_log")}

