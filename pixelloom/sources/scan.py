"""Listing of image files, and everything indexing reads from them.

Folders are listed by tasks, level by level, each once: a level is written out, and its folders are
the next one's work.  The driver only learns their number.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.catalogue import IMAGE_EXTENSIONS, SKIPPED_FOLDERS
from pixelloom.session import seen_in, staging
from pixelloom.sinks.files import native

LISTED = "path string, size bigint, mtime bigint, is_dir boolean"


def _fold(path: str) -> str:
    return path.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ/", "abcdefghijklmnopqrstuvwxyz\\"))


def _skipped(path: str, skips: list[str]) -> bool:
    p = _fold(path)
    return any(p == s or p.startswith(s + "\\") for s in skips)


def list_folder(folder: str, skips: list[str]) -> Iterator[tuple[str, int | None, int | None, bool]]:
    """Images of a folder and folders to enter; an unreadable folder or entry is left out.  An image
    that can't be looked at has no size."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        try:
            if e.is_dir(follow_symlinks=False):
                if _fold(e.name) not in SKIPPED_FOLDERS and not _skipped(e.path, skips):
                    yield e.path, None, None, True
            elif e.is_file(follow_symlinks=False) and "." in e.name[1:] and _fold(e.name.rpartition(".")[2]) in IMAGE_EXTENSIONS:
                try:
                    s = e.stat()
                    yield e.path, s.st_size, max(0, int(s.st_mtime // 1)), False
                except OSError:
                    yield e.path, None, None, False
        except OSError:
            continue


def enumerate_images(spark: SparkSession, root: str, user_skips: list[str] | None = None) -> DataFrame:
    """(path, size, mtime) of the images below a folder that all executors see.  Folders with skipped
    names are never entered, the root itself excepted; user skips hold for the root, too."""
    skips = [_fold(s).rstrip("\\") for s in user_skips or []]
    out = spark.createDataFrame([], "path string, size bigint, mtime bigint")
    if _skipped(root, skips):
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                rows = list(list_folder(p, skips))
                yield pd.DataFrame({"path": [r[0] for r in rows], "size": pd.array([r[1] for r in rows], "Int64"), "mtime": pd.array([r[2] for r in rows], "Int64"), "is_dir": pd.array([r[3] for r in rows], bool)})

    level, folders = spark.createDataFrame([(root,)], "path string"), 1
    with staging(spark, "scan") as area:
        while folders:
            tasks = min(folders, 4 * spark.sparkContext.defaultParallelism)
            found = area.write(level.repartition(tasks).mapInPandas(run, LISTED), folders=F.count_if("is_dir"))
            out = out.unionByName(found.filter("not is_dir").drop("is_dir"))
            level, folders = found.filter("is_dir").select("path"), seen_in(found, "folders")
    return out


def names_in(folders: DataFrame) -> DataFrame:
    r"""(dst): ``folder\name`` of every entry, whatever it is, of planned folders (folder) that all
    executors see; one that isn't there or can't be read has none."""

    def entries(folder: str) -> list[str]:
        try:
            return [f"{folder}\\{n}" for n in os.listdir(native(folder + "\\"))]
        except OSError:
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["folder"]:
                yield pd.DataFrame({"dst": entries(folder)}, dtype=object)

    tasks = 4 * folders.sparkSession.sparkContext.defaultParallelism
    return folders.filter("folder is not null").distinct().repartition(tasks, "folder").mapInPandas(run, "dst string")
