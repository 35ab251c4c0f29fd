"""Carrying out planned moves and copies.  One entry failing is counted and stops no other."""

from __future__ import annotations

import errno
import filecmp
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = "file_id bigint, src string, dst string, op string, error string"


def native(path: str) -> str:
    r"""A planned path as this system writes it: plans use backslashes throughout, and a path from the
    root of a POSIX system gets its slashes back.  Drive and network paths stay as they are."""
    return path.replace("\\", "/") if os.sep == "/" and path[:1] == "\\" and path[1:2] != "\\" else path


def execute_one(src: str, dst: str, op: str) -> str | None:
    """Moves or copies a file, creating the folder; the error's text, or None.  A move across file
    systems is a copy and a removal.  An existing target is never replaced; one that an earlier
    attempt at the same entry left is what was asked for."""
    try:
        os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
        if os.path.exists(dst):
            return None if _left_by_earlier_attempt(src, dst, op) else f"exists: {dst}"
        if op == "move":
            try:
                os.rename(src, dst)
                return None
            except OSError as e:
                if e.errno != errno.EXDEV:
                    raise
        # Named in one step, so that a target is whole or not there.
        part = f"{dst}.{uuid.uuid4().hex[:8]}.part"
        try:
            shutil.copy2(src, part)
            os.rename(part, dst)
        finally:
            if os.path.exists(part):
                os.unlink(part)
        if op == "move":
            os.unlink(src)
    except OSError as e:
        return str(e)
    return None


def _left_by_earlier_attempt(src: str, dst: str, op: str) -> bool:
    """Whether an existing target is this entry's own: a task may run again after it moved a file, or
    between the copy and the removal of a move across file systems, which is then finished."""
    if not os.path.exists(src):
        return op == "move"
    there, here = os.stat(dst), os.stat(src)
    if (there.st_size, int(there.st_mtime)) != (here.st_size, int(here.st_mtime)) or not filecmp.cmp(src, dst, shallow=False):
        return False
    if op == "move":
        if there.st_dev == here.st_dev:  # a rename leaves no source behind
            return False
        os.unlink(src)
    return True


def execute(plan: DataFrame, op: str = "move") -> DataFrame:
    """(file_id, src, dst, op, error) of each entry of a plan (file_id, src, dst).  It acts on folders
    that all executors share, when its result is written: read what was written for the log and the
    catalogue.  Tasks that run again, and whole repetitions, give the same result."""
    if op not in ("move", "copy"):
        raise ValueError(f"unknown operation: {op}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(dst=[native(d) for d in b["dst"]])
            yield b.assign(op=op, error=pd.Series([execute_one(s, d, op) for s, d in zip(b["src"], b["dst"])], index=b.index, dtype=object))

    return plan.select("file_id", "src", "dst").mapInPandas(run, DONE)


def undo(moves: DataFrame) -> DataFrame:
    """(id, src_path, dst_path, error): logged moves (id, src_path, dst_path) taken back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(error=pd.Series([execute_one(d, s, "move") for s, d in zip(b["src_path"], b["dst_path"])], index=b.index, dtype=object))

    return moves.select("id", "src_path", "dst_path").mapInPandas(run, "id bigint, src_path string, dst_path string, error string")


def log_entries(done: DataFrame, after: int, ts: int) -> DataFrame:
    """Log rows (id, ts, op, src_path, dst_path) of what was carried out, ids after ``after``."""
    ok = done.filter("error is null")
    number = F.monotonically_increasing_id()
    return ok.select((F.lit(after) + 1 + number).alias("id"), F.lit(ts).cast("bigint").alias("ts"), "op", F.col("src").alias("src_path"), F.col("dst").alias("dst_path"))


def write_labels(lines: DataFrame, folder: str) -> int:
    """Writes label lines (value) as text; their number."""
    lines.write.mode("overwrite").text(folder)
    return lines.count()
