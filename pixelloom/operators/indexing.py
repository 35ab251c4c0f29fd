"""From listed files to catalogue rows: only what changed is opened, and each file once."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.dates import normalize_exif, resolve_date, unix_to_iso
from pixelloom.functions.values import geo_pair, parse_int
from pixelloom.operators.catalogue import changed_since
from pixelloom.session import staging
from pixelloom.sources import images
from pixelloom.sources.exif import FIELDS, FileBytes, read_exif
from pixelloom.sources.sidecar import SUFFIXES, read_strict

#: Names of pictures handed to Spark's image source at once.
DECODED_AT_ONCE = 10_000
READ = (
    "path string, size bigint, mtime bigint, width bigint, height bigint, datetime_original string, create_date string, make string, model string, "
    "orientation bigint, gps_lat double, gps_lon double, stamp string, lat double, lon double, blake3 binary, dhash bigint, error string"
)


def _sidecar(path: str) -> tuple[str | None, float | None, float | None]:
    for suffix in SUFFIXES:
        if os.path.isfile(path + suffix):
            try:
                with open(path + suffix, encoding="utf-8") as f:
                    return read_strict(f.read())[:3]
            except (OSError, UnicodeDecodeError):
                return None, None, None
    return None, None, None


def read_one(path: str, size: int | None, mtime: int | None) -> dict[str, object]:
    """Everything read from a file; what can't be read is None, a file that can't be opened an error."""
    row: dict[str, object] = {c.split()[0]: None for c in READ.split(", ")} | {"path": path, "size": size, "mtime": mtime}
    if size is None:
        return row | {"error": "stat"}
    try:
        with open(path, "rb") as f:
            whole = FileBytes(f)
            exif, (w, h) = read_exif(whole), images.dimensions(whole)
    except OSError as e:
        return row | {"error": str(e)}
    row |= {f: exif[f] for f in FIELDS if f in row}
    row["width"], row["height"] = (w, h) if w is not None else (exif["pixel_width"], exif["pixel_height"])
    row["stamp"], row["lat"], row["lon"] = _sidecar(path)
    try:
        row["blake3"] = images.file_hash(path)
        with open(path, "rb") as f:
            row["dhash"] = images.dhash(images.oriented(images.decode_png(f.read()), exif["orientation"]))
    except Exception:  # noqa: BLE001 - any failure to decode leaves the hash out
        pass
    return row


def read_files(listed: DataFrame) -> DataFrame:
    """Reads listed files (path, size, mtime) in tasks; columns of ``READ``."""
    kinds = {c.split()[0]: c.split()[1] for c in READ.split(", ")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([read_one(p, None if pd.isna(s) else int(s), None if pd.isna(m) else int(m)) for p, s, m in zip(b["path"], b["size"], b["mtime"])], columns=list(kinds))
            for c, k in kinds.items():
                if k in ("bigint", "double"):
                    rows[c] = pd.array(rows[c], "Int64" if k == "bigint" else "Float64")
            yield rows

    return listed.select("path", "size", "mtime").repartition(4 * listed.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, READ)


def catalogue_rows(read: DataFrame) -> DataFrame:
    """(path and metadata columns, blake3, dhash) of what was read without an error."""
    original, created = normalize_exif(F.col("datetime_original")), normalize_exif(F.col("create_date"))
    taken = unix_to_iso(parse_int(F.col("stamp")))
    lat, lon = geo_pair(F.col("lat"), F.col("lon"))
    date, source = resolve_date(original, created, taken, F.col("path"), F.col("mtime"))
    return read.filter("error is null").select(
        "path", "size", "mtime", "width", "height", original.alias("exif_datetime"), created.alias("exif_create_date"), F.col("make").alias("exif_make"), F.col("model").alias("exif_model"),
        "gps_lat", "gps_lon", "orientation", taken.alias("sidecar_taken_time"), lat.alias("sidecar_lat"), lon.alias("sidecar_lon"), date.alias("resolved_date"), source.alias("date_source"), "blake3", "dhash",
    )


def index(listed: DataFrame, files: DataFrame, folder: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """New catalogue rows of a scan, and its counts (scanned, added, skipped, errors).  Unchanged files
    are left out before anything is opened; the rows are written once, so nothing is read twice.
    With ``folder``, pictures that are no PNG get their hash from Spark's image source, which opens
    them by name, ``DECODED_AT_ONCE`` at a time."""
    spark = listed.sparkSession
    with staging(spark, "index") as area:
        scan = area.write(listed)
        read = area.write(read_files(changed_since(scan, files)))
        open_ = read.filter("error is null and dhash is null").select("path", "orientation")
        if folder is not None:
            more = spark.createDataFrame([], "path string, _d bigint")
            names = open_.select("path").toLocalIterator()
            while piece := [r["path"] for r in islice(names, DECODED_AT_ONCE)]:
                found = images.decoded_hashes(spark, piece, open_).select("path", F.col("dhash").alias("_d"))
                more = more.unionByName(area.write(found))
            read = area.write(read.join(more, "path", "left").withColumn("dhash", F.coalesce("dhash", "_d")).drop("_d"))
        counts = read.agg(F.count_if(F.col("error").isNull()).alias("added"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
        scanned = scan.count()
        stats = {"scanned": scanned, "added": counts["added"], "skipped": scanned - counts["added"] - counts["errors"], "errors": counts["errors"]}
        return catalogue_rows(read), stats
