"""Takeout sidecars: JSON files beside their images, read strictly."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.dates import unix_to_iso
from pixelloom.functions.values import arrow_udf, geo_pair, parse_int

SUFFIXES = (".supplemental-metadata.json", ".json")
RAW = "timestamp string, latitude double, longitude double, valid boolean"


def _refuse(word: str) -> float:
    raise ValueError(word)


def read_strict(text: str | None) -> tuple[str | None, float | None, float | None, bool]:
    """(timestamp, latitude, longitude, valid).  Anything that isn't JSON, or a field of another type
    than a text (timestamp) or number (coordinates), makes the whole sidecar invalid."""
    bad = (None, None, None, False)
    try:
        raw = json.loads(text, parse_constant=_refuse) if text is not None else None
    except (ValueError, RecursionError):
        return bad
    if not isinstance(raw, dict):
        return bad
    taken, geo = raw.get("photoTakenTime"), raw.get("geoData")
    if not isinstance(taken, dict | None) or not isinstance(geo, dict | None):
        return bad
    stamp, lat, lon = (taken or {}).get("timestamp"), (geo or {}).get("latitude"), (geo or {}).get("longitude")
    if not isinstance(stamp, str | None) or any(isinstance(x, bool) or not isinstance(x, int | float | None) for x in (lat, lon)):
        return bad
    if geo is not None:
        lat, lon = lat or 0.0, lon or 0.0
    try:
        return stamp, None if lat is None else float(lat), None if lon is None else float(lon), True
    except OverflowError:
        return bad


def sidecar_raw(text: Column) -> Column:
    """The strict reading of a JSON text column, as a struct."""

    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_strict(t) for t in text], columns=["timestamp", "latitude", "longitude", "valid"])

    return arrow_udf(run, RAW)(text)


def parsed(sidecars: DataFrame) -> DataFrame:
    """(path, taken_time, lat, lon) of sidecars (path, text); invalid ones have NULLs."""
    s = sidecars.select("path", sidecar_raw(F.col("text")).alias("_r"))
    lat, lon = geo_pair(F.col("_r.latitude"), F.col("_r.longitude"))
    return s.select("path", unix_to_iso(parse_int(F.col("_r.timestamp"))).alias("taken_time"), lat.alias("lat"), lon.alias("lon"))


def of_images(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, text) of each image (path): of its possible sidecars the first that exists, even if it
    turns out malformed; NULL text without one."""
    s = sidecars.select(F.col("path").alias("_s"), "text")
    tries = images.select("path").distinct().select("path", F.posexplode(F.array(*[F.concat("path", F.lit(x)) for x in SUFFIXES])).alias("_i", "_s"))
    found = tries.join(s, "_s").groupBy("path").agg(F.min_by("text", "_i").alias("text"))
    return images.select("path").join(found, "path", "left")
