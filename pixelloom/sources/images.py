"""Pixels: dimensions from headers, orientation and difference hashes, as Arrow batches."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.values import arrow_udf
from pixelloom.sources.exif import FileBytes


def dimensions(data: bytes | FileBytes | None) -> tuple[int | None, int | None]:
    """(width, height) from the header of a PNG, GIF, BMP, JPEG or WebP; (None, None) for others."""
    d = data or b""
    try:
        if d[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", d[16:24])
        if d[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", d[6:10])
        if d[:2] == b"BM":
            w, h = struct.unpack("<ii", d[18:26])
            return w, abs(h)
        if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
            if d[12:16] == b"VP8X":
                return int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1
            if d[12:16] == b"VP8L":
                bits = int.from_bytes(d[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            w, h = struct.unpack("<HH", d[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if d[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(d):
                if d[at] != 0xFF:
                    return None, None
                kind = d[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", d[at + 5 : at + 9])
                    return w, h
                at += 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None, None


def header_dimensions(data: Column) -> Column:
    """struct<width, height> of a binary column."""

    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dimensions(d) for d in data], columns=["width", "height"]).astype("Int64")

    return arrow_udf(run, "width bigint, height bigint")(data)


def decode_png(data: bytes) -> np.ndarray:
    """Grey values (height, width) of a PNG; see :func:`png_pixels`."""
    px = png_pixels(data)
    return grey(px) if px.shape[2] >= 3 else px[:, :, 0].astype(np.float64)


#: First column and row, and steps, of the passes of an interlaced PNG.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_pixels(data: bytes) -> np.ndarray:
    """8-bit channels (height, width, n) of a PNG of any depth; ValueError for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth not in (1, 2, 4, 8, 16) or channels is None or interlaced > 1:
        raise ValueError("this PNG is not supported")
    at, body, palette = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        if name == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        elif name == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        at += 12 + size
    raw, at = np.frombuffer(zlib.decompress(body), np.uint8), 0
    px = np.zeros((h, w, channels), np.uint8)
    for x, y, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        part = px[y::dy, x::dx]
        if not part.size:
            continue
        ph, pw = part.shape[:2]
        line = -(-pw * channels * depth // 8)
        rows = _unfiltered(raw[at : at + ph * (1 + line)].reshape(ph, 1 + line), max(1, channels * depth // 8))
        at += ph * (1 + line)
        if depth == 16:
            rows = ((rows.reshape(ph, -1, 2) @ np.array([256, 1]) + 128) // 257).astype(np.uint8)
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1)[:, : pw * channels * depth].reshape(ph, -1, depth)
            rows = (bits @ (1 << np.arange(depth)[::-1]) * (1 if kind == 3 else 255 // (2**depth - 1))).astype(np.uint8)
        part[:] = rows.reshape(ph, pw, channels)
    if kind != 3:
        return px
    if palette is None or px.max(initial=0) >= len(palette):
        raise ValueError("a PNG without its palette")
    return palette[px[:, :, 0]]


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without the filter that their first byte names; ``step`` is the bytes of a pixel."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int64)
    for y in range(len(raw)):
        line, how = raw[y, 1:].astype(np.int64), raw[y, 0]
        if how == 2:
            line = (line + above) & 255
        elif how in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - step] if x >= step else 0
                b, c = above[x], above[x - step] if x >= step else 0
                if how == 1:
                    near = a
                elif how == 3:
                    near = (a + b) // 2
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + near) & 255
        out[y], above = line, line
    return out


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit channels (height, width, 1 to 4)."""
    h, w, n = pixels.shape
    chunk = lambda name, d: struct.pack(">I", len(d)) + name + d + struct.pack(">I", zlib.crc32(name + d))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def thumbnail(data: bytes, edge: int) -> bytes:
    """The thumbnail (see :func:`shrunk`) of a PNG's bytes.  ValueError for others."""
    return shrunk(png_pixels(data), edge)


def shrunk(pixels: np.ndarray, edge: int) -> bytes:
    """A PNG of channels (height, width, n) whose longer side is at most ``edge`` (from 64 to 1024), in
    proportion; a smaller image keeps its size."""
    px, edge = pixels.astype(np.float64), max(64, min(1024, edge))
    h, w = px.shape[:2]
    scale = min(1.0, edge / max(h, w))
    th, tw = max(1, round(h * scale)), max(1, round(w * scale))
    small = np.stack([_lanczos(h, th) @ px[:, :, i] @ _lanczos(w, tw).T for i in range(px.shape[2])], axis=2)
    return encode_png(np.clip(np.rint(small), 0, 255).astype(np.uint8))


def image_thumbnail(data: Column, edge: int = 256) -> Column:
    """Thumbnails of a binary column of PNGs; NULL for others, whose files :func:`decoded_thumbnails` reads."""

    def one(d: bytes | None) -> bytes | None:
        try:
            return thumbnail(d or b"", edge)
        except (ValueError, struct.error, zlib.error):
            return None

    return arrow_udf(lambda data: pd.Series([one(d) for d in data], dtype=object), "binary")(data)


def _plain_path(origin: Column) -> Column:
    """A file's path of its URI, in which all but a plus is percent-encoded."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(origin, "^file:(?://)?", ""), r"\+", "%2B"))


def _no_pattern(path: str) -> str:
    """A path whose name is no pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def decoded_hashes(spark: SparkSession, place: str | list[str], orientation: DataFrame | None = None) -> DataFrame:
    """(path, width, height, dhash) of images that Spark's image source decodes (JPEG, PNG, BMP, GIF),
    all below a folder or those of a list of files, turned upright by ``orientation`` (path,
    orientation).  In a folder that source skips folders whose names begin with a dot or an
    underscore; what it can't decode is left out."""
    places = [_no_pattern(p) for p in ([place] if isinstance(place, str) else place)]
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(places)
    df = df.select(_plain_path(F.col("image.origin")).alias("path"), "image.width", "image.height", "image.nChannels", "image.data")
    turned = df.withColumn("orientation", F.lit(None).cast("bigint")) if orientation is None else df.join(orientation.select("path", "orientation"), "path", "left")

    def run(h: pd.Series, w: pd.Series, n: pd.Series, data: pd.Series, turn: pd.Series) -> pd.Series:
        out = []
        for height, width, channels, d, o in zip(h, w, n, data, turn):
            px = np.frombuffer(d, np.uint8).reshape(height, width, channels)
            g = px[:, :, 0].astype(np.float64) if channels < 3 else grey(px[:, :, 2::-1])
            out.append(dhash(oriented(g, None if pd.isna(o) else int(o))))
        return pd.Series(out, dtype="Int64")

    hashed = arrow_udf(run, "bigint")("height", "width", "nChannels", "data", "orientation")
    return turned.select("path", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), hashed.alias("dhash"))


def decoded_thumbnails(spark: SparkSession, place: str, edge: int = 256) -> DataFrame:
    """(path, thumbnail) of an image file, or of all images below a folder, that Spark's image source
    decodes; see :func:`decoded_hashes`."""
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(_no_pattern(place))
    df = df.select(_plain_path(F.col("image.origin")).alias("path"), "image.width", "image.height", "image.nChannels", "image.data")

    def run(h: pd.Series, w: pd.Series, n: pd.Series, data: pd.Series) -> pd.Series:
        order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}
        return pd.Series([shrunk(np.frombuffer(d, np.uint8).reshape(height, width, channels)[:, :, order[channels]], edge) for height, width, channels, d in zip(h, w, n, data)], dtype=object)

    return df.select("path", arrow_udf(run, "binary")("height", "width", "nChannels", "data").alias("thumbnail"))


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of the first three channels."""
    return rgb[:, :, :3].astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])


def oriented(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """Pixels turned upright by an EXIF orientation; unknown ones leave them as they are."""
    turns = {2: (0, "x"), 3: (2, ""), 4: (0, "y"), 5: (-1, "x"), 6: (-1, ""), 7: (1, "x"), 8: (1, "")}
    if orientation not in turns:
        return pixels
    quarter, flip = turns[orientation]
    out = np.rot90(pixels, quarter)
    return out[:, ::-1] if flip == "x" else out[::-1] if flip == "y" else out


def _lanczos(size: int, to: int, lobes: int = 3) -> np.ndarray:
    """Weights (to, size) of a Lanczos resampling, widened for reduction."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def grid(pixels: np.ndarray) -> np.ndarray:
    """Grey values reduced to 8 rows of 9, rounded to whole numbers from 0 to 255."""
    h, w = pixels.shape
    return np.clip(np.rint(_lanczos(h, 8) @ pixels @ _lanczos(w, 9).T), 0, 255).astype(np.int64)


def dhash(pixels: np.ndarray) -> int:
    """The difference hash of grey values as a signed 64-bit number."""
    g = grid(pixels)
    bits = (g[:, :-1] > g[:, 1:]).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64))


def image_dhash(data: Column, orientation: Column) -> Column:
    """Difference hashes of PNG bytes, turned upright; NULL for what can't be decoded."""

    def one(d: bytes | None, o: float | None) -> int | None:
        try:
            return dhash(oriented(decode_png(d or b""), None if pd.isna(o) else int(o)))
        except (ValueError, struct.error, zlib.error):
            return None

    def run(data: pd.Series, orientation: pd.Series) -> pd.Series:
        return pd.Series([one(d, o) for d, o in zip(data, orientation)], dtype="Int64")

    return arrow_udf(run, "bigint")(data, orientation)


def content_hash(data: Column) -> Column:
    """A 256-bit hash of a binary column.  Only equality of contents is asked of it, which any such
    hash gives; the built-in one stays in the JVM."""
    return F.unhex(F.sha2(data, 256))


def file_hash(path: str, chunk: int = 1 << 20) -> bytes:
    """The same hash of a file, read in pieces, so that a large file is never in memory."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(chunk):
            h.update(piece)
    return h.digest()
