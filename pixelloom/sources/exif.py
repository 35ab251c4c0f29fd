"""EXIF fields of image bytes, by a reader of the TIFF structures that EXIF is made of."""

from __future__ import annotations

import struct
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column

from pixelloom.functions.values import arrow_udf
from pixelloom.schemas import EXIF

#: Tag numbers of the fields, and sizes of the TIFF types.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x9003: "datetime_original", 0x9004: "create_date", 0xA002: "pixel_width", 0xA003: "pixel_height"}
SUB_IFD, GPS_IFD = 0x8769, 0x8825
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
FIELDS = [f.split()[0] for f in EXIF.split(", ")]


class FileBytes:
    """An open file (from ``start`` on) as bytes that are read where they are asked for: of a large
    file only the places a reader visits."""

    def __init__(self, f: BinaryIO, start: int = 0):
        self.f, self.start = f, start
        self.size = max(0, f.seek(0, 2) - start)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        if not isinstance(at, slice):
            if not 0 <= at < self.size:
                raise IndexError(at)
            return self[at : at + 1][0]
        begin, end, _ = at.indices(self.size)
        self.f.seek(self.start + begin)
        return self.f.read(max(0, end - begin))

    def rest(self, at: int) -> FileBytes:
        return FileBytes(self.f, self.start + at)

    def find(self, what: bytes, at: int = 0, piece: int = 1 << 20) -> int:
        """As of bytes; read in pieces that overlap by one byte less than ``what``."""
        while at + len(what) <= self.size:
            found = self[at : at + piece + len(what) - 1].find(what)
            if found >= 0:
                return at + found
            at += piece
        return -1


def _number(data: bytes | FileBytes, at: int, size: int) -> int:
    raw = data[at : at + size]
    if len(raw) < size:
        raise struct.error("cut short")
    return int.from_bytes(raw, "big")


def _boxes(data: bytes | FileBytes, at: int, end: int) -> dict[bytes, list[tuple[int, int]]]:
    """(begin, end) of the contents of the ISO boxes from ``at`` to ``end``, by kind."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    while at + 8 <= end:
        size, kind, head = _number(data, at, 4), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = _number(data, at + 8, 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            break
        out.setdefault(kind, []).append((at + head, min(end, at + size)))
        at += size
    return out


def _heif_item(data: bytes | FileBytes) -> bytes | None:
    """The Exif item that the meta box of a HEIF file lists, wherever in the file it lies."""
    for begin, end in _boxes(data, 0, len(data)).get(b"meta", [])[:1]:
        meta = _boxes(data, begin + 4, end)
        if b"iinf" not in meta or b"iloc" not in meta:
            return None
        at, end = meta[b"iinf"][0]
        wanted = None
        for info, _ in _boxes(data, at + (6 if data[at] == 0 else 8), end).get(b"infe", []):
            wide = 2 if data[info] >= 3 else 0
            if data[info] >= 2 and data[info + 8 + wide : info + 12 + wide] == b"Exif":
                wanted = _number(data, info + 4, 2 + wide)
                break
        at, end = meta[b"iloc"][0]
        version, sizes = data[at], _number(data, at + 4, 2)
        offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, (sizes & 15) * (version in (1, 2))
        wide = 4 if version >= 2 else 2
        count, at = _number(data, at + 6, wide), at + 6 + wide
        for _ in range(count):
            item, at = _number(data, at, wide), at + wide
            method, at = (_number(data, at, 2) & 15, at + 2) if version in (1, 2) else (0, at)
            base, extents, at = _number(data, at + 2, base_size), _number(data, at + 2 + base_size, 2), at + 4 + base_size
            parts = []
            for _ in range(extents):
                at += index_size
                parts.append((_number(data, at, offset_size), _number(data, at + offset_size, length_size)))
                at += offset_size + length_size
            if item != wanted:
                continue
            if method > 1 or (method == 1 and b"idat" not in meta):
                return None
            first, last = meta[b"idat"][0] if method == 1 else (0, len(data))
            raw = b"".join(data[first + base + o : min(last, first + base + o + n) if n else last] for o, n in parts)
            return raw[4 + _number(raw, 0, 4) :]
    return None


def tiff_block(data: bytes | FileBytes) -> bytes | FileBytes | None:
    """The TIFF block of a JPEG (APP1), PNG (eXIf), WebP (EXIF), HEIC (Exif item, else the first Exif
    header before a TIFF) or TIFF."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = struct.unpack(">I", data[at : at + 4])[0]
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = struct.unpack("<I", data[at + 4 : at + 8])[0]
            if data[at : at + 4] == b"EXIF":
                block = data[at + 8 : at + 8 + size]
                return block[6:] if block[:6] == b"Exif\0\0" else block
            at += 8 + size + size % 2
        return None
    if data[4:8] == b"ftyp":
        try:
            block = _heif_item(data)
        except (struct.error, IndexError):
            block = None
        at = -1
        while not block and (at := data.find(b"Exif\0\0", at + 1)) >= 0:
            if data[at + 6 : at + 10] in (b"II*\0", b"MM\0*"):
                block = data.rest(at + 6) if isinstance(data, FileBytes) else data[at + 6 :]
        return block
    return None


def _unpack(form: str, tiff: bytes | FileBytes, at: int) -> tuple:
    return struct.unpack(form, tiff[at : at + struct.calcsize(form)])


def _entries(tiff: bytes | FileBytes, order: str, at: int) -> dict[int, tuple[int, list]]:
    """Values of one directory by tag; entries that reach beyond the block are left out."""
    out = {}
    (count,) = _unpack(order + "H", tiff, at)
    for i in range(count):
        tag, kind, n, _ = _unpack(order + "HHI4s", tiff, at + 2 + 12 * i)
        size = SIZES.get(kind, 0) * n
        if not size:
            continue
        pos = at + 10 + 12 * i if size <= 4 else _unpack(order + "I", tiff, at + 10 + 12 * i)[0]
        raw = tiff[pos : pos + size]
        if len(raw) < size:
            continue
        if kind in (2, 7):
            out.setdefault(tag, (kind, [raw]))
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
            out.setdefault(tag, (kind, list(zip(pairs[::2], pairs[1::2]))))
        else:
            out.setdefault(tag, (kind, list(struct.unpack(order + {1: "B", 3: "H", 4: "I", 9: "i"}[kind] * n, raw))))
    return out


def _text(entry: tuple[int, list] | None) -> str | None:
    """The first string of an ASCII field without NULs and white space around it; None if empty."""
    if entry is None or entry[0] != 2:
        return None
    # A field may hold several strings, each closed by a NUL.
    first = entry[1][0].rstrip(b"\0").split(b"\0")[0]
    return first.decode("utf-8", "replace").strip("\0 \t\r\n\v\f") or None


def _whole(entry: tuple[int, list] | None) -> int | None:
    return entry[1][0] if entry and entry[0] in (3, 4) and entry[1] else None


def _degrees(value: tuple[int, list] | None, ref: tuple[int, list] | None) -> float | None:
    if value is None or ref is None or value[0] != 5 or len(value[1]) < 3 or any(d == 0 for _, d in value[1][:3]):
        return None
    d, m, s = (n / q for n, q in value[1][:3])
    return (d + m / 60 + s / 3600) * (-1.0 if (_text(ref) or "").upper() in ("S", "W") else 1.0)


def read_exif(data: bytes | FileBytes | None) -> dict[str, object]:
    """The wanted fields of an image's bytes; all None if it has no readable EXIF."""
    out: dict[str, object] = dict.fromkeys(FIELDS)
    try:
        tiff = tiff_block(data or b"")
        if not tiff or tiff[:2] not in (b"II", b"MM"):
            return out
        order = "<" if tiff[:2] == b"II" else ">"
        main = _entries(tiff, order, _unpack(order + "I", tiff, 4)[0])
        sub = _entries(tiff, order, main[SUB_IFD][1][0]) if SUB_IFD in main else {}
        gps = _entries(tiff, order, main[GPS_IFD][1][0]) if GPS_IFD in main else {}
        every = sub | main
        for tag, name in TAGS.items():
            out[name] = _whole(every.get(tag)) if name in ("orientation", "pixel_width", "pixel_height") else _text(every.get(tag))
        g = {name: gps.get(tag) for tag, name in GPS_TAGS.items()}
        out["gps_lat"], out["gps_lon"] = _degrees(g["lat"], g["lat_ref"]), _degrees(g["lon"], g["lon_ref"])
    except (struct.error, IndexError, KeyError):
        pass
    return out


def exif_fields(data: Column) -> Column:
    """EXIF fields of a binary column, as a struct."""

    def run(data: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([read_exif(d) for d in data], columns=FIELDS)
        for c in ("orientation", "pixel_width", "pixel_height"):
            rows[c] = rows[c].astype("Int64")
        for c in ("gps_lat", "gps_lon"):
            rows[c] = rows[c].astype("Float64")
        return rows

    return arrow_udf(run, EXIF)(data)
