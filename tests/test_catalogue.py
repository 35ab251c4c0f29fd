import base64
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import cli, schemas
from pixelloom.functions import dates, paths, values
from pixelloom.functions.skew import join_hot, lookup
from pixelloom.operators import catalogue, classify, duplicates, indexing, organize
from pixelloom.service import Service
from pixelloom.session import Staging, fan_out
from pixelloom.sinks.store import Store
from pixelloom.sources import exif, images, scan, sidecar
from pixelloom.streaming.incremental import LISTING, follow


def png(pixels, extra=b""):
    """A PNG of grey or RGB values."""
    p = np.asarray(pixels, np.uint8)
    kind = 0 if p.ndim == 2 else 2
    h, w = p.shape[:2]
    body = zlib.compress(b"".join(b"\0" + p[y].tobytes() for y in range(h)))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def tiff(order="<"):
    """An EXIF block with make, orientation, a date and a location."""
    text = lambda s: s.encode() + b"\0"
    blobs, at = b"", 8 + 2 + 12 * 4 + 4

    def entry(tag, kind, n, data):
        nonlocal blobs
        if len(data) <= 4:
            return struct.pack(order + "HHI", tag, kind, n) + data.ljust(4, b"\0")
        off = at + len(blobs)
        blobs += data
        return struct.pack(order + "HHII", tag, kind, n, off)

    def ifd(entries):
        return struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0"

    make = entry(0x010F, 2, 8, text(" Canon "))
    turn = entry(0x0112, 3, 1, struct.pack(order + "H", 6))
    sub_at = at + len(blobs)
    date = text("2023:01:15 12:30:00")
    sub = ifd([struct.pack(order + "HHII", 0x9003, 2, len(date), sub_at + 2 + 12 + 4)])
    blobs += sub + date
    gps_at = at + len(blobs)
    data_at = gps_at + 2 + 12 * 4 + 4
    deg = struct.pack(order + "6I", 37, 1, 30, 1, 0, 1)
    gps = ifd([
        struct.pack(order + "HHI", 1, 2, 2) + b"s\0\0\0", struct.pack(order + "HHII", 2, 5, 3, data_at),
        struct.pack(order + "HHI", 3, 2, 2) + b"E\0\0\0", struct.pack(order + "HHII", 4, 5, 3, data_at),
    ])
    blobs += gps + deg
    main = ifd([make, turn, struct.pack(order + "HHII", 0x8769, 4, 1, sub_at), struct.pack(order + "HHII", 0x8825, 4, 1, gps_at)])
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + main + blobs


def photo(seed, n=64):
    y, x = np.mgrid[0:n, 0:n] / n
    rng = np.random.default_rng(seed)
    f = rng.uniform(1, 4, 4)
    return np.clip(128 + 60 * np.sin(f[0] * 6 * x + f[1] * 5 * y) + 60 * np.cos(f[2] * 5 * y - f[3] * 3 * x), 0, 255).astype(np.uint8)


def test_exif_block_in_either_order():
    for order in "<>":
        block = tiff(order)
        jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
        for data in (block, jpeg):
            e = exif.read_exif(data)
            assert (e["make"], e["orientation"], e["datetime_original"], e["model"]) == ("Canon", 6, "2023:01:15 12:30:00", None)
            assert e["gps_lat"] == -37.5 and e["gps_lon"] == 37.5
    assert set(exif.read_exif(b"junk").values()) == set(exif.read_exif(None).values()) == set(exif.read_exif(block[:30]).values()) == {None}


def heic(block, gap):
    """A HEIF file whose Exif item lies behind ``gap`` bytes of picture data."""
    box = lambda kind, d: struct.pack(">I4s", len(d) + 8, kind) + d
    item = struct.pack(">I", 6) + b"Exif\0\0" + block
    # An empty item name after the kind gives Exif and two NULs, as cameras write it.
    infos = [box(b"infe", b"\2\0\0\0" + struct.pack(">HH4s", i, 0, kind) + b"\0") for i, kind in ((1, b"hvc1"), (2, b"Exif"), (3, b"mime"))]
    start = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    meta = lambda at: box(b"meta", bytes(4) + box(b"iinf", bytes(4) + struct.pack(">H", 3) + b"".join(infos)) + box(b"iloc", bytes(4) + struct.pack(">HHHHHII", 0x4400, 1, 2, 0, 1, at, len(item))))
    return start + meta(len(start) + len(meta(0)) + 8 + gap) + box(b"mdat", bytes(gap) + item)


def test_files_are_read_to_their_end(tmp_path):
    gap, block, p = (1 << 20) + 12345, tiff(), photo(1)
    whole = png(p)[:-12]
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    riff = lambda n, d: n + struct.pack("<I", len(d)) + d + bytes(len(d) % 2)
    body = b"WEBP" + riff(b"VP8X", bytes(4) + (63).to_bytes(3, "little") * 2) + riff(b"VP8L", bytes(gap)) + riff(b"EXIF", block)
    padding = (b"\xff\xe2" + struct.pack(">H", 65535) + bytes(65533)) * 17
    app1 = b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
    ifd_last = b"II*\0" + struct.pack("<I", gap) + bytes(gap - 8) + struct.pack("<HHHIHHI", 1, 0x0112, 3, 1, 6, 0, 0)
    for name, data, size in [
        ("a.png", whole + chunk(b"teXt", bytes(gap)) + chunk(b"eXIf", block) + chunk(b"IEND", b""), (64, 64)),
        ("a.webp", b"RIFF" + struct.pack("<I", len(body)) + body, (64, 64)),
        ("a.heic", heic(block, gap), (None, None)), ("b.heic", b"\0\0\0\x10ftypheic\0\0\0\0" + bytes(gap) + b"Exif\0\0" + block, (None, None)),
        ("a.jpg", b"\xff\xd8" + padding + app1 + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 7, 9, 0) + b"\xff\xd9", (9, 7)),
    ]:
        (tmp_path / name).write_bytes(data)
        row = indexing.read_one(str(tmp_path / name), len(data), 1)
        assert (row["make"], row["orientation"], row["datetime_original"], row["gps_lat"], row["error"]) == ("Canon", 6, "2023:01:15 12:30:00", -37.5, None), name
        assert (row["width"], row["height"]) == size, name
        assert exif.read_exif(data)["make"] == "Canon"
        if name == "a.png":
            assert row["dhash"] == images.dhash(images.oriented(p.astype(float), 6))
    (tmp_path / "a.tif").write_bytes(ifd_last)
    assert indexing.read_one(str(tmp_path / "a.tif"), 1, 1)["orientation"] == 6
    (tmp_path / "cut.heic").write_bytes(heic(block, gap)[:150])
    assert indexing.read_one(str(tmp_path / "cut.heic"), 1, 1)["make"] is None
    # A match that starts in one piece and ends in the next.
    with (tmp_path / "a.heic").open("rb") as f:
        some = exif.FileBytes(f)
        assert [some.find(b"mif1heic", 0, n) for n in (1, 3, 5, 1000)] == [16] * 4 and some.find(b"nowhere") == -1


def test_dhash_properties():
    a, b = photo(1), photo(2)
    bits = lambda x, y: int(np.bitwise_count(np.int64(x) ^ np.int64(y))) if (x ^ y) >= 0 else int(np.bitwise_count(np.array([x ^ y]).view(np.uint64))[0])
    noisy = np.clip(a + np.random.default_rng(0).normal(0, 2, a.shape), 0, 255)
    assert bits(images.dhash(a.astype(float)), images.dhash(noisy)) <= 5
    assert bits(images.dhash(a.astype(float)), images.dhash(b.astype(float))) > 20
    assert images.dhash(images.oriented(np.rot90(a, 1), 6).astype(float)) == images.dhash(a.astype(float))
    for o in range(1, 9):
        assert images.oriented(a, o).shape == a.shape
    assert (images.oriented(a, None) == a).all() and (images.oriented(a, 9) == a).all()


def test_png_filters_and_dimensions():
    p = photo(3, 16)
    assert (images.decode_png(png(p)) == p).all()
    assert images.dimensions(png(p)) == (16, 16) and images.dimensions(b"GIF89a\x05\0\x07\0") == (5, 7) and images.dimensions(b"?") == images.dimensions(None) == (None, None)
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")


def test_image_columns(spark):
    df = spark.createDataFrame([(bytearray(png(photo(1))), 1), (bytearray(b"bad"), None), (None, 6)], "data binary, o int")
    got = df.select(images.image_dhash(F.col("data"), F.col("o")).alias("h"), images.header_dimensions(F.col("data")).alias("d"), exif.exif_fields(F.col("data")).alias("e")).collect()
    assert got[0]["h"] is not None and got[0]["d"]["width"] == 64 and got[1]["h"] is None and got[2]["d"]["width"] is None and got[0]["e"]["make"] is None


def test_gradient_fold(spark):
    grid = [[9 - x for x in range(9)] for _ in range(8)]
    df = spark.createDataFrame([(sum(grid, []),), ([1] * 72,), ([1, 2],), (None,)], "g array<bigint>")
    assert [r[0] for r in df.select(values.fold_gradient(F.col("g"))).collect()] == [-1, 0, None, None]


@pytest.mark.parametrize(("text", "want"), [
    ('{"photoTakenTime":{"timestamp":"1673784000"},"geoData":{"latitude":37.5,"longitude":-122.3,"altitude":0}}', ("1673784000", 37.5, -122.3, True)),
    ('{"geoData":{"latitude":1}}', (None, 1.0, 0.0, True)), ("{}", (None, None, None, True)), ('{"photoTakenTime":null}', (None, None, None, True)),
    ('{"photoTakenTime":{"timestamp":5}}', (None, None, None, False)), ('{"geoData":{"latitude":"1"}}', (None, None, None, False)), ('{"geoData":{"latitude":NaN}}', (None, None, None, False)),
    ("{} x", (None, None, None, False)), ("{'a':1}", (None, None, None, False)), ("[]", (None, None, None, False)), ("", (None, None, None, False)), (None, (None, None, None, False)),
])
def test_strict_sidecars(text, want):
    assert sidecar.read_strict(text) == want


def test_sidecar_columns(spark):
    s = spark.createDataFrame([("a.jpg.json", '{"photoTakenTime":{"timestamp":"0"}}'), ("a.jpg.supplemental-metadata.json", "bad"), ("b.jpg.json", '{"photoTakenTime":{"timestamp":" 5"},"geoData":{"latitude":0,"longitude":2}}')], "path string, text string")
    got = {r["path"]: r["text"] for r in sidecar.of_images(spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "path string"), s).collect()}
    assert got["a.jpg"] == "bad" and got["c.jpg"] is None
    assert {r["path"]: tuple(r)[1:] for r in sidecar.parsed(s).collect()} == {"a.jpg.json": ("1970-01-01T00:00:00Z", None, None), "a.jpg.supplemental-metadata.json": (None, None, None), "b.jpg.json": (None, 0.0, 2.0)}


def test_dates(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    for s, want in [(0, "1970-01-01T00:00:00Z"), (1673784000, "2023-01-15T12:00:00Z"), (-1, "1969-12-31T23:59:59Z"), (951782400, "2000-02-29T00:00:00Z"), (None, None)]:
        assert one(dates.unix_to_iso(F.lit(s).cast("bigint"))) == want
    for s, want in [("2023:01:15 12:30:00", "2023-01-15T12:30:00"), ("2023:1:5 24:99:99", "2023-01-05T24:99:99"), ("0000:00:00 00:00:00", None), ("2023:13:01 0", None), ("2023:01:01", None), ("", None), (None, None)]:
        assert one(dates.normalize_exif(F.lit(s).cast("string"))) == want
    for s, want in [("IMG_20230115_123456", "2023-01-15T12:34:56"), ("a 2023-01-15", "2023-01-15T00:00:00"), ("2023.1_15", None), ("IMG-20230115-WA0001", "2023-01-15T00:00:00"), ("18990101", None)]:
        assert one(dates.filename_date(F.lit(s))) == want
    for s, want in [("2023-01-15T", r"2023\01"), ("2023:01", "undated"), ("2023-0", "undated"), (None, "undated")]:
        assert one(dates.month_folder(F.lit(s).cast("string"))) == want


def test_paths(spark):
    df = spark.createDataFrame([(r"C:\A/b\c.tar.GZ",), (".png",), (r"a\.png",), ("noext",), ("",), (None,), ("x/",)], "p string")
    got = [tuple(r) for r in df.select(paths.extension(F.col("p")), paths.file_name(F.col("p")), paths.stem(F.col("p")), F.size(paths.ancestors(F.col("p")))).collect()]
    assert got[:4] == [("GZ", "c.tar.GZ", "c.tar", 4), ("", ".png", ".png", 1), ("", ".png", ".png", 2), ("", "noext", "noext", 1)] and got[4] == ("", "", "", 0)
    assert df.select(paths.ascii_lower(F.lit("K\u212aİ"))).first()[0] == "k\u212aİ"


def test_bytes_and_small_values(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert [one(values.human_bytes(F.lit(n))) for n in (5, 1024, 1025, 1048577)] == ["5 B", "1024 B", "1 KB", "1.0 MB"]
    assert one(values.data_url(F.lit(bytes(200)))).count("\n") == 0
    assert [one(values.parse_int(F.lit(x))) for x in ("+5", "-7", " 5", "5.0", "99999999999999999999")] == [5, -7, None, None, None]


FACTS = [(r"C:\p\IMG_1.jpg", 4032, 3024, "Canon", "exif_camera"), (r"C:\p\Screenshot_2023.jpg", None, None, None, "screenshot_filename"), (r"C:\app\CACHE/img.jpg", None, None, None, "asset_path"), (r"C:\p\grab.jpg", 1080, 1920, None, "screen_resolution"), (r"C:\p\export.PNG", 640, 480, None, "png_no_exif"), (r"C:\p\holiday.jpg", 640, 480, None, "none"), (r"C:\p\x.jpg", 10**12, 720, None, "none")]


def files_frame(spark, rows):
    """A catalogue with the given columns and NULL elsewhere."""
    names = [c.split()[0] for c in schemas.FILES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.FILES)


def test_rules_in_order(spark):
    f = files_frame(spark, [{"id": i, "path": p, "width": w, "height": h, "exif_make": m} for i, (p, w, h, m, _) in enumerate(FACTS)])
    assert [r["rule"] for r in classify.classified(f).orderBy("id").collect()] == [x[4] for x in FACTS]


def test_manual_labels_and_accuracy(spark):
    f = files_frame(spark, [{"id": i, "path": p, "classification": c, "class_rule": r} for i, (p, c, r) in enumerate([("a", "photo", "manual"), ("b,c", "non_photo", "x"), ("c", "ambiguous", None), ("d", None, None)])])
    assert classify.relabelled(f).filter("id = 0").first()["class_rule"] == "manual"
    lines = spark.createDataFrame([(x,) for x in ("a,photo", " b,c , PHOTO ", "c,photo", "gone,photo", "# x,photo", "", "nothing", "d,photo")], "value string")
    got = classify.accuracy(classify.truth_from_lines(lines), f).first().asDict()
    assert got == {"total": 5, "missing": 2, "correct": 1, "wrong": 1, "undecided": 1, "accuracy": 0.5}
    with pytest.raises(Exception, match="unknown label"):
        classify.with_manual_labels(f, spark.createDataFrame([(1, "cat")], "id bigint, label string")).collect()
    assert classify.accuracy(classify.truth_from_lines(lines.limit(0)), f).first()["accuracy"] == 0.0


def test_duplicate_reports(spark):
    f = files_frame(spark, [{"id": i, "path": p, "size": s} for i, p, s in [(1, "a.jpg", 100), (2, "b.jpg", 100), (3, "c.jpg", 50)]])
    h = spark.createDataFrame([(1, b"aa", 255), (2, b"aa", 255), (3, b"bb", 254), (9, b"bb", None), (4, None, None)], schemas.HASHES)
    assert [tuple(r) for r in duplicates.report(duplicates.exact_members(f, h), 0).collect()] == [(1, 2, 100, 100, 0)]
    near = duplicates.with_catalogue(duplicates.near_groups(h, 2), f)
    assert [tuple(r) for r in duplicates.report(near, 2).collect()] == [(1, 3, 100, 150, 2)]
    assert duplicates.nested_report(near, 2).first()["wasted_bytes"] == 150
    assert [(r["file_id"], r["rank"]) for r in duplicates.ranked_members(near).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(ValueError):
        duplicates.near_groups(h, 2, "guess")


def walk_names(rows):
    """Names in order, one after the other."""
    claimed, out = set(), []
    for _, _, dst in sorted(rows, key=lambda r: r[1].encode()):
        folder, _, name = dst.rpartition("\\")
        cut = name.rfind(".")
        stem, ext = (name[:cut], name[cut:]) if cut > 0 else (name, "")
        got, n = dst, 0
        while got in claimed:
            n += 1
            got = f"{folder}\\{stem} ({n}){ext}"
        claimed.add(got)
        out.append(got)
    return out


def test_names_never_collide(spark):
    names = ["a.jpg"] * 7 + ["a (1).jpg", "a (3).jpg", "a (1) (1).jpg", "b", "b", ".c", ".c", "A.jpg", "x.tar.gz", "x.tar.gz"]
    rows = [(i, f"s{(i * 7) % 17:02d}", f"T\\{n}") for i, n in enumerate(names)]
    got = {r["src"]: r["dst"] for r in organize.collision_safe(spark.createDataFrame(rows, "file_id bigint, src string, dst string")).collect()}
    assert [got[s] for s in sorted(got)] == walk_names(rows)
    taken = spark.createDataFrame([("T\\b",)], "dst string")
    assert {r["dst"] for r in organize.collision_safe(spark.createDataFrame([(1, "s", "T\\b")], "file_id bigint, src string, dst string"), taken).collect()} == {"T\\b (1)"}


def test_undo_log(spark):
    log = spark.createDataFrame([(1, 5, "move", "a", "b"), (2, 4, "copy", "c", "d"), (3, 6, "move", "e", "f"), (3, 6, "move", "e", "f"), (4, 1, None, "g", "h"), (5, 1, "move", "i", None)], schemas.UNDO_LOG)
    last = organize.last_moves(log, 2)
    assert [r["id"] for r in last.collect()] == [3, 1]
    f = files_frame(spark, [{"id": 1, "path": "b"}, {"id": 2, "path": "f"}, {"id": 3, "path": "z"}])
    assert sorted(r["path"] for r in organize.after_undo(f, last).collect()) == ["a", "e", "z"]


def test_upserts(spark):
    f = files_frame(spark, [{"id": 5, "path": "a", "size": 1, "class_rule": "manual"}])
    new = files_frame(spark, [{"path": "a", "size": 9, "mtime": 2}, {"path": "c", "size": 3, "mtime": 1}, {"path": "b", "size": 4, "mtime": 1}, {"path": "b", "size": 7, "mtime": 2}, {"path": None}])
    assert sorted(tuple(r) for r in catalogue.upsert_files(f, new).select("id", "path", "size", "class_rule").collect()) == [(5, "a", 9, "manual"), (6, "b", 7, None), (7, "c", 3, None)]
    h = spark.createDataFrame([(5, b"x", 1)], schemas.HASHES)
    inc = lambda b, d: spark.createDataFrame([("a", b, d), ("zz", b"q", 1)], "path string, blake3 binary, dhash bigint")
    assert [tuple(r) for r in catalogue.upsert_hashes(h, inc(None, None), f).collect()] == [(5, b"x", 1)]
    assert [tuple(r) for r in catalogue.upsert_hashes(h, inc(None, 7), f).collect()] == [(5, None, 7)]


def test_skip_rules(spark):
    df = spark.createDataFrame([(r"C:\ok\a.jpg",), (r"c:/Private/x\a.jpg",), (r"C:\PRIVATE",), (r"C:\Private2\a.jpg",), (r"\\srv\a.jpg",), (None,)], "path string")
    skips = spark.createDataFrame([(1, "C:\\private\\"), (2, None)], schemas.SKIP_DIRS)
    assert {r[0] for r in catalogue.without_skipped(df, skips).collect()} == {r"C:\ok\a.jpg", r"C:\Private2\a.jpg", r"\\srv\a.jpg", None}
    everything = spark.createDataFrame([(1, "\\")], schemas.SKIP_DIRS)
    assert r"\\srv\a.jpg" not in {r[0] for r in catalogue.without_skipped(df, everything).collect()}


def test_hot_keys_join_like_any(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).filter("k % 2 = 1")
    for how in ("inner", "left"):
        hot = join_hot(left, right, "k", "n", 3000, how, floor=10)
        assert sorted(hot.collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)
        for floor in (10, 10**6):
            assert sorted(lookup(left, right.drop("n"), "k", 3000, how, floor).collect(), key=str) == sorted(left.join(right.drop("n"), "k", how).collect(), key=str)


def test_staging_and_fan_out(spark):
    area = Staging(spark, "t")
    t = area.write(spark.range(5).toDF("x"))
    assert t.count() == 5 and fan_out(spark, 0, 10) == 8 and fan_out(spark, 1000, 10) == 100
    area.drop(t, None)


@pytest.fixture
def album(tmp_path):
    """Three images, of which one is a copy, with a sidecar, a skipped folder and another file."""
    root = tmp_path / "album"
    (root / "node_modules").mkdir(parents=True)
    (root / "private").mkdir()
    a = png(photo(1))
    (root / "IMG_20230115_101010.png").write_bytes(a)
    (root / "b.PNG").write_bytes(a)
    (root / "b.PNG.json").write_text(json.dumps({"title": "b", "photoTakenTime": {"timestamp": "1673784000"}, "geoData": {"latitude": 37.5, "longitude": -122.3, "altitude": 0}}))
    (root / "plain.png").write_bytes(png(photo(2)))
    (root / "notes.txt").write_text("x")
    (root / "node_modules" / "x.png").write_bytes(a)
    (root / "private" / "p.png").write_bytes(png(photo(5)))
    return root


def test_thumbnails():
    p = np.stack([photo(1, 200)] * 3, axis=2)
    small = images.thumbnail(images.encode_png(p[:, :100]), 80)
    assert images.dimensions(small) == (40, 80) and images.png_pixels(small).shape == (80, 40, 3)
    assert images.dimensions(images.thumbnail(png(photo(1, 32)), 64)) == (32, 32)
    with pytest.raises(ValueError):
        images.thumbnail(b"x", 64)


def test_thumbnails_of_every_depth_and_kind(spark, tmp_path):
    p, chunk = photo(1, 20), lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    made = lambda depth, kind, woven, rows, extra=b"": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 20, 20, depth, kind, 0, 0, woven)) + extra + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")
    assert (images.png_pixels(made(16, 0, 0, [(r.astype(">u2") * 257).tobytes() for r in p]))[:, :, 0] == p).all()
    bit = p > 128
    assert (images.png_pixels(made(1, 0, 0, [np.packbits(r).tobytes() for r in bit]))[:, :, 0] == bit * 255).all()
    assert (images.png_pixels(made(1, 3, 0, [np.packbits(r).tobytes() for r in bit], chunk(b"PLTE", bytes([9, 8, 7, 1, 2, 3])))) == np.where(bit[:, :, None], [1, 2, 3], [9, 8, 7])).all()
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    assert (images.png_pixels(made(8, 0, 1, [r.tobytes() for x, y, dx, dy in passes for r in p[y::dy, x::dx]]))[:, :, 0] == p).all()
    jvm, service, wide = spark._jvm, Service(Store(spark, str(tmp_path / "db"))), photo(4)[:32]
    img = jvm.java.awt.image.BufferedImage(64, 32, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(32):
        for x in range(64):
            img.setRGB(x, y, int(wide[y, x]) << 16)
    for kind in ("jpg", "bmp", "gif"):
        path = tmp_path / f"a [1]% {kind}.{kind}"
        jvm.javax.imageio.ImageIO.write(img, kind, jvm.java.io.File(str(path)))
        got = images.png_pixels(base64.b64decode(service.thumbnail(str(path), 64).partition(",")[2]))
        assert got.shape == (32, 64, 3) and np.abs(got[:, :, 0].astype(int) - wide).mean() < 12 and got[:, :, 2].mean() < 12, kind
    (tmp_path / "bad.jpg").write_bytes(b"no picture")
    assert service.thumbnail(str(tmp_path / "bad.jpg")) is None


def test_jpegs_are_hashed_by_the_image_source(spark, tmp_path):
    jvm, p = spark._jvm, photo(4)
    img = jvm.java.awt.image.BufferedImage(64, 64, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(64):
        for x in range(64):
            img.setRGB(x, y, int(p[y, x]) * 0x010101)
    jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(str(tmp_path / "a b.jpg")))
    (tmp_path / "bad.jpg").write_bytes(b"no picture")
    rows, stats = indexing.index(scan.enumerate_images(spark, str(tmp_path)), files_frame(spark, []), str(tmp_path))
    got = {os.path.basename(r["path"]): r for r in rows.collect()}
    assert stats["added"] == 2 and got["bad.jpg"]["dhash"] is None and got["a b.jpg"]["width"] == 64
    apart = np.bitwise_count(np.array([got["a b.jpg"]["dhash"] ^ images.dhash(p.astype(float))]).view(np.uint64))
    assert apart[0] <= 5


def test_index_resume_and_sources(spark, album, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.create()
    listed = scan.enumerate_images(spark, str(album), [str(album / "PRIVATE")])
    assert listed.count() == 3 and scan.enumerate_images(spark, str(album), [str(album)]).count() == 0
    rows, stats = indexing.index(listed, store.read("files"))
    assert stats == {"scanned": 3, "added": 3, "skipped": 0, "errors": 0}
    store.write("files", catalogue.upsert_files(store.read("files"), rows))
    store.write("hashes", catalogue.upsert_hashes(store.read("hashes"), rows.select("path", "blake3", "dhash"), store.read("files")))
    by = {os.path.basename(r["path"]): r for r in store.read("files").collect()}
    assert {n: r["date_source"] for n, r in by.items()} == {"IMG_20230115_101010.png": "filename", "b.PNG": "sidecar", "plain.png": "mtime"}
    assert by["b.PNG"]["sidecar_taken_time"] == "2023-01-15T12:00:00Z" and by["b.PNG"]["sidecar_lat"] == 37.5 and by["plain.png"]["width"] == 64
    _, again = indexing.index(listed, store.read("files"))
    assert again == {"scanned": 3, "added": 0, "skipped": 3, "errors": 0}
    assert duplicates.report(duplicates.exact_members(store.read("files"), store.read("hashes")), 0).count() == 1
    assert store._versions("files") == [1, 2]


def test_moves_are_carried_out_and_undone(spark, album, tmp_path):
    service = Service(Store(spark, str(tmp_path / "db")))
    heard = []
    assert service.scan_dir(str(album), lambda done, total: heard.append((done, total)))["added"] == 4 and heard
    before = {r["path"] for r in service._table("files").collect()}
    target = tmp_path / "sorted"
    plan = service.organize_plan(str(target))
    assert plan.count() == 4 == plan.select("dst").distinct().count()
    assert service.organize(str(target)) == {"moved": 4, "errors": 0}
    moved = {r["path"] for r in service._table("files").collect()}
    assert moved == {str(p) for p in target.rglob("*.*") if p.is_file()} and (target / "2023" / "01" / "IMG_20230115_101010.png").exists()
    assert service.organize_plan(str(target)).count() == 0
    assert service.undo_moves(10) == {"moved": 4, "errors": 0}
    assert {r["path"] for r in service._table("files").collect()} == before == {p for p in before if os.path.exists(p)}
    assert service._table("undo_log").count() == 0
    assert service.organize(str(target), copy=True)["moved"] == 4 and service.undo_moves(5) == {"moved": 0, "errors": 0}
    one = str(album / "plain.png")
    assert service.move_to_duplicates([one, str(album / "gone.png")]) == {"moved": 1, "errors": 1}
    assert (album / "_Duplicates" / "plain.png").exists() and service.move_to_duplicates([]) == {"moved": 0, "errors": 0}
    assert service.run_classifier()["non_photo"] == 4
    queue = service.review_queue(2).collect()
    service.set_label(queue[0]["id"], "photo")
    assert service.export_labels(str(tmp_path / "labels")) == 1 and service.review_queue().count() == 3
    with pytest.raises(ValueError):
        service.set_label(1, "cat")
    assert service.thumbnail(str(album / "b.PNG"), 64).startswith("data:image/png;base64,") and service.thumbnail("nowhere") is None


def test_moves_may_be_repeated(spark, tmp_path):
    from pixelloom.sinks import files as sink

    for name in "abc":
        (tmp_path / name).write_text(name)
    (tmp_path / "to").mkdir()
    (tmp_path / "to" / "c").write_text("another")
    plan = spark.createDataFrame([(i, str(tmp_path / n), str(tmp_path / "to" / n)) for i, n in enumerate("abcx")], "file_id bigint, src string, dst string")
    once = sorted(map(tuple, sink.execute(plan).collect()))
    assert sorted(map(tuple, sink.execute(plan).collect())) == once  # a task that runs again
    assert [r[4] is None for r in once] == [True, True, False, False] and (tmp_path / "c").read_text() == "c" and (tmp_path / "to" / "c").read_text() == "another"
    copies = plan.filter("file_id < 2").selectExpr("file_id", "dst as src", "src as dst")
    assert [r["error"] for r in sink.execute(copies, "copy").collect()] == [None, None] == [r["error"] for r in sink.execute(copies, "copy").collect()]
    (tmp_path / "a").write_text("changed")
    assert [r["error"] is None for r in sink.execute(copies, "copy").orderBy("file_id").collect()] == [False, True]
    assert not list(tmp_path.rglob("*.part"))


@pytest.mark.parametrize("lost", ["undo_log", "files", "pending"])
def test_moves_of_a_lost_driver_are_finished(spark, album, tmp_path, monkeypatch, lost):
    service = Service(Store(spark, str(tmp_path / "db")))
    service.scan_dir(str(album))
    write, started = Store.write, []

    def failing(self, name, df, keep=2):
        if name == "pending":
            started.append(1)
        if name == lost and len(started) == (2 if lost == "pending" else 1) and started:
            raise RuntimeError("gone")
        return write(self, name, df, keep)

    monkeypatch.setattr(Store, "write", failing)
    with pytest.raises(RuntimeError):
        service.organize(str(tmp_path / "sorted"))
    monkeypatch.setattr(Store, "write", write)
    service = Service(Store(spark, str(tmp_path / "db")))  # the next start
    assert service._table("undo_log").count() == 4 and service._table("pending").count() == 0
    assert {r["path"] for r in service._table("files").collect()} == {str(p) for p in (tmp_path / "sorted").rglob("*.*") if p.is_file()}
    assert service.undo_moves(10) == {"moved": 4, "errors": 0}
    one = str(album / "plain.png")
    assert service.move_to_duplicates([one], str(tmp_path / "elsewhere")) == {"moved": 1, "errors": 0} and (tmp_path / "elsewhere" / "plain.png").exists()


def test_reports_are_printed_whole(spark, capsys):
    from pixelloom import cli

    members = spark.createDataFrame([(g, 100 * g + i, f"/{g}/{i}", 1000 * (61 - g), None, None) for g in range(60) for i in range(25)], "group_id bigint, file_id bigint, path string, size bigint, width bigint, height bigint")
    cli._print_report(duplicates.report(members, 0), members)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 1 + 60 + 60 * 25 and lines[1].startswith("group 0: 25 files") and lines[2].startswith("  /0/0 ")


def test_ranks_of_hot_groups_by_pieces(spark, monkeypatch):
    from pixelloom.functions import ranks

    rows = spark.range(3000).selectExpr("id % 7 = 0 as hot", "id", "id * 7919 % 1000 as v").selectExpr("if(hot, 0, id % 50) as g", "id", "v")
    order = [F.desc_nulls_last("v"), F.col("id")]
    want = {(r["id"], r["rank"]) for r in ranks.ranked(rows, "g", order).collect()}
    assert {(r["id"], r["rank"]) for r in ranks.ranked_by_pieces(rows, "g", order).collect()} == want


def test_plans_leave_taken_names(spark, tmp_path):
    rows = [("D:/Sorted/2023/01/a.jpg", "2023-01-02"), ("C:\\x\\a.jpg", "2023-01-09"), ("C:\\x\\b.jpg", "2023-01-09"), ("D:\\Sorted\\2022\\05\\b.jpg", "2023-01-03"), ("D:\\Sorted2\\c.jpg", "2023-01-03"), ("C:\\y\\b.jpg", "2022-05-01")]
    f = files_frame(spark, [{"id": i, "path": p, "resolved_date": d} for i, (p, d) in enumerate(rows)])
    at = "D:\\Sorted\\"
    assert {r["file_id"]: r["dst"] for r in organize.plan_by_date(f, "D:\\Sorted").collect()} == {1: at + "2023\\01\\a (1).jpg", 2: at + "2023\\01\\b.jpg", 3: at + "2023\\01\\b (1).jpg", 4: at + "2023\\01\\c.jpg", 5: at + "2022\\05\\b (1).jpg"}
    # On disk: a file the catalogue doesn't know, and a folder of a picture's name.
    (tmp_path / "a.jpg").write_text("")
    (tmp_path / "b.jpg").mkdir()
    into = {os.path.basename(r["dst"].replace("\\", "/")) for r in organize.plan_into(spark.createDataFrame([("C:\\x\\a.jpg",), ("C:\\x\\b.jpg",), ("C:\\x\\d.jpg",)], "path string"), f, str(tmp_path)).collect()}
    assert into == {"a (1).jpg", "b (1).jpg", "d.jpg"}


def test_a_second_run_finds_free_names(spark, album, tmp_path):
    service, target = Service(Store(spark, str(tmp_path / "db"))), tmp_path / "sorted"
    service.scan_dir(str(album))
    assert service.organize(str(target)) == {"moved": 4, "errors": 0}
    month = target / "2023" / "01"
    (album / "private").rmdir()  # emptied by the run
    (album / "IMG_20230115_101010.png").write_bytes(png(photo(7)))
    (album / "IMG_20230116_101010.png").write_bytes(png(photo(8)))
    (month / "IMG_20230116_101010.png").write_bytes(b"not in the catalogue")
    assert service.scan_dir(str(album))["added"] == 2
    assert service.organize(str(target)) == {"moved": 2, "errors": 0}
    assert (month / "IMG_20230115_101010 (1).png").read_bytes() == png(photo(7)) and (month / "IMG_20230116_101010 (1).png").exists()
    assert (month / "IMG_20230116_101010.png").read_bytes() == b"not in the catalogue"
    for n in range(2):
        (album / "x.png").write_bytes(png(photo(9 + n)))
        assert service.move_to_duplicates([str(album / "x.png")]) == {"moved": 1, "errors": 0}
    assert (album / "_Duplicates" / "x (1).png").read_bytes() == png(photo(10))


def test_listing_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.write("files", files_frame(spark, [{"id": 1, "path": "a", "size": 1, "mtime": 1}]))
    spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("b", 3, 3)], LISTING).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LISTING).parquet(str(tmp_path / "in"))
    blank = lambda df: df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in schemas.FILES.split(", ")) if n in schemas.METADATA and n not in ("size", "mtime")])
    q = follow(stream, store, blank, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in store.read("files").select("id", "path", "size").collect()) == [(1, "a", 1), (2, "b", 3)]


def test_command_line(spark, album, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli.session, "build_session", lambda *a, **k: spark)
    run = lambda *a: (cli.main(["--db", str(tmp_path / "db"), *a]), capsys.readouterr().out)[1]
    assert "private" in run("skip", "add", str(album / "private"))
    assert "added=3" in run("index", str(album)) and "skipped=3" in run("index", str(album))
    assert "1 groups" in run("dupes") and "groups" in run("near-dupes", "--k", "3")
    assert "photo" in run("classify") and "album" in run("status")
    labels = tmp_path / "truth.csv"
    labels.write_text(f"{album}/plain.png,non_photo\n")
    assert "'correct': 1" in run("accuracy", str(labels))
    assert " -> " in run("organize", str(tmp_path / "out"))
    run("skip", "remove", str(album / "private"))
    assert cli.main(["--db", str(tmp_path / "db"), "skip", "add"]) == 2
