"""Queries of the catalogue's own operators, named by kind and number, with their SQL oracles.

S sources, K changes, pred predicates, J joins, A aggregates, W and O ranks and orders, F functions,
T incremental forms.  Each runs over its whole tables.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import dates, paths, values
from pixelloom.operators import catalogue, classify, duplicates, hamming, organize
from pixelloom.plans.tables import table
from pixelloom.sources import exif, images, sidecar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TARGET = "D:\\Sorted"


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a function of tables as a query, with its oracle."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, folder: f(*(table(spark, folder, t) for t in tables))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _back(x: str) -> str:
    return rf"replace({x}, '/', '\')"


_PARTS = rf"list_filter(string_split({_back('path')}, '\'), lambda x: x <> '')"
_NAME = rf"regexp_extract({_back('path')}, '([^\\]*)$', 1)"
_EXT = r"regexp_extract(path, '[^\\/]\.([^.\\/]*)$', 1)"
_STEM = rf"regexp_replace({_NAME}, '^(.+)\.[^.]*$', '\1')"
c = F.col


# ---------------------------------------------------------------- sources
# The oracles state fixed values themselves, so that a wrong one in an operator is seen.
_IMAGE = "'jpg', 'jpeg', 'png', 'heic', 'webp', 'bmp', 'gif'"


@query("s2_image_extension", "files", sql=f"SELECT id AS file_id, {_lower(_EXT)} AS extension, {_lower(_EXT)} IN ({_IMAGE}) AS is_image FROM files")
def _s2(files):
    return files.select(c("id").alias("file_id"), paths.ascii_lower(paths.extension(c("path"))).alias("extension"), catalogue.is_image(c("path")).alias("is_image"))


_SKIPPED = "'windows', 'program files', 'program files (x86)', 'programdata', '$recycle.bin', 'system volume information', 'node_modules', '.git', 'windowsapps'"


@query("s3_skipped_names", "files", sql=f"SELECT id AS file_id, list_has_any(p[2:len(p) - 1], [{_SKIPPED}]) AS skipped FROM (SELECT id, list_transform({_PARTS}, lambda x: {_lower('x')}) AS p FROM files)")
def _s3(files):
    return files.select(c("id").alias("file_id"), catalogue.under_skipped_name(c("path")).alias("skipped"))


_UNDER = rf"""EXISTS (SELECT 1 FROM (SELECT rtrim({_lower(_back('path'))}, '\') AS r FROM skip_dirs WHERE path IS NOT NULL) s
  WHERE {_lower(_back('f.path'))} = s.r OR starts_with({_lower(_back('f.path'))}, s.r || '\'))"""


@query("s4_user_skip", "files", "skip_dirs", sql=f"SELECT id AS file_id, path FROM files f WHERE NOT {_UNDER}")
def _s4(files, skips):
    return catalogue.without_skipped(files.select(c("id").alias("file_id"), "path"), skips)


@query("s8_gps_degrees", "files", sql="SELECT id AS file_id, round(CASE WHEN gps_lat < 0 THEN -1 ELSE 1 END * (floor(abs(gps_lat)) + floor((abs(gps_lat) - floor(abs(gps_lat))) * 60) / 60), 9) AS lat FROM files WHERE NOT isnan(gps_lat)")
def _s8(files):
    f = files.select(c("id").alias("file_id"), "gps_lat").filter(c("gps_lat").isNotNull() & ~F.isnan("gps_lat"))
    a = F.abs("gps_lat")
    ref = F.when(c("gps_lat") < 0, "s").otherwise("N")
    return f.select("file_id", F.round(values.gps_degrees(F.floor(a).cast("double"), F.floor((a - F.floor(a)) * 60).cast("double"), F.lit(0.0), ref), 9).alias("lat"))


def _sidecars(files):
    """Takeout files as they would lie beside the catalogue's images."""
    number = lambda x: F.when(c(x).isNotNull() & ~F.isnan(x), c(x))
    text = F.to_json(F.struct(F.struct(c("mtime").cast("string").alias("timestamp")).alias("photoTakenTime"), F.struct(number("sidecar_lat").alias("latitude"), number("sidecar_lon").alias("longitude")).alias("geoData")))
    one = files.filter("sidecar_taken_time is not null").select(F.concat("path", F.lit(".json")).alias("path"), text.alias("text"))
    two = files.filter(c("sidecar_lat").isNotNull() & ~F.isnan("sidecar_lat")).select(F.concat("path", F.lit(".supplemental-metadata.json")).alias("path"), F.lit("{malformed").alias("text"))
    return one.unionByName(two)


@query("s9_sidecar_choice", "files", sql="SELECT path, CASE WHEN NOT isnan(sidecar_lat) THEN 'malformed' WHEN sidecar_taken_time IS NOT NULL THEN 'taken' END AS found FROM (SELECT path, coalesce(sidecar_lat, 'nan'::DOUBLE) AS sidecar_lat, sidecar_taken_time FROM files)")
def _s9(files):
    got = sidecar.of_images(files, _sidecars(files))
    return got.select("path", F.when(c("text").startswith("{malformed"), "malformed").when(c("text").isNotNull(), "taken").alias("found"))


_ISO = """CASE WHEN abs({s}) < 200000000000 THEN strftime(make_timestamp({s} * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE (
  WITH a AS (SELECT {s} - ((({s} % 86400) + 86400) % 86400) AS d0, ((({s} % 86400) + 86400) % 86400) AS t), b AS (SELECT d0 // 86400 AS n, t FROM a)
  SELECT (400 * (n // 146097) + year(DATE '1970-01-01' + (n % 146097)::INTEGER)) || strftime(DATE '1970-01-01' + (n % 146097)::INTEGER, '-%m-%dT') || lpad((t // 3600)::VARCHAR, 2, '0') || ':' || lpad((t // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') || 'Z' FROM b) END"""


@query("s10_sidecar_parse", "files", sql=f"""SELECT path || '.json' AS path, {_ISO.format(s='mtime')} AS taken_time, CASE WHEN la <> 0 OR lo <> 0 THEN la END AS lat, CASE WHEN la <> 0 OR lo <> 0 THEN lo END AS lon
FROM (SELECT path, mtime, CASE WHEN isnan(sidecar_lat) OR sidecar_lat IS NULL THEN 0 ELSE sidecar_lat END AS la, CASE WHEN isnan(sidecar_lon) OR sidecar_lon IS NULL THEN 0 ELSE sidecar_lon END AS lo FROM files WHERE sidecar_taken_time IS NOT NULL)
UNION ALL SELECT path || '.supplemental-metadata.json', NULL, NULL, NULL FROM files WHERE NOT isnan(coalesce(sidecar_lat, 'nan'::DOUBLE))""")
def _s10(files):
    return sidecar.parsed(_sidecars(files))


#: Sidecars that a strict reader refuses, and ones it accepts.
_STRICT = (
    ('{"photoTakenTime": {"timestamp": "%"}}', True), ('{"photoTakenTime": {"timestamp": %}}', False), ('{"photoTakenTime": "%"}', False), ('[%]', False), ('{"geoData": {"latitude": "%"}}', False),
    ('{"geoData": {"latitude": %, "longitude": NaN}}', False), ('{"geoData": {"latitude": %, "longitude": true}}', False), ('{"photoTakenTime": {"timestamp": "%"},}', False), ('{"photoTakenTime": {"timestamp": "%"}} x', False),
    ('{"title": %, "photoTakenTime": {"timestamp": "%"}, "geoData": {"latitude": 1, "longitude": 2.5}}', True),
)
_ACCEPTED = """SELECT path, CASE WHEN id % 10 IN (0, 9) THEN id::VARCHAR END AS timestamp, id % 10 IN (0, 9) AS valid FROM files"""


@query("f14_strict_sidecars", "files", sql=_ACCEPTED)
def _f14(files):
    """Every file with one of ten kinds of sidecar text, of which a strict reader takes two."""
    kinds = F.array(*[F.lit(text) for text, _ in _STRICT])
    text = F.replace(F.get(kinds, (c("id") % len(_STRICT)).cast("int")), F.lit("%"), c("id").cast("string"))
    raw = sidecar.sidecar_raw(text)
    return files.select("path", raw.alias("_r")).select("path", "_r.timestamp", "_r.valid")


def _hex(x, digits):
    return F.lpad(F.hex(x), digits, "0")


@query("s12_dimensions", "files", sql="SELECT id AS file_id, width, height FROM files WHERE width BETWEEN 1 AND 65535 AND height BETWEEN 1 AND 65535")
def _s12(files):
    """Dimensions out of headers made of the catalogue's, in turn of PNG, GIF, BMP and JPEG."""
    little = lambda x, n: F.concat(*[_hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)), 2) for i in range(n)])
    w, h = c("width"), c("height")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("000000"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), little(w, 4), little(h, 4), F.lit("0100"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), _hex(h, 4), _hex(w, 4), F.lit("03012200021101031101"))
    data = F.unhex(F.when(c("id") % 4 == 0, png).when(c("id") % 4 == 1, gif).when(c("id") % 4 == 2, bmp).otherwise(jpeg))
    known = files.filter(w.between(1, 65_535) & h.between(1, 65_535)).select(c("id").alias("file_id"), data.alias("data"))
    return known.select("file_id", images.header_dimensions(c("data")).alias("_d")).select("file_id", "_d.width", "_d.height")


@query("s6_exif_fields", "files", sql="SELECT id AS file_id, trim(exif_make) AS make, orientation FROM files WHERE orientation BETWEEN 0 AND 65535 AND regexp_full_match(exif_make, '[ -~]{5,200}') AND trim(exif_make) = exif_make")
def _s6(files):
    """Make and orientation out of JPEGs whose EXIF block is made of the catalogue's."""
    make, turn = c("exif_make"), c("orientation")
    own = files.filter(turn.between(0, 65_535) & make.rlike("^[ -~]{5,200}$") & (F.trim(make) == make))
    text = F.concat(F.hex(make.cast("binary")), F.lit("00"))
    # Two entries after the header: the make as a text at offset 38, and the orientation in place.
    tiff = F.concat(F.lit("4D4D002A00000008" + "0002" + "010F0002"), _hex(F.length(make) + 1, 8), F.lit("00000026" + "0112000300000001"), _hex(turn, 4), F.lit("0000" + "00000000"), text)
    block = F.concat(F.lit("457869660000"), tiff)
    jpeg = F.unhex(F.concat(F.lit("FFD8FFE1"), _hex((F.length(block) / 2).cast("bigint") + 2, 4), block, F.lit("FFD9")))
    return own.select(c("id").alias("file_id"), exif.exif_fields(jpeg).alias("_e")).select("file_id", "_e.make", "_e.orientation")


@query("s11_geo_pair", "files", sql="""SELECT id AS file_id, CASE WHEN la <> 0 OR lo <> 0 THEN la END AS lat, CASE WHEN la <> 0 OR lo <> 0 THEN lo END AS lon
FROM (SELECT id, coalesce(nullif(sidecar_lat, 'nan'::DOUBLE), 0) AS la, coalesce(nullif(sidecar_lon, 'nan'::DOUBLE), 0) AS lo FROM files)""")
def _s11(files):
    whole = lambda x: F.when(~F.isnan(x), c(x))
    lat, lon = values.geo_pair(whole("sidecar_lat"), whole("sidecar_lon"))
    return files.select(c("id").alias("file_id"), lat.alias("lat"), lon.alias("lon"))


@query("s14_content_hash", "documents", sql="SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _s14(documents):
    return documents.select("doc_id", F.lower(F.hex(images.content_hash(c("text").cast("binary")))).alias("content_hash"))


def _label_lines(files):
    """Labels as a person would write them down: cameras make photos."""
    label = F.when(c("exif_make").isNotNull(), " Photo ").otherwise("non_photo")
    return files.select(F.concat(F.lit("  "), c("path"), F.lit(" ,"), label).alias("value")).unionByName(files.select(F.concat(F.lit("# "), c("path")).alias("value")))


_TRUTH = "SELECT trim(path) AS path, CASE WHEN exif_make IS NOT NULL THEN 'photo' ELSE 'non_photo' END AS label FROM files WHERE path IS NOT NULL"


@query("s15_label_lines", "files", sql=_TRUTH)
def _s15(files):
    return classify.truth_from_lines(_label_lines(files))


@query("s16_index_state", "files", sql="SELECT path, size, mtime FROM files")
def _s16(files):
    return catalogue.index_state(files)


# ---------------------------------------------------------------- changes
def _rescanned(log):
    """A scan that finds the log's targets, as catalogue rows."""
    null = {x: F.lit(None) for x in ("exif_datetime", "exif_create_date", "exif_make", "exif_model", "sidecar_taken_time", "resolved_date", "date_source")}
    kinds = {"width": "bigint", "height": "bigint", "orientation": "bigint", "gps_lat": "double", "gps_lon": "double", "sidecar_lat": "double", "sidecar_lon": "double"}
    return log.select(F.coalesce("dst_path", "src_path").alias("path"), c("id").alias("size"), c("ts").alias("mtime"), *[v.cast("string").alias(k) for k, v in null.items()], *[F.lit(None).cast(t).alias(k) for k, t in kinds.items()])


@query("k1_upsert_files", "files", "undo_log", sql="""WITH n AS (SELECT coalesce(dst_path, src_path) AS path, id AS size, ts AS mtime FROM undo_log),
d AS (SELECT * FROM n WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, size DESC NULLS LAST) = 1)
SELECT f.id, f.path, CASE WHEN d.path IS NULL THEN f.size ELSE d.size END AS size, CASE WHEN d.path IS NULL THEN f.mtime ELSE d.mtime END AS mtime, CASE WHEN d.path IS NULL THEN f.exif_make END AS exif_make, f.class_rule FROM files f LEFT JOIN d USING (path)
UNION ALL SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY path) AS id, path, size, mtime, NULL, NULL FROM d WHERE path NOT IN (SELECT path FROM files)""")
def _k1(files, log):
    return catalogue.upsert_files(files, _rescanned(log)).select("id", "path", "size", "mtime", "exif_make", "class_rule")


@query("k2_upsert_hashes", "files", "hashes", sql="""WITH i AS (SELECT f.id AS file_id, CASE WHEN f.exif_make IS NULL THEN h.blake3 END AS blake3, h.dhash FROM hashes h JOIN files f ON f.id = h.file_id)
SELECT h.file_id, lower(hex(CASE WHEN i.file_id IS NULL OR (i.blake3 IS NULL AND i.dhash IS NULL) THEN h.blake3 ELSE i.blake3 END)) AS blake3, h.dhash FROM hashes h LEFT JOIN i USING (file_id)""")
def _k2(files, hashes):
    i = hashes.join(files.select(c("id").alias("file_id"), "path", "exif_make"), "file_id").select("path", F.when(c("exif_make").isNull(), c("blake3")).alias("blake3"), "dhash")
    return catalogue.upsert_hashes(hashes, i, files).select("file_id", F.lower(F.hex("blake3")).alias("blake3"), "dhash")


@query("k3_record_scan_root", "scan_roots", "skip_dirs", sql="""WITH n AS (SELECT path, last_scan_ts + 60 AS last_scan_ts, scanned, CAST(0 AS BIGINT) AS added, scanned AS skipped, CAST(0 AS BIGINT) AS errors FROM scan_roots UNION ALL SELECT path, 5, 1, 1, 0, 0 FROM skip_dirs)
SELECT coalesce(r.id, (SELECT max(id) FROM scan_roots) + row_number() OVER (PARTITION BY r.id IS NULL ORDER BY n.path)) AS id, n.path, n.last_scan_ts, n.scanned, n.added, n.skipped, n.errors FROM n LEFT JOIN scan_roots r USING (path)""")
def _k3(roots, skips):
    zero = F.lit(0).cast("bigint")
    again = roots.select("path", (c("last_scan_ts") + 60).alias("last_scan_ts"), "scanned", zero.alias("added"), c("scanned").alias("skipped"), zero.alias("errors"))
    more = skips.select("path", *[F.lit(v).cast("bigint").alias(k) for k, v in (("last_scan_ts", 5), ("scanned", 1), ("added", 1), ("skipped", 0), ("errors", 0))])
    return catalogue.record_scan_root(roots, again.unionByName(more))


@query("k4_skip_dirs", "skip_dirs", sql=r"SELECT id, path FROM skip_dirs WHERE path <> 'Q:\' UNION ALL SELECT (SELECT max(id) FROM skip_dirs WHERE path <> 'Q:\') + 1, 'X:\new'")
def _k4(skips):
    return catalogue.add_skip_dir(catalogue.remove_skip_dir(skips, "Q:\\"), "X:\\new")


_SCREENS = "(1280, 720), (1280, 800), (1366, 768), (1440, 900), (1536, 864), (1600, 900), (1680, 1050), (1920, 1080), (1920, 1200), (2560, 1440), (2560, 1600), (3440, 1440), (3840, 2160), (750, 1334), (828, 1792), (1080, 1920), (1080, 2340), (1080, 2400), (1170, 2532), (1179, 2556), (1284, 2778), (1290, 2796), (1440, 2960), (1440, 3040), (1440, 3200)"
_SCREENS += ", " + ", ".join(f"({h}, {w})" for w, h in ast.literal_eval(f"[{_SCREENS}]"))
_ASSETS = "'assets', 'cache', 'thumbnails', '.thumbnails', 'icons'"
_RULE = f"""CASE WHEN exif_make IS NOT NULL OR exif_model IS NOT NULL THEN 'exif_camera'
 WHEN regexp_matches({_lower(_NAME)}, '^(screenshot|screen shot|scrnshot)') THEN 'screenshot_filename'
 WHEN list_has_any(list_transform({_PARTS}, lambda x: {_lower('x')}), [{_ASSETS}]) THEN 'asset_path'
 WHEN (width, height) IN ({_SCREENS}) THEN 'screen_resolution'
 WHEN ends_with({_lower('path')}, '.png') THEN 'png_no_exif' ELSE 'none' END"""
_BY_RULE = """CASE rule WHEN 'exif_camera' THEN 'photo' WHEN 'none' THEN 'ambiguous' ELSE 'non_photo' END AS label,
 CASE rule WHEN 'exif_camera' THEN 0.95::DOUBLE WHEN 'screenshot_filename' THEN 0.95 WHEN 'asset_path' THEN 0.9 WHEN 'screen_resolution' THEN 0.8 WHEN 'png_no_exif' THEN 0.7 ELSE 0 END AS confidence"""
_CLASSIFIED = f"SELECT id, {_BY_RULE}, rule FROM (SELECT id, {_RULE} AS rule FROM files WHERE class_rule IS NULL OR class_rule <> 'manual')"


@query("k5_relabel", "files", sql=f"SELECT f.id, CASE WHEN x.id IS NULL THEN f.classification ELSE x.label END AS classification, CASE WHEN x.id IS NULL THEN f.class_rule ELSE x.rule END AS class_rule FROM files f LEFT JOIN ({_CLASSIFIED}) x USING (id)")
def _k5(files):
    return classify.relabelled(files).select("id", "classification", "class_rule")


@query("k6_manual_label", "files", sql="SELECT id, CASE WHEN classification = 'ambiguous' THEN 'photo' ELSE classification END AS classification, CASE WHEN classification = 'ambiguous' THEN 1.0 ELSE class_confidence END AS class_confidence, CASE WHEN classification = 'ambiguous' THEN 'manual' ELSE class_rule END AS class_rule FROM files")
def _k6(files):
    d = files.filter("classification = 'ambiguous'").select("id", values.decided_label(c("classification"), False).alias("label"))
    return classify.with_manual_labels(files, d).select("id", "classification", "class_confidence", "class_rule")


@query("k7_label_export", "files", sql="SELECT path || ',' || coalesce(classification, '') AS value FROM files WHERE class_rule = 'manual'")
def _k7(files):
    return classify.manual_label_lines(files)


_LAST = "SELECT * FROM (SELECT DISTINCT id, ts, op, src_path, dst_path FROM undo_log WHERE op = 'move' AND dst_path IS NOT NULL) ORDER BY id DESC, ts DESC, src_path, dst_path LIMIT 1000"


@query("k11_undo_paths", "files", "undo_log", sql=f"SELECT f.id, coalesce(u.s, f.path) AS path FROM files f LEFT JOIN (SELECT dst_path, arg_max(src_path, id) AS s FROM ({_LAST}) GROUP BY dst_path) u ON u.dst_path = f.path")
def _k11(files, log):
    return organize.after_undo(files, organize.last_moves(log, 1000)).select("id", "path")


@query("k13_data_url", "hashes", sql="SELECT file_id, 'data:image/jpeg;base64,' || to_base64(blake3) AS url FROM hashes")
def _k13(hashes):
    return hashes.select("file_id", values.data_url(c("blake3")).alias("url"))


# ---------------------------------------------------------------- predicates
@query("pred1_hashed", "hashes", sql="SELECT file_id FROM hashes WHERE blake3 IS NOT NULL AND dhash IS NOT NULL")
def _pred1(hashes):
    return hashes.filter("blake3 is not null and dhash is not null").select("file_id")


@query("pred2_not_manual", "files", sql="SELECT id FROM files WHERE class_rule IS NULL OR class_rule <> 'manual'")
def _pred2(files):
    return files.filter(classify.not_manual(c("class_rule"))).select("id")


@query("pred3_reviewable", "files", sql="SELECT id FROM files WHERE classification IS NOT NULL AND class_rule <> 'manual'")
def _pred3(files):
    return files.filter("classification is not null and class_rule <> 'manual'").select("id")


@query("pred4_manual", "files", sql="SELECT id, path FROM files WHERE class_rule = 'manual'")
def _pred4(files):
    return files.filter("class_rule = 'manual'").select("id", "path")


@query("pred5_moves", "undo_log", sql="SELECT id, src_path, dst_path FROM undo_log WHERE op = 'move'")
def _pred5(log):
    return log.filter("op = 'move'").select("id", "src_path", "dst_path")


@query("pred6_lookup", "undo_log", "files", sql="SELECT u.id, f.id AS file_id FROM undo_log u LEFT JOIN files f ON f.path = u.src_path")
def _pred6(log, files):
    return log.select("id", "src_path").join(files.select(c("path").alias("src_path"), c("id").alias("file_id")), "src_path", "left").select("id", "file_id")


@query("pred7_unchanged", "files", "hashes", sql="SELECT f.path FROM files f WHERE f.size IS NOT NULL AND f.mtime IS NOT NULL AND EXISTS (SELECT 1 FROM hashes h WHERE h.file_id = f.id)")
def _pred7(files, hashes):
    known = files.join(hashes.select(c("file_id").alias("id")), "id", "left_semi")
    return files.select("path", "size", "mtime").join(catalogue.index_state(known), ["path", "size", "mtime"], "left_semi").select("path")


@query("pred8_groups_of_two", "hashes", sql="SELECT dhash, count(*) AS n FROM hashes WHERE dhash IS NOT NULL GROUP BY dhash HAVING count(*) > 1")
def _pred8(hashes):
    return hashes.filter("dhash is not null").groupBy("dhash").agg(F.count("*").alias("n")).filter("n > 1")


_DISTANCES = "SELECT i.batch_no, i.file_id, i.dhash, bit_count(xor(i.dhash, h.dhash))::INTEGER AS distance FROM (SELECT DISTINCT batch_no, file_id, blake3, dhash FROM incoming_hashes) i JOIN (SELECT blake3, min(dhash) AS dhash FROM hashes GROUP BY blake3) h USING (blake3)"


@query("pred9_near_enough", "incoming_hashes", "hashes", sql=f"SELECT batch_no, file_id FROM ({_DISTANCES}) WHERE distance <= 5")
def _pred9(incoming, hashes):
    return _f9(incoming, hashes).filter("distance <= 5").select("batch_no", "file_id")


@query("pred10_in_place", "files", sql=rf"SELECT id AS file_id FROM files WHERE {_back('path')} = '{TARGET}\' || CASE WHEN length(resolved_date) >= 7 AND resolved_date[5] = '-' THEN resolved_date[1:4] || '\' || resolved_date[6:7] ELSE 'undated' END || '\' || {_NAME}")
def _pred10(files):
    to = F.concat(F.lit(TARGET + "\\"), dates.month_folder(c("resolved_date")), F.lit("\\"), paths.file_name(c("path")))
    return files.filter(paths.backslashed(c("path")) == to).select(c("id").alias("file_id"))


@query("pred11_known_labels", "files", sql="SELECT id, coalesce(classification IN ('photo', 'non_photo'), false) AS known FROM files")
def _pred11(files):
    return files.select("id", F.coalesce(c("classification").isin(classify.PHOTO, classify.NON_PHOTO), F.lit(False)).alias("known"))


@query("pred12_like", "files", sql=r"SELECT id FROM files WHERE path LIKE '%!_copy.%' ESCAPE '!'")
def _pred12(files):
    return files.filter("path like '%!_copy.%' escape '!'").select("id")


# ---------------------------------------------------------------- joins
@query("j1_hashes_with_files", "hashes", "files", sql="SELECT h.file_id, f.path, f.size, h.dhash FROM hashes h JOIN files f ON f.id = h.file_id WHERE h.dhash IS NOT NULL")
def _j1(hashes, files):
    f = files.select(c("id").alias("file_id"), "path", "size")
    return hashes.filter("dhash is not null").select("file_id", "dhash").join(f, "file_id")


@query("j2_shared_hashes", "hashes", sql="SELECT file_id, lower(hex(blake3)) AS blake3 FROM hashes WHERE blake3 IN (SELECT blake3 FROM hashes WHERE blake3 IS NOT NULL GROUP BY blake3 HAVING count(*) > 1)")
def _j2(hashes):
    shared = hashes.filter("blake3 is not null").groupBy("blake3").count().filter("count > 1").select("blake3")
    return hashes.select("file_id", "blake3").join(shared, "blake3", "left_semi").select("file_id", F.lower(F.hex("blake3")).alias("blake3"))


_PAIRS = """WITH u AS (SELECT dhash, min(file_id) AS rep FROM hashes WHERE dhash IS NOT NULL GROUP BY dhash)
SELECT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b, bit_count(xor(a.dhash, b.dhash))::INTEGER AS distance FROM u a JOIN u b ON a.rep < b.rep AND bit_count(xor(a.dhash, b.dhash)) <= {k}"""


def _pairs(hashes, k):
    return hamming.near_pairs(hamming.representatives(hashes, "dhash", "file_id").select(c("rep").alias("id"), "code"), k)


@query("j3_near_pairs", "hashes", sql=_PAIRS.format(k=5))
def _j3(hashes):
    return _pairs(hashes, 5)


@query("j7_near_pairs_3", "hashes", sql=_PAIRS.format(k=3))
def _j7(hashes):
    return _pairs(hashes, 3)


@query("j8_near_members", "hashes", sql="SELECT file_id, min(file_id) OVER w AS representative, count(*) OVER w AS n FROM hashes WHERE dhash IS NOT NULL WINDOW w AS (PARTITION BY dhash)")
def _j8(hashes):
    """The membership of the representatives of j3 and j7, which is the same for every k."""
    return duplicates.code_members(hashes)


@query("j4_truth_lookup", "files", "undo_log", sql="SELECT DISTINCT u.dst_path AS path, f.classification FROM undo_log u LEFT JOIN files f ON f.path = u.dst_path")
def _j4(files, log):
    return log.select(c("dst_path").alias("path")).distinct().join(files.select("path", "classification"), "path", "left")


@query("j5_changed", "files", "undo_log", sql="SELECT f.path FROM files f WHERE NOT EXISTS (SELECT 1 FROM undo_log u WHERE u.src_path = f.path)")
def _j5(files, log):
    state = files.join(log.select(c("src_path").alias("path")), "path", "left_semi")
    return catalogue.changed_since(files.select("path", "size", "mtime"), state).select("path")


@query("j6_ids_of_paths", "undo_log", "files", "hashes", sql="SELECT u.id, h.file_id, h.dhash FROM undo_log u JOIN files f ON f.path = u.src_path JOIN hashes h ON h.file_id = f.id")
def _j6(log, files, hashes):
    ids = files.select(c("path").alias("src_path"), c("id").alias("file_id"))
    return log.select("id", "src_path").join(ids, "src_path").join(hashes.select("file_id", "dhash"), "file_id").select("id", "file_id", "dhash")


# ---------------------------------------------------------------- aggregates
_EXACT = """m AS (SELECT g.group_id, f.id AS file_id, f.path, coalesce(f.size, 0) AS size, f.size AS raw FROM hashes h
  JOIN (SELECT blake3, min(file_id) AS group_id FROM hashes WHERE blake3 IS NOT NULL GROUP BY blake3 HAVING count(*) > 1) g USING (blake3) JOIN files f ON f.id = h.file_id)"""
_REPORT = "SELECT group_id, count(*) AS n_files, max(size) AS largest, CAST(sum(size) - max(size) AS BIGINT) AS wasted_bytes, {t}::INTEGER AS threshold FROM m GROUP BY group_id HAVING count(*) > 1"
_NEAR = """u AS (SELECT dhash, min(file_id) AS rep, count(*) AS n FROM hashes WHERE dhash IS NOT NULL GROUP BY dhash),
e AS (SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.rep <> b.rep AND bit_count(xor(a.dhash, b.dhash)) <= 5),
r AS (SELECT rep AS node, rep AS root FROM u UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node AND e.y > r.root),
l AS (SELECT node, min(root) AS group_id FROM r GROUP BY node), s AS (SELECT group_id FROM l JOIN u ON u.rep = l.node GROUP BY group_id HAVING sum(n) > 1),
g AS (SELECT h.file_id, l.group_id FROM hashes h JOIN u USING (dhash) JOIN l ON l.node = u.rep JOIN s USING (group_id))"""
_NEAR_M = "m AS (SELECT g.group_id, f.id AS file_id, coalesce(f.size, 0) AS size FROM g JOIN files f ON f.id = g.file_id)"


@query("a1_shared_counts", "hashes", sql="SELECT lower(hex(blake3)) AS blake3, count(*) AS n FROM hashes WHERE blake3 IS NOT NULL GROUP BY blake3 HAVING count(*) > 1")
def _a1(hashes):
    return hashes.filter("blake3 is not null").groupBy("blake3").agg(F.count("*").alias("n")).filter("n > 1").select(F.lower(F.hex("blake3")).alias("blake3"), "n")


@query("a2_group_members", "files", "hashes", sql=f"WITH {_EXACT} SELECT group_id, file_id, path, raw AS size, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w > 1 AS preselected FROM m WINDOW w AS (PARTITION BY group_id ORDER BY raw DESC NULLS LAST, file_id)")
def _a2(files, hashes):
    return duplicates.ranked_members(duplicates.exact_members(files, hashes))


@query("a4_exact_duplicates", "files", "hashes", sql=f"WITH {_EXACT} {_REPORT.format(t=0)}")
def _a4(files, hashes):
    return duplicates.report(duplicates.exact_members(files, hashes), 0)


@query("a5_near_groups", "hashes", sql=f"WITH RECURSIVE {_NEAR} SELECT file_id, group_id FROM g")
def _a5(hashes):
    return duplicates.near_groups(hashes, 5)


@query("a6_near_duplicates", "files", "hashes", sql=f"WITH RECURSIVE {_NEAR}, {_NEAR_M} {_REPORT.format(t=5)}")
def _a6(files, hashes):
    return duplicates.report(duplicates.with_catalogue(duplicates.near_groups(hashes, 5), files), 5)


_OUTCOMES = "CASE WHEN f.mtime < 0 THEN 'errored' WHEN h.file_id IS NULL THEN 'added' ELSE 'skipped' END"


@query("a7_scan_counts", "files", "hashes", sql=f"SELECT count(*) AS scanned, count(*) FILTER (o = 'added') AS added, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'errored') AS errors FROM (SELECT {_OUTCOMES} AS o FROM files f LEFT JOIN hashes h ON h.file_id = f.id)")
def _a7(files, hashes):
    j = files.select("id", "mtime").join(hashes.select(c("file_id").alias("id"), F.lit(True).alias("known")), "id", "left")
    return catalogue.outcome_stats(j.select(F.when(c("mtime") < 0, "errored").when(c("known").isNull(), "added").otherwise("skipped").alias("outcome")))


@query("a8_label_counts", "files", sql=f"SELECT count(*) FILTER (label = 'photo') AS photo, count(*) FILTER (label = 'non_photo') AS non_photo, count(*) FILTER (label = 'ambiguous') AS ambiguous FROM ({_CLASSIFIED})")
def _a8(files):
    return classify.label_counts(classify.classified(files))


@query("a9_accuracy", "files", sql=f"""WITH t AS ({_TRUTH}), j AS (SELECT t.label, f.classification AS g FROM t LEFT JOIN files f USING (path)),
s AS (SELECT count(*) AS total, count(*) FILTER (g IS NULL) AS missing, count(*) FILTER (g <> 'ambiguous' AND g = label) AS correct, count(*) FILTER (g <> 'ambiguous' AND g <> label) AS wrong, count(*) FILTER (g = 'ambiguous') AS undecided FROM j)
SELECT *, CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) ELSE 0 END AS accuracy FROM s""")
def _a9(files):
    return classify.accuracy(classify.truth_from_lines(_label_lines(files)), files)


@query("a10_reclaimable", "files", "hashes", sql=f"WITH {_EXACT}, r AS ({_REPORT.format(t=0)}) SELECT count(*) AS groups, CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted_bytes FROM r")
def _a10(files, hashes):
    return duplicates.reclaimable(duplicates.report(duplicates.exact_members(files, hashes), 0))


@query("a11_move_counts", "undo_log", sql="SELECT count(*) FILTER (dst_path IS NOT NULL) AS moved, count(*) FILTER (dst_path IS NULL) AS errors FROM undo_log")
def _a11(log):
    return organize.outcome_counts(log.select(F.when(c("dst_path").isNull(), "no target").alias("error")))


@query("a12_table_counts", "files", "hashes", "undo_log", sql="SELECT 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'hashes', count(*) FROM hashes UNION ALL SELECT 'undo_log', count(*) FROM undo_log")
def _a12(files, hashes, log):
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one(files, "files").unionByName(one(hashes, "hashes")).unionByName(one(log, "undo_log"))


@query("w1_preselected", "files", "hashes", sql=f"WITH RECURSIVE {_NEAR}, {_NEAR_M} SELECT group_id, file_id FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY size DESC, file_id) > 1")
def _w1(files, hashes):
    m = duplicates.ranked_members(duplicates.with_catalogue(duplicates.near_groups(hashes, 5), files))
    return m.filter("preselected").select("group_id", "file_id")


# ---------------------------------------------------------------- orders
@query("o3_review_queue", "files", sql="SELECT id, path, classification, class_confidence, class_rule FROM files WHERE classification IS NOT NULL AND class_rule <> 'manual' ORDER BY class_confidence NULLS FIRST, id LIMIT 500")
def _o3(files):
    return classify.review_queue(files, 500)


@query("o4_last_moves", "undo_log", sql=_LAST)
def _o4(log):
    return organize.last_moves(log, 1000)


@query("o5_organize_plan", "files", sql=rf"""WITH RECURSIVE c AS (SELECT id AS file_id, path AS src, '{TARGET}\' || CASE WHEN length(resolved_date) >= 7 AND resolved_date[5] = '-' THEN resolved_date[1:4] || '\' || resolved_date[6:7] ELSE 'undated' END || '\' || {_NAME} AS d FROM files),
k AS (SELECT *, regexp_extract(d, '^(.*?)(\.[^.\\]*)?$', 1) AS s, regexp_extract(d, '^(.*?)(\.[^.\\]*)?$', 2) AS x FROM c WHERE d <> {_back('src')}),
n AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY src) - 1 AS r FROM k)
SELECT file_id, src, CASE WHEN r = 0 THEN d ELSE s || ' (' || r || ')' || x END AS dst FROM n""")
def _o5(files):
    return organize.plan_by_date(files, TARGET)


@query("o6_scan_roots", "scan_roots", sql="SELECT path, last_scan_ts, scanned, added, skipped, errors FROM scan_roots ORDER BY last_scan_ts DESC")
def _o6(roots):
    return roots.select("path", "last_scan_ts", "scanned", "added", "skipped", "errors").orderBy(F.desc("last_scan_ts"), "path")


@query("k10_move_duplicates", "files", "hashes", sql=rf"""WITH {_EXACT}, p AS (SELECT file_id, path AS src, 'E:\_Duplicates\' || {_NAME} AS d FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY raw DESC NULLS LAST, file_id) > 1),
k AS (SELECT *, regexp_extract(d, '^(.*?)(\.[^.\\]*)?$', 1) AS s, regexp_extract(d, '^(.*?)(\.[^.\\]*)?$', 2) AS x, row_number() OVER (PARTITION BY d ORDER BY src) - 1 AS r FROM p)
SELECT file_id, src, CASE WHEN r = 0 THEN d ELSE s || ' (' || r || ')' || x END AS dst FROM k""")
def _k10(files, hashes):
    ranked = duplicates.ranked_members(duplicates.exact_members(files, hashes))
    return organize.plan_into(ranked.filter("preselected").select("path"), files, "E:\\_Duplicates")


# ---------------------------------------------------------------- functions
@query("f1_unix_to_iso", "files", sql=f"SELECT id AS file_id, CASE WHEN mtime IS NOT NULL THEN {_ISO.format(s='mtime')} END AS iso FROM files")
def _f1(files):
    return files.select(c("id").alias("file_id"), dates.unix_to_iso(c("mtime")).alias("iso"))


_WS = r"regexp_replace({}, '^[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
_RE = r"^([0-9]+)[:/-]([0-9]+)[:/-]([0-9]+)(?: (.*))?$"


@query("f2_normalize_exif", "files", sql=f"""SELECT file_id, CASE WHEN t <> '' AND y <> 0 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02dT', y, m, d) || t END AS iso
FROM (SELECT id AS file_id, try_cast(regexp_extract(x, '{_RE}', 1) AS INTEGER) AS y, try_cast(regexp_extract(x, '{_RE}', 2) AS INTEGER) AS m, try_cast(regexp_extract(x, '{_RE}', 3) AS INTEGER) AS d, {_WS.format('regexp_extract(x, ' + chr(39) + _RE + chr(39) + ', 4)')} AS t FROM (SELECT id, {_WS.format('exif_datetime')} AS x FROM files))""")
def _f2(files):
    return files.select(c("id").alias("file_id"), dates.normalize_exif(c("exif_datetime")).alias("iso"))


_DATED = r"(19[7-9][0-9]|20[0-9]{2})(?:[-_./](0[1-9]|1[0-2])[-_./](0[1-9]|[12][0-9]|3[01])|(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01]))(?:[ Tt_-]?([01][0-9]|2[0-3])([0-5][0-9])([0-5][0-9]))?"
_G = lambda i, x: f"regexp_extract({x}, '{_DATED}', {i})"
_NAMED = lambda x: f"""CASE WHEN regexp_matches({x}, '{_DATED}') THEN {_G(1, x)} || '-' || {_G(2, x)} || {_G(4, x)} || '-' || {_G(3, x)} || {_G(5, x)} || 'T' || coalesce(nullif({_G(6, x)}, ''), '00') || ':' || coalesce(nullif({_G(7, x)}, ''), '00') || ':' || coalesce(nullif({_G(8, x)}, ''), '00') END"""


@query("f3_filename_date", "files", sql=f"SELECT id AS file_id, {_NAMED('name')} AS iso FROM (SELECT id, {_NAME} AS name FROM files)")
def _f3(files):
    return files.select(c("id").alias("file_id"), dates.filename_date(paths.file_name(c("path"))).alias("iso"))


@query("f4_resolve_date", "files", sql=f"""SELECT id AS file_id, coalesce(exif_datetime, exif_create_date, sidecar_taken_time, n, {_ISO.format(s='mtime')}) AS date,
CASE WHEN exif_datetime IS NOT NULL OR exif_create_date IS NOT NULL THEN 'exif' WHEN sidecar_taken_time IS NOT NULL THEN 'sidecar' WHEN n IS NOT NULL THEN 'filename' ELSE 'mtime' END AS source FROM (SELECT *, {_NAMED('stem')} AS n FROM (SELECT *, {_STEM} AS stem FROM files))""")
def _f4(files):
    date, source = dates.resolve_date(c("exif_datetime"), c("exif_create_date"), c("sidecar_taken_time"), c("path"), c("mtime"))
    return files.select(c("id").alias("file_id"), date.alias("date"), source.alias("source"))


@query("f5_month_folder", "files", sql=r"SELECT id AS file_id, CASE WHEN length(resolved_date) >= 7 AND resolved_date[5] = '-' THEN resolved_date[1:4] || '\' || resolved_date[6:7] ELSE 'undated' END AS folder FROM files")
def _f5(files):
    return files.select(c("id").alias("file_id"), dates.month_folder(c("resolved_date")).alias("folder"))


@query("f6_ascii_lower", "files", sql=f"SELECT id AS file_id, {_lower('exif_make')} AS make, {_lower('exif_model')} AS model FROM files")
def _f6(files):
    return files.select(c("id").alias("file_id"), paths.ascii_lower(c("exif_make")).alias("make"), paths.ascii_lower(c("exif_model")).alias("model"))


@query("f8_roots_of_files", "files", "scan_roots", sql=rf"SELECT f.id AS file_id, r.id AS root_id FROM files f JOIN scan_roots r ON {_lower(_back('f.path'))} = rtrim({_lower(_back('r.path'))}, '\') OR starts_with({_lower(_back('f.path'))}, rtrim({_lower(_back('r.path'))}, '\') || '\')")
def _f8(files, roots):
    # A root is one of the path's own ancestors: an equi-join in place of a prefix comparison with all.
    r = roots.select(c("id").alias("root_id"), paths.folded(c("path")).alias("_a"))
    return files.select(c("id").alias("file_id"), F.explode(paths.ancestors(c("path"))).alias("_a")).join(r, "_a").select("file_id", "root_id")


@query("f7_path_parts", "files", sql=rf"SELECT id AS file_id, {_NAME} AS name, {_STEM} AS stem, {_EXT} AS extension, regexp_extract({_back('path')}, '^(.*)\\[^\\]*$', 1) AS parent, CAST(len({_PARTS}) AS INTEGER) AS depth, {_lower('path')} AS lowered FROM files")
def _f7(files):
    p = c("path")
    return files.select(c("id").alias("file_id"), paths.file_name(p).alias("name"), paths.stem(p).alias("stem"), paths.extension(p).alias("extension"), paths.parent(p).alias("parent"), F.size(paths.components(p)).alias("depth"), paths.ascii_lower(p).alias("lowered"))


@query("f9_hamming", "incoming_hashes", "hashes", sql=_DISTANCES)
def _f9(incoming, hashes):
    one = hashes.groupBy("blake3").agg(F.min("dhash").alias("_d"))
    i = incoming.select("batch_no", "file_id", "blake3", "dhash").distinct()
    return i.join(one, "blake3").select("batch_no", "file_id", "dhash", values.hamming(c("dhash"), c("_d")).alias("distance"))


@query("f10_gradient_hash", "documents", sql="""WITH t AS (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS tok FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, CAST(('0x' || md5(tok)[1:4])::BIGINT % 72 AS INTEGER) AS cell, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT d.doc_id, i, coalesce(k.n, 0) AS v FROM (SELECT DISTINCT doc_id FROM t) d, range(72) r(i) LEFT JOIN k ON k.doc_id = d.doc_id AND k.cell = i),
b AS (SELECT a.doc_id, (a.i // 9) * 8 + a.i % 9 AS pos, a.v > b.v AS bit FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.i % 9 < 8)
SELECT doc_id, CAST(sum(CASE WHEN bit THEN CASE WHEN pos = 0 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (63 - pos)::INTEGER) END ELSE 0 END) AS BIGINT) AS dhash FROM b GROUP BY doc_id""")
def _f10(documents):
    tokens = documents.filter("text is not null").select("doc_id", F.explode(F.filter(F.split("text", " "), lambda t: t != "")).alias("tok"))
    cell = F.conv(F.substring(F.md5(c("tok").cast("binary")), 1, 4), 16, 10).cast("int") % 72
    counts = [F.count_if(c("cell") == i) for i in range(72)]
    grids = tokens.select("doc_id", cell.alias("cell")).groupBy("doc_id").agg(F.array(*counts).alias("grid"))
    return grids.select("doc_id", values.fold_gradient(c("grid")).alias("dhash"))


@query("f12_base64", "hashes", sql="SELECT file_id, to_base64(blake3) AS text FROM hashes")
def _f12(hashes):
    return hashes.select("file_id", F.regexp_replace(F.base64("blake3"), "[\r\n]", "").alias("text"))


@query("f13_hex", "hashes", sql="SELECT file_id, lower(hex(blake3)) AS digest FROM hashes")
def _f13(hashes):
    return hashes.select("file_id", F.lower(F.hex("blake3")).alias("digest"))


@query("f15_parse_int", "files", sql="SELECT id AS file_id, CASE WHEN regexp_matches(sidecar_taken_time, '^[+-]?[0-9]+$') THEN try_cast(sidecar_taken_time AS BIGINT) END AS n FROM files")
def _f15(files):
    return files.select(c("id").alias("file_id"), values.parse_int(c("sidecar_taken_time")).alias("n"))


@query("f16_classify", "files", sql=_CLASSIFIED)
def _f16(files):
    return classify.classified(files)


@query("f17_human_bytes", "files", sql="SELECT id AS file_id, CASE WHEN size > 1048576 THEN printf('%.1f MB', size / 1048576) WHEN size > 1024 THEN printf('%.0f KB', size / 1024) ELSE size || ' B' END AS human FROM files")
def _f17(files):
    return files.select(c("id").alias("file_id"), values.human_bytes(c("size")).alias("human"))


@query("f18_decisions", "files", sql="SELECT id, CASE WHEN classification = 'non_photo' THEN 'non_photo' ELSE 'photo' END AS confirmed, CASE WHEN classification = 'photo' THEN 'non_photo' ELSE 'photo' END AS flipped FROM files")
def _f18(files):
    return files.select("id", values.decided_label(c("classification"), False).alias("confirmed"), values.decided_label(c("classification"), True).alias("flipped"))


@query("f19_duplicates_folder", "files", sql=rf"SELECT id AS file_id, regexp_extract({_back('path')}, '^(.*)\\[^\\]*$', 1) || '\_Duplicates' AS folder FROM files")
def _f19(files):
    return files.select(c("id").alias("file_id"), organize.duplicates_folder(c("path")).alias("folder"))


@query("f20_clamp_edge", "files", sql="SELECT id AS file_id, greatest(64, least(1024, coalesce(width, 1024))) AS edge FROM files")
def _f20(files):
    return files.select(c("id").alias("file_id"), values.clamp_edge(F.coalesce("width", F.lit(1024).cast("bigint"))).alias("edge"))


@query("f21_display_time", "scan_roots", sql="SELECT id, CASE WHEN coalesce(last_scan_ts, 0) = 0 THEN '—' ELSE strftime(make_timestamp(last_scan_ts * 1000000), '%Y-%m-%d %H:%M:%S') END AS shown FROM scan_roots")
def _f21(roots):
    return roots.select("id", dates.local_display(c("last_scan_ts")).alias("shown"))


@query("t1_incremental_scan", "files", "hashes", sql="SELECT f.path, f.size, f.mtime FROM files f WHERE f.size IS NULL OR f.mtime IS NULL OR NOT EXISTS (SELECT 1 FROM hashes h WHERE h.file_id = f.id)")
def _t1(files, hashes):
    known = files.join(hashes.select(c("file_id").alias("id")), "id", "left_semi")
    return catalogue.changed_since(files.select("path", "size", "mtime"), known)
