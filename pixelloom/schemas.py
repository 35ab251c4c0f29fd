"""Schemas of the catalogue's tables; they are never inferred."""

FILES = (
    "id bigint, path string, size bigint, mtime bigint, width bigint, height bigint, exif_datetime string, exif_create_date string, "
    "exif_make string, exif_model string, gps_lat double, gps_lon double, orientation bigint, sidecar_taken_time string, sidecar_lat double, "
    "sidecar_lon double, resolved_date string, date_source string, classification string, class_confidence double, class_rule string"
)
HASHES = "file_id bigint, blake3 binary, dhash bigint"
UNDO_LOG = "id bigint, ts bigint, op string, src_path string, dst_path string"
SCAN_ROOTS = "id bigint, path string, last_scan_ts bigint, scanned bigint, added bigint, skipped bigint, errors bigint"
SKIP_DIRS = "id bigint, path string"
#: Moves that were begun, with the log's last id before them; empty once they are logged.
PENDING = "file_id bigint, src string, dst string, op string, after bigint, ts bigint"
#: Declared by the data model; no operator reads or writes them.
TAGS = "id bigint, name string"
FILE_TAGS = "file_id bigint, tag_id bigint"
PEOPLE = "id bigint, name string"
FACES = "id bigint, file_id bigint, person_id bigint, x double, y double, w double, h double, embedding array<float>"

TABLES = {"files": FILES, "hashes": HASHES, "undo_log": UNDO_LOG, "scan_roots": SCAN_ROOTS, "skip_dirs": SKIP_DIRS, "pending": PENDING, "tags": TAGS, "file_tags": FILE_TAGS, "people": PEOPLE, "faces": FACES}
#: What indexing overwrites; the id and the classification stay.
METADATA = (
    "size", "mtime", "width", "height", "exif_datetime", "exif_create_date", "exif_make", "exif_model", "gps_lat", "gps_lon",
    "orientation", "sidecar_taken_time", "sidecar_lat", "sidecar_lon", "resolved_date", "date_source",
)
EXIF = "datetime_original string, create_date string, make string, model string, orientation bigint, pixel_width bigint, pixel_height bigint, gps_lat double, gps_lon double"
