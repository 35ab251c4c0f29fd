"""Changes of catalogue tables.  Parquet has no merge: each function returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.paths import ancestors, ascii_lower, components, extension, folded
from pixelloom.schemas import METADATA
from pixelloom.session import staging

#: Image extensions, and folder names that are never entered.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "webp", "bmp", "gif")
SKIPPED_FOLDERS = ("windows", "program files", "program files (x86)", "programdata", "$recycle.bin", "system volume information", "node_modules", ".git", "windowsapps")


def is_image(path):
    """Whether a path has an image's extension, in either case."""
    return ascii_lower(extension(path)).isin(*IMAGE_EXTENSIONS)


def under_skipped_name(path, root_depth=1):
    """Whether a folder of a path below its root (its first ``root_depth`` components) has a skipped name."""
    parts = components(ascii_lower(path))
    folders = F.slice(parts, root_depth + 1, F.greatest(F.size(parts) - root_depth - 1, F.lit(0)))
    return F.exists(folders, lambda c: c.isin(*SKIPPED_FOLDERS))


def without_skipped(paths: DataFrame, skip_dirs: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is neither a skip folder nor below one.  Skip folders are looked up among each
    path's ancestors, an equi-join; an empty one holds every path that starts with a separator."""
    roots = skip_dirs.select(folded(F.col("path")).alias("_root")).filter("_root is not null").distinct()
    rows = paths.withColumn("_key", F.col(path))
    hit = rows.select("_key").filter("_key is not null").distinct()
    hit = hit.select("_key", F.explode(F.when(F.col("_key").rlike(r"^[\\/]"), F.transform(F.concat(F.array(F.lit("")), ancestors(F.col("_key"))), lambda a: F.when(a == "", a).otherwise(F.concat(F.lit("\\"), a)))).otherwise(ancestors(F.col("_key")))).alias("_root"))
    return rows.join(hit.join(roots, "_root", "left_semi").select("_key").distinct(), "_key", "left_anti").drop("_key")


def index_state(files: DataFrame) -> DataFrame:
    """(path, size, mtime) of everything indexed."""
    return files.select("path", "size", "mtime")


def changed_since(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned rows that are new or differ in size or mtime: what must be read again."""
    return scan.join(index_state(files), ["path", "size", "mtime"], "left_anti")


def upsert_files(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """``files`` with the metadata of ``incoming`` (path and metadata columns) written over by path.
    Existing rows keep their id and classification; new ones get ids after the largest, by path.  Of
    repeated incoming paths the one of the largest mtime stands; a NULL path is left out."""
    new = incoming.select("path", *METADATA).filter("path is not null")
    new = new.groupBy("path").agg(F.max_by(F.struct(*METADATA), F.struct(F.coalesce("mtime", F.lit(-1)), F.coalesce("size", F.lit(-1)))).alias("_m")).select("path", "_m.*")
    order = [c for c in files.columns]
    came = new.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in METADATA])
    kept = files.join(came, F.col("path") == F.col("_path"), "left")
    updated = kept.select(*[F.when(F.col("_path").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in METADATA else F.col(c) for c in order])
    fresh = new.join(files.select("path"), "path", "left_anti")
    top = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return updated.unionByName(_numbered(fresh, int(top)), allowMissingColumns=True)


def _numbered(rows: DataFrame, after: int) -> DataFrame:
    """Adds ids by path without gaps: pieces of a range partitioning are numbered on their own and
    shifted by the sizes of those before, of which there are as many as pieces."""
    pieces = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    with staging(rows.sparkSession, "ids") as area:
        cut = area.write(rows.repartitionByRange(pieces, "path").withColumn("_piece", F.spark_partition_id()))
    sizes = {r["_piece"]: r["count"] for r in cut.groupBy("_piece").count().collect()}
    before, shift = after, {}
    for piece in sorted(sizes):
        shift[piece] = before
        before += sizes[piece]
    if not shift:
        return rows.withColumn("id", F.lit(None).cast("bigint"))
    table = F.create_map(*[F.lit(x) for p, n in shift.items() for x in (p, n)])
    rank = F.row_number().over(W.partitionBy("_piece").orderBy("path"))
    return cut.withColumn("id", (F.element_at(table, F.col("_piece")) + rank).cast("bigint")).drop("_piece")


def upsert_hashes(hashes: DataFrame, incoming: DataFrame, files: DataFrame) -> DataFrame:
    """``hashes`` with those of ``incoming`` (path, blake3, dhash) written over.  Rows without either
    hash, or of an unknown path, change nothing; with one hash, the other becomes NULL."""
    new = incoming.filter("blake3 is not null or dhash is not null").join(files.select("path", F.col("id").alias("file_id")), "path").select("file_id", "blake3", "dhash")
    new = new.groupBy("file_id").agg(F.first("blake3").alias("blake3"), F.first("dhash").alias("dhash"))
    return hashes.select("file_id", "blake3", "dhash").join(new, "file_id", "left_anti").unionByName(new)


def record_scan_root(roots: DataFrame, stats: DataFrame) -> DataFrame:
    """``roots`` with the stats of the last scan (path, last_scan_ts, scanned, added, skipped, errors)
    in place of a root's earlier ones; a new root gets the next id."""
    columns = ("last_scan_ts", "scanned", "added", "skipped", "errors")
    latest = stats.groupBy("path").agg(F.max_by(F.struct(*columns), "last_scan_ts").alias("_s")).select(F.col("path").alias("_path"), *[F.col(f"_s.{c}").alias(f"_{c}") for c in columns])
    joined = roots.join(latest, F.col("path") == F.col("_path"), "full")
    top = F.lit(roots.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    # As many rows as roots that were never scanned before.
    rank = F.row_number().over(W.partitionBy(F.col("id").isNull()).orderBy("_path"))
    return joined.select(F.coalesce("id", top + rank).cast("bigint").alias("id"), F.coalesce("path", "_path").alias("path"), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def add_skip_dir(skip_dirs: DataFrame, path: str) -> DataFrame:
    """``skip_dirs`` with a path, unchanged if it is there."""
    if skip_dirs.filter(F.col("path") == path).limit(1).count():
        return skip_dirs
    top = skip_dirs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return skip_dirs.unionByName(skip_dirs.sparkSession.createDataFrame([(int(top) + 1, path)], "id bigint, path string"))


def remove_skip_dir(skip_dirs: DataFrame, path: str) -> DataFrame:
    return skip_dirs.filter(F.col("path") != path)


def outcome_stats(outcomes: DataFrame) -> DataFrame:
    """One row: scanned, added, skipped, errors, of outcomes (outcome: added, skipped or errored)."""
    o = F.col("outcome")
    return outcomes.agg(F.count("*").alias("scanned"), F.count_if(o == "added").alias("added"), F.count_if(o == "skipped").alias("skipped"), F.count_if(o == "errored").alias("errors"))
