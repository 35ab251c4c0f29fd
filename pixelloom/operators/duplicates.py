"""Exact and near duplicate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.ranks import ranked
from pixelloom.functions.skew import join_hot
from pixelloom.operators import hamming
from pixelloom.operators.graphs import min_labels
from pixelloom.session import seen_in, staging

def exact_members(files: DataFrame, hashes: DataFrame, code: str = "blake3") -> DataFrame:
    """(group_id, file_id, path, size, width, height) of files that share a content hash with another;
    group_id is the group's smallest file_id.  NULL hashes and hashes of unknown files are left out.
    A hash is a duplicate if two rows of ``hashes`` hold it, whether or not both are catalogued."""
    h = hashes.select("file_id", F.col(code).alias("_h")).filter("_h is not null")
    groups = h.groupBy("_h").agg(F.min("file_id").alias("group_id"), F.count("*").alias("_n")).filter("_n > 1")
    members = join_hot(h, groups, "_h", "_n", h.count()).select("group_id", "file_id")
    f = files.select(F.col("id").alias("file_id"), "path", "size", "width", "height")
    return members.join(f, "file_id")


def code_members(hashes: DataFrame) -> DataFrame:
    """(file_id, representative, n) of every row with a dhash: the smallest file_id and the number of
    rows of its code.  Members of one representative are at distance 0, and members of two
    representatives at the distance of these, so the pairs of representatives within any number of
    bits and this membership give all pairs of files."""
    h = hashes.select("file_id", F.col("dhash").alias("code")).filter("code is not null")
    with staging(hashes.sparkSession, "members") as area:
        reps = area.write(hamming.representatives(h, "code", "file_id"), total=F.sum("n"))
        total = seen_in(reps, "total")
        return join_hot(h, reps, "code", "n", total).select("file_id", F.col("rep").alias("representative"), "n")


def near_groups(hashes: DataFrame, k: int = 5, method: str = "bands") -> DataFrame:
    """(file_id, group_id) of files linked by codes at most ``k`` bits apart, directly or through
    others; files without a partner are left out.  ``method`` names how pairs are found and doesn't
    change them; "bands" is the only one, since comparing all with all doesn't scale."""
    if method not in ("bands", "naive", "bktree"):
        raise ValueError(f"unknown method: {method}")
    h = hashes.select("file_id", F.col("dhash").alias("code")).filter("code is not null and file_id is not null")
    with staging(hashes.sparkSession, "near") as area:
        reps = area.write(hamming.representatives(h, "code", "file_id"), total=F.sum("n"))
        edges = hamming.near_forest(reps.select(F.col("rep").alias("id"), "code"), k, seen_in(reps))
        labels = min_labels(area, edges)
        grouped = area.write(reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").filter("n > 1 or label is not null").select("code", F.coalesce("label", "rep").alias("group_id"), "n"))
        return join_hot(h, grouped, "code", "n", seen_in(reps, "total")).select("file_id", "group_id")


def with_catalogue(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Members of ``groups`` (file_id, group_id) with their catalogue columns; unknown files left out."""
    f = files.select(F.col("id").alias("file_id"), "path", "size", "width", "height")
    return groups.select("file_id", "group_id").join(f, "file_id")


def ranked_members(members: DataFrame) -> DataFrame:
    """Members with their rank in the group: largest first, then by file_id; rank 1 is the keeper and
    the others are preselected."""
    m = ranked(members.select("group_id", "file_id", "path", "size"), "group_id", [F.desc_nulls_last("size"), F.col("file_id")])
    return m.select("group_id", "file_id", "path", "size", F.col("rank").cast("int").alias("rank"), (F.col("rank") > 1).alias("preselected"))


def report(members: DataFrame, threshold: int) -> DataFrame:
    """One row a group of two or more: group_id, n_files, largest, wasted_bytes (all but the largest
    size), threshold; most wasted first, then by group_id.  A missing size counts as 0."""
    size = F.coalesce("size", F.lit(0).cast("bigint"))
    g = members.groupBy("group_id").agg(F.count("*").alias("n_files"), F.max(size).alias("largest"), (F.sum(size) - F.max(size)).alias("wasted_bytes"))
    return g.filter("n_files > 1").withColumn("threshold", F.lit(threshold)).orderBy(F.desc("wasted_bytes"), "group_id")


def nested_report(members: DataFrame, threshold: int) -> DataFrame:
    """The report with its members as an array, for output to programs.  Only for groups of a size
    that a row can hold; :func:`ranked_members` is the flat form."""
    one = F.struct(F.coalesce(-F.col("size"), F.lit(0).cast("bigint")).alias("_o"), "file_id", "path", "size", "width", "height")
    g = members.groupBy("group_id").agg(F.sort_array(F.collect_list(one)).alias("files"), F.count("*").alias("n")).filter("n > 1")
    bare = F.transform("files", lambda f: F.struct(*[f[c].alias(c) for c in ("file_id", "path", "size", "width", "height")]))
    wasted = F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s - f["_o"]) + F.get("files", F.lit(0))["_o"]
    return g.select("group_id", bare.alias("files"), wasted.alias("wasted_bytes"), F.lit(threshold).alias("threshold"))


def reclaimable(groups: DataFrame) -> DataFrame:
    """One row: groups, total wasted_bytes of a report."""
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("wasted_bytes"), F.lit(0).cast("bigint")).alias("wasted_bytes"))
