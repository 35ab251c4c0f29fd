r"""Plans of moves by date, with names that don't collide, and the log that undoes them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.dates import month_folder
from pixelloom.functions.paths import backslashed, file_name, parent
from pixelloom.functions.ranks import ranked
from pixelloom.session import Staging
from pixelloom.sources.scan import names_in


def joined(root: Column, name: Column) -> Column:
    return F.concat(F.rtrim(backslashed(root), F.lit("\\")), F.lit("\\"), name)


def candidates(files: DataFrame, target_root: str) -> DataFrame:
    """(file_id, src, dst): where each file belongs by its resolved date; files without a name or
    already there (separators alike) are left out."""
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("src"), "resolved_date").filter("src is not null")
    dst = joined(F.lit(target_root), F.concat(month_folder(F.col("resolved_date")), F.lit("\\"), file_name(F.col("src"))))
    return f.select("file_id", "src", dst.alias("dst")).filter((file_name(F.col("src")) != "") & (F.col("dst") != backslashed(F.col("src"))))


def collision_safe(plan: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    r"""``plan`` (file_id, src, dst) with distinct dst: in order of src the first keeps its name and
    later ones take the first free of ``stem (1).ext``, ``stem (2).ext`` and so on, against names
    claimed before and those in ``taken`` (dst).

    Only names that differ in such numbers can meet, so rows are grouped by folder, bare stem and
    extension.  Where no name of a group carries a number and none is taken, the n-th claimant
    simply gets number n, found by sorted ranks over all partitions however large the group; only
    groups with literal numbers or taken names are walked in order."""
    p = plan.select("file_id", "src", "dst")
    parts = r"^(.*\\)?(.+?)((?: \(\d+\))*)(\.[^.\\]*)?$"
    piece = lambda i: F.regexp_extract("dst", parts, i)
    p = p.withColumn("_family", F.concat_ws("\0", piece(1), piece(2), piece(4))).withColumn("_literal", piece(3) != "")
    if taken is not None:
        t = taken.select("dst").distinct()
        p = p.unionByName(t.select(F.lit(-1).cast("bigint").alias("file_id"), F.lit(None).cast("string").alias("src"), "dst").withColumn("_family", F.concat_ws("\0", piece(1), piece(2), piece(4))).withColumn("_literal", F.lit(True)))
    mixed = p.groupBy("_family").agg(F.max("_literal").alias("_mixed"), F.count("*").alias("_n"), F.count("src").alias("_own")).filter("_own > 0").drop("_own")
    # Three readers follow; the families are worked out once.
    p = Staging(plan.sparkSession, "names").write(p.join(mixed, "_family"))
    named = r"^((?:.*\\)?.+?)(\.[^.\\]*)?$"  # a leading dot belongs to the stem
    numbered = lambda n: F.when(n == 0, F.col("dst")).otherwise(F.concat(F.regexp_extract("dst", named, 1), F.lit(" ("), n.cast("string"), F.lit(")"), F.regexp_extract("dst", named, 2)))
    alone = p.filter("_n = 1 and src is not null").select("file_id", "src", "dst")
    among = ranked(p.filter("not _mixed and _n > 1").select("file_id", "src", "dst", "_family"), "_family", [F.col("src"), F.col("file_id")])
    simple = among.select("file_id", "src", numbered(F.col("rank") - 1).alias("dst"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        claimed = set(pdf.loc[pdf["src"].isna(), "dst"])
        own = pdf[pdf["src"].notna()].sort_values("src", key=lambda s: s.str.encode("utf-8"))
        out, last = [], {}
        for name in own["dst"]:
            got, n = name, last.get(name, 0)
            folder, _, base = name.rpartition("\\")
            cut = base.rfind(".")
            stem, ext = (base[:cut], base[cut:]) if cut > 0 else (base, "")
            while got in claimed:
                n += 1
                got = f"{folder}\\{stem} ({n}){ext}"
            claimed.add(got)
            last[name] = n
            out.append(got)
        # As plain objects: a group that came in several pieces has strings in several chunks, which Arrow doesn't take back.
        return pd.DataFrame({"file_id": own["file_id"].to_numpy(), "src": own["src"].to_numpy(object), "dst": np.array(out, object)})

    walked = p.filter("_mixed and _n > 1").select("file_id", "src", "dst", "_family").groupBy("_family").applyInPandas(walk, "file_id bigint, src string, dst string")
    return alone.unionByName(simple).unionByName(walked)


def taken_names(plan: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(dst): names that a ``plan`` (dst) into ``root`` can't have: the catalogue's paths below it and
    what the plan's folders hold on disk, which tasks list."""
    known = files.select(backslashed(F.col("path")).alias("dst")).filter(F.startswith("dst", joined(F.lit(root), F.lit(""))))
    return known.unionByName(names_in(plan.select(parent(F.col("dst")).alias("folder"))))


def plan_by_date(files: DataFrame, target_root: str) -> DataFrame:
    """(file_id, src, dst): the moves that bring every file to its month's folder."""
    plan = candidates(files, target_root)
    return collision_safe(plan, taken_names(plan, files, target_root))


def plan_into(paths: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(file_id, src, dst) of a list of paths (path) moved into one folder; an unknown path has the
    file_id -1 and is moved all the same."""
    known = files.select(F.col("path").alias("_p"), F.col("id").alias("_id"))
    p = paths.select(F.col("path").alias("src")).filter("src is not null").distinct().join(known, F.col("src") == F.col("_p"), "left")
    dst = joined(F.lit(folder), file_name(F.col("src")))
    plan = p.filter(file_name(F.col("src")) != "").select(F.coalesce("_id", F.lit(-1).cast("bigint")).alias("file_id"), "src", dst.alias("dst"))
    return collision_safe(plan, taken_names(plan, files, folder))


def duplicates_folder(first_path: Column) -> Column:
    """Where selected duplicates go: beside the first of them."""
    return F.concat(parent(first_path), F.lit("\\_Duplicates"))


def last_moves(undo_log: DataFrame, n: int = 1) -> DataFrame:
    """The newest ``n`` moves of the log by id, newest first; copies are never undone.  A log row that
    is repeated whole counts once."""
    log = undo_log.select("id", "ts", "op", "src_path", "dst_path").filter("op = 'move' and dst_path is not null").distinct()
    return log.orderBy(F.desc("id"), F.desc("ts"), "src_path", "dst_path").limit(n)


def after_undo(files: DataFrame, undone: DataFrame) -> DataFrame:
    """``files`` with the paths they had before the undone moves; of several moves to one path the
    newest is taken back."""
    u = undone.groupBy(F.col("dst_path").alias("_dst")).agg(F.max_by("src_path", "id").alias("_src"))
    return files.join(u, files["path"] == u["_dst"], "left").withColumn("path", F.coalesce("_src", "path")).drop("_dst", "_src")


def after_moves(files: DataFrame, moves: DataFrame) -> DataFrame:
    """``files`` with the new paths of executed moves (file_id, dst); copies don't belong here."""
    m = moves.groupBy(F.col("file_id").alias("_id")).agg(F.max("dst").alias("_dst"))
    return files.join(m, files["id"] == m["_id"], "left").withColumn("path", F.coalesce("_dst", "path")).drop("_id", "_dst")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: moved, errors, of executed entries (error string, NULL if all went well)."""
    return outcomes.agg(F.count_if(F.col("error").isNull()).alias("moved"), F.count_if(F.col("error").isNotNull()).alias("errors"))
