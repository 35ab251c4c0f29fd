"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.skew import HOT_SHARE
from pixelloom.session import staging


def ranked(rows: DataFrame, group: str, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds ``out``: each row's place, from 1, by ``order`` within its group; ``order`` must be total.

    Groups that hold at least one in HOT_SHARE of all rows, of which there can be no more than that
    many, are ranked by sorted pieces; the others by a window."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max((total or 0) // HOT_SHARE, 20_000)
    if (most or 0) < limit:
        return rows.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint"))
    hot = F.broadcast(counts.filter(F.col("_n") >= limit).select(group))
    calm = rows.join(hot, group, "left_anti").withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint"))
    return calm.unionByName(ranked_by_pieces(rows.join(hot, group, "left_semi"), group, order, out))


def ranked_by_pieces(rows: DataFrame, group: str, order: list[Column], out: str = "rank") -> DataFrame:
    """:func:`ranked` without one task holding a group: sorted pieces are ranked on their own and
    shifted by the sizes of the pieces before."""
    pieces = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    # Written out, since a row's piece must be the same for its rank and for the pieces' sizes.
    with staging(rows.sparkSession, "rank") as area:
        cut = area.write(rows.repartitionByRange(pieces, F.col(group), *order).withColumn("_piece", F.spark_partition_id()))
    own = F.row_number().over(W.partitionBy(group, "_piece").orderBy(*order))
    sizes = cut.groupBy(group, "_piece").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy(group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(group, "_piece", before.alias("_before"))
    # Few rows: the pieces of each group.
    return cut.withColumn("_own", own).join(F.broadcast(shift), [group, "_piece"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_piece")
