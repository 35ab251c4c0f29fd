"""One group identifier for all records linked directly or through others (problem 4).

Labels start as the nodes' own ids.  In a round every node takes the smallest label among itself and
its neighbours; pointer jumping then halves the paths label -> label's label until they end at
roots; edges are renamed to the roots, and those inside one root vanish.  Before a round the edges of
each partition do the same among themselves, on arrays, so that only what spans partitions is left
to the joins.  Every round is written to the shared folder, which cuts the lineage and survives lost
executors; the loop ends when a round leaves no edge, that is, when no label can change any more.
The renamed graph shrinks at least by the merged nodes, so the rounds grow with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.skew import join_hot, lookup
from pixelloom.operators import graphs, hamming
from pixelloom.session import Staging, seen_in, staging


def _jump(area: Staging, parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, label) with every label a root, from labels that are parents."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        # Very many nodes may share a label, which makes it a hot key.
        moved = lookup(parents.select("node", "label"), up, "label", seen_in(parents), "left").select("node", F.coalesce("above", "label").alias("above"), F.col("label").alias("before"))
        new = area.write(moved.select("node", F.col("above").alias("label"), (F.col("above") != F.col("before")).alias("moved")), moved=F.count_if("moved"))
        area.drop(parents)
        parents = new
        if not seen_in(new, "moved"):
            return new


def connected_components(edges: DataFrame, area: Staging) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Edges with a NULL end are left out; loops only make their node known; repeated edges and either
    direction count once; no edges give an empty result.  ``area`` holds the rounds' tables."""
    e = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a is not null and b is not null")
    # Nodes of loops alone would vanish when edges are contracted.
    alone = e.filter("a = b").select("a", "b")
    current = area.write(graphs.contracted(e.filter("a <> b")).unionByName(alone))
    labels: DataFrame | None = None
    while True:
        loops = current.filter("a = b")
        spread = current.filter("a <> b").repartition(graphs.tasks_for(seen_in(current)), F.least("a", "b"))
        close = area.write(graphs.contracted(spread).unionByName(loops))
        both = close.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(close.select(F.col("b").alias("node"), F.col("a").alias("near")))
        # The smallest label next to a node, aggregated before the shuffle: a hub is no hot group.
        lowest = both.groupBy("node").agg(F.min("near").alias("_low")).select("node", F.least("node", "_low").alias("label"))
        roots = _jump(area, area.write(lowest))
        # Contracting left stars, so a node that only the first edges knew is among them, too.
        to = roots.select("node", "label")
        if labels is None:
            labels = to
        else:
            up = to.select(F.col("node").alias("label"), F.col("label").alias("_root"))
            labels = area.write(lookup(labels.select("node", "label"), up, "label", seen_in(labels), "left").select("node", F.coalesce("_root", "label").alias("label")))
        if labels is to:
            labels._pixelloom_seen = roots._pixelloom_seen
        at = lambda c, out: to.select(F.col("node").alias(c), F.col("label").alias(out))
        # A hub is a hot key on either side of its edges.
        size = seen_in(close)
        renamed = lookup(lookup(close, at("a", "_a"), "a", size), at("b", "_b"), "b", size).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct()
        left = area.write(renamed)
        area.drop(current, close)
        current = left
        if not seen_in(left):
            area.drop(left)
            return labels


def near_groups(rows: DataFrame, code: str, ident: str, k: int) -> DataFrame:
    """(ident, group_id) for every row whose code has another row at most ``k`` bits away, directly
    or through others; group_id is the group's smallest ident.  Rows with a NULL code or ident have
    no group, equal codes are linked, an empty table gives an empty result.

    Codes are collapsed to one representative each before the near ones are sought, so copies cost
    nothing; near ones come as a forest, so a dense cluster gives fewer edges than members."""
    spark: SparkSession = rows.sparkSession
    r = rows.select(F.col(code).alias("code"), F.col(ident).alias("id")).filter("code is not null and id is not null")
    with staging(spark, "groups") as area:
        reps = area.write(hamming.representatives(r, "code", "id"), total=F.sum("n"))
        forest = hamming.near_forest(reps.select(F.col("rep").alias("id"), "code"), k, seen_in(reps))
        labels = connected_components(forest, area)
        # The smallest id of a component is the smallest representative, which is its label.
        grouped = reps.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").filter("n > 1 or label is not null")
        grouped = area.write(grouped.select("code", F.coalesce("label", "rep").alias("group_id"), "n"))
        total = seen_in(reps, "total")
        area.drop(reps, labels)
        return join_hot(r, grouped, "code", "n", total).select(F.col("id").alias(ident), "group_id")
