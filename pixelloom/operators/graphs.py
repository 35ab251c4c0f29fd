"""Components of graphs given as edge arrays or tables of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.skew import lookup
from pixelloom.session import Staging, seen_in

#: Edges that a task contracts at once: some 16 MB.
TASK_EDGES = 1_000_000


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins, in place, the components of the index pairs (a, b).  ``label`` gives every index the
    smallest one of its component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # Only roots move, each to the smallest root that an edge shows it; paths are then shortened.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of every node of the edges but the roots: stars that link what the edges link, with
    the smallest node of each component as its root."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    join_labels(label, ends[: len(a)], ends[len(a) :])
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[leaf]], nodes[leaf]


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: the edges (a, b) of each partition contracted to stars, so that a partition
    gives fewer rows than it has nodes, whatever the number of its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def shrink() -> None:
            nonlocal size
            held[:] = [contract(*(np.concatenate(x) for x in zip(*held)))]
            size = len(held[0][0])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
                if size > TASK_EDGES and len(held) > 1:
                    shrink()
        if held:
            shrink()
            yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def tasks_for(edges: int) -> int:
    """Tasks over which a number of edges is spread for :func:`contracted`."""
    return max(1, -(-edges // TASK_EDGES))


def min_labels(area: Staging, edges: DataFrame) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the smallest node of its component.

    Each round spreads the edges over as many tasks as their number asks for and contracts them
    there; if that was one task, its stars are the answer.  Otherwise an alternating star contraction
    follows: neighbours above a node are linked to the smallest around it, then the smaller ones
    likewise.  Each round is written out; it ends when only stars are left."""
    e = area.write(contracted(edges.select("a", "b").filter("a <> b")))
    while True:
        tasks = tasks_for(seen_in(e))
        stars = area.write(contracted(e.repartition(tasks, F.least("a", "b"))))
        area.drop(e)
        if tasks == 1:
            e = stars
            break
        size = 2 * seen_in(stars)
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # A hub is the key of very many edges.
        large = area.write(lookup(both.filter("v > u"), low, "u", size).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct())
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(down, least, "u", size).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
        e = area.write(small.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        moved = e.join(stars, ["a", "b"], "left_anti").limit(1).count() + stars.join(e, ["a", "b"], "left_anti").limit(1).count()
        area.drop(stars, large)
        if not moved:
            break
    stars = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
