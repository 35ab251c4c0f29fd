"""Near pairs of 64-bit codes: a Hamming self-join by pigeonhole bands, exact at any size.

Codes that differ in at most k bits agree on at least ``r`` of ``k + r`` bands.  Each code is keyed
by every choice of ``r`` bands; equal keys form a cell, and only codes of one cell are compared, in
blocks, as machine words.  ``r`` grows with the number of codes, so that cells stay small: the
scheme of least estimated work is taken.  Cells that are still hot are keyed once more within
themselves, and inside a task a large cell is cut again along the bits that vary in it; both keep
every pair.  Input are distinct codes: copies must be collapsed before (see ``representatives``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.graphs import contract, contracted, join_labels
from pixelloom.session import fan_out

BITS = 64
#: Estimated seconds to move one keyed row, and to compare one pair, relative to each other.
ROW_COST, PAIR_COST = 1.0, 0.003
#: Codes in a cell above which it is keyed again by Spark, and above which a task cuts it locally.
HOT_CELL, LARGE_CELL = 200_000, 8_192
BLOCK = 512


def representatives(rows: DataFrame, code: str, ident: str) -> DataFrame:
    """(code, rep, n): each distinct code with its smallest id and its number of rows.  NULL codes
    are left out.  A hot code is pre-aggregated before the shuffle."""
    r = rows.select(F.col(code).alias("code"), F.col(ident).alias("_id")).filter("code is not null")
    return r.groupBy("code").agg(F.min("_id").alias("rep"), F.count("*").alias("n"))


def bands(k: int, r: int) -> list[tuple[int, int]]:
    """(offset, width) of k + r bands that cover the 64 bits, widths as even as they can be."""
    m = k + r
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def scheme(n: int, k: int) -> int:
    """The number r of bands that must agree, by least estimated work for n evenly spread codes."""

    def work(r: int) -> float:
        width = BITS * r / (k + r)
        return comb(k + r, r) * (ROW_COST + PAIR_COST * n / 2**width)

    # Beyond a few thousand keys a code, or keys over 62 bits, nothing is gained.
    options = [r for r in range(1, 6) if comb(k + r, r) <= 2_000] or [1]
    return min(options, key=work)


def _band_values(code: Column, layout: list[tuple[int, int]]) -> list[Column]:
    return [F.shiftrightunsigned(code, off).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1)) for off, width in layout]


def keyed(codes: DataFrame, k: int, r: int, within: str | None = None) -> DataFrame:
    """Adds ``cell`` bigint: one row for each choice of r bands, a hash of the choice and its bits.
    A chance collision of hashes only joins two cells; every compared pair is verified."""
    values = _band_values(F.col("code"), bands(k, r))
    outer = [F.col(within)] if within else []
    cells = [F.xxhash64(*outer, F.lit(i), *[values[b] for b in choice]) for i, choice in enumerate(combinations(range(k + r), r))]
    return codes.withColumn("cell", F.explode(F.array(*cells)))


def cells(codes: DataFrame, k: int, n: int, hot: int = HOT_CELL) -> DataFrame:
    """Codes by cell, hot cells keyed once more (with bands of their own, and so of other bits)."""
    out = keyed(codes, k, scheme(n, k))
    if n <= hot:
        return out
    # At most (keys a code) * n / hot cells can be hot; none, with evenly spread codes.  Kept for the
    # two readers below, which run when the caller's query does.
    big = out.groupBy("cell").count().filter(F.col("count") > hot).select("cell").persist()
    if big.isEmpty():
        big.unpersist()
        return out
    calm = out.join(big, "cell", "left_anti")
    split = keyed(out.join(big, "cell", "left_semi").withColumnRenamed("cell", "_outer"), k, 3, within="_outer").drop("_outer")
    return calm.unionByName(split)


def near_in_block(a: np.ndarray, b: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two arrays of codes at most k bits apart (i < j if they are the same array)."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= k
    if same:
        near = np.triu(near, 1)
    return np.nonzero(near)


def _varying(code: np.ndarray) -> list[int]:
    """The bits in which codes differ."""
    differ = int(np.bitwise_or.reduce(code) & ~np.bitwise_and.reduce(code))
    return [b for b in range(BITS) if differ >> b & 1]


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def cuts(code: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Index arrays of which at least one holds both codes of every near pair of a cell.  A cell over
    LARGE_CELL is cut along the bits that vary in it; any other is one array."""
    varying = _varying(code) if len(code) > LARGE_CELL else []
    r = 3 if len(varying) >= k + 3 else 1
    if len(varying) < k + r:  # with so few varying bits nearly every pair is near
        yield np.arange(len(code))
        return
    m = k + r
    masks = [_mask(varying[len(varying) * i // m : len(varying) * (i + 1) // m]) for i in range(m)]
    for choice in combinations(masks, r):
        key = code & np.bitwise_or.reduce(np.array(choice))
        order = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.r_[np.diff(key[order]) != 0, True]) + 1
        for s, e in zip(np.r_[0, ends[:-1]], ends):
            if e - s > 1:
                yield order[s:e]


#: What a task does with a cell: gets ids, codes and k (and marks, where codes are marked), and yields
#: columns of the result, a bounded tile at a time.
Work = Callable[..., Iterator[tuple[np.ndarray, ...]]]


def pairs_in_cell(ident: np.ndarray, code: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, distance), a < b, of the near pairs, block by block; cuts may repeat a pair."""
    for own in cuts(code, k):
        for s in range(0, len(own), BLOCK):
            for t in range(s, len(own), BLOCK):
                u, v = own[s : s + BLOCK], own[t : t + BLOCK]
                i, j = near_in_block(code[u], code[v], k, s == t)
                if len(i):
                    a, b = u[i], v[j]
                    yield np.minimum(ident[a], ident[b]), np.maximum(ident[a], ident[b]), np.bitwise_count(code[a] ^ code[b]).astype(np.int32)


def forest_in_cell(ident: np.ndarray, code: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b), a < b: every id that has near ones, with the smallest id of its component in this cell.

    Components grow tile by tile, and no pair outlives its tile.  Codes that differ only within some k
    bits are near, and sorting finds them, which links most of a dense cell; tiles of which all codes
    are linked already can't add anything and are left out."""
    n = len(code)
    if n <= BLOCK:
        i, j = near_in_block(code, code, k, True)
        if len(i):
            yield contract(ident[i], ident[j])
        return
    label = np.arange(n)
    if n > 8 * BLOCK and k:
        bits = _varying(code)
        for s in range(0, len(bits), max(1, k // 2)):
            key = code & ~_mask(bits[s : s + k])
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            join_labels(label, order[:-1][same], order[1:][same])
    for own in cuts(code, k):
        own = own[np.argsort(label[own], kind="stable")]
        for s in range(0, len(own), BLOCK):
            u = own[s : s + BLOCK]
            for t in range(s, len(own), BLOCK):
                v = own[t : t + BLOCK]
                first = label[u[0]]
                if (label[u] == first).all() and (label[v] == first).all():
                    continue
                i, j = near_in_block(code[u], code[v], k, s == t)
                if len(i):
                    join_labels(label, u[i], v[j])
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ident)
    root = least[label]
    leaf = root != ident
    if leaf.any():
        yield root[leaf], ident[leaf]


def known_in_cell(ident: np.ndarray, code: np.ndarray, k: int, probe: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(id) of the marked codes that have an unmarked one at most k bits away in this cell."""
    hit = np.zeros(len(code), bool)
    if not probe.all():
        for own in cuts(code, k):
            asked, stored = own[probe[own]], own[~probe[own]]
            for s in range(0, len(asked), BLOCK):
                for t in range(0, len(stored), BLOCK):
                    u = asked[s : s + BLOCK]
                    u = u[~hit[u]]
                    if not len(u):
                        break
                    near = np.bitwise_count(code[u][:, None] ^ code[stored[t : t + BLOCK]][None, :]) <= k
                    hit[u[near.any(axis=1)]] = True
    if hit.any():
        yield (ident[hit],)


def over_cells(keyed_codes: DataFrame, k: int, schema: str, work: Work, tasks: int) -> DataFrame:
    """Runs ``work`` on every cell.  Input: id bigint, code bigint, cell bigint and, if codes are marked,
    probe boolean; cells without a marked code are then left out.

    A task sorts its cells as arrays, so nothing is sorted in the JVM and no group is an object.  The
    partitions are numbered explicitly: the work grows with pairs, not bytes, and must not be
    coalesced by size."""
    marked = "probe" in keyed_codes.columns
    columns = ["id", "code", "cell"] + (["probe"] if marked else [])
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in range(len(columns))] for b in batches if b.num_rows]
        if not parts:
            return
        cols = [np.concatenate(x) for x in zip(*parts)]
        del parts
        order = np.argsort(cols[2], kind="stable")
        ident, cell = cols[0][order], cols[2][order]
        code = cols[1][order].view(np.uint64)
        probe = cols[3][order].astype(bool) if marked else None
        starts = np.flatnonzero(np.r_[True, np.diff(cell) != 0, True])
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2 or (marked and not probe[s:e].any()):
                continue
            for got in work(ident[s:e], code[s:e], k, probe[s:e]) if marked else work(ident[s:e], code[s:e], k):
                waiting.append(got)
                size += len(got[0])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*waiting)], names=names)
                    waiting, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*waiting)], names=names)

    return keyed_codes.select(*columns).repartition(tasks, "cell").mapInArrow(run, schema)


def tasks_for(spark, n: int, k: int) -> int:
    """Partitions of the cells of n codes: about 400,000 keyed rows each."""
    r = scheme(n, k)
    return fan_out(spark, n * comb(k + r, r), 400_000)


def near_pairs(codes: DataFrame, k: int) -> DataFrame:
    """(a, b, distance), a < b, of distinct codes (id, code) at most k bits apart; each pair once."""
    c = codes.select("id", "code").filter("id is not null and code is not null")
    n = c.count()
    if k >= BITS // 2:
        raise ValueError("k must be below 32")
    found = over_cells(cells(c, k, n), k, "a bigint, b bigint, distance int", pairs_in_cell, tasks_for(codes.sparkSession, n, k))
    return found.distinct()


def near_forest(codes: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """(a, b), a < b: edges that connect the same distinct codes as all near pairs do, at most one
    for each code and task; an edge may come from several tasks.  ``n`` is the number of codes, where
    the caller knows it."""
    c = codes.select("id", "code").filter("id is not null and code is not null")
    n = c.count() if n is None else n
    return contracted(over_cells(cells(c, k, n), k, "a bigint, b bigint", forest_in_cell, tasks_for(codes.sparkSession, n, k)))
