"""Most similar 64-bit codes for every code (problem 5): navigable small-world graphs per shard.

Codes are sharded by bands of their bits: of k + 1 disjoint bands, two codes at most k bits apart
agree on at least one, so with one shard for each value of a band (as many of its bits as the number
of codes asks for) every near pair shares a shard, whatever the number of shards.  A shard's
hierarchical graph is a set of flat neighbour arrays, built and searched in batches of array
operations: one step expands the best nodes of all queries of a batch at once.  The first batch of a
graph is compared with itself, so the neighbour arrays of a shard of one batch hold the exact nearest
ones and are read off; in a larger shard every code is searched for in its graph.  The shards'
results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.skew import join_hot
from pixelloom.operators import hamming
from pixelloom.session import fan_out, seen_in, staging

#: Codes of a shard that the number of shards aims at, and above which a shard is cut again.
SHARD, LARGE_SHARD = 512, 32_768
#: Codes up to which a graph is one batch, compared with itself.
ONE_BATCH = 4_096
#: Places of the table of seen nodes that a batch of searches may take.
MAX_SEEN = 1 << 26
_ID = np.int64(1) << np.int64(32)
_NONE = np.int64(1) << np.int64(56)


class FlatGraph:
    """A hierarchical navigable small-world graph of distinct 64-bit codes under Hamming distance.

    ``links[l]`` is the neighbour array of layer l, one row for each node, -1 for a free place.  Search
    keys hold distance, node and whether the node is expanded in one integer, so that one sort of a
    beam orders it and keeps its state."""

    def __init__(self, codes: np.ndarray, m: int = 10, ef_build: int = 24, batch: int = 1_024, seed: int = 7):
        n = len(codes)
        self.codes, self.m, self.ef, self.batch = codes, m, ef_build, min(batch, max(16, MAX_SEEN // (n + 1)))
        self.exact = n <= ONE_BATCH
        if self.exact:
            # Nothing is inserted or searched for later: one layer of exact neighbours is all it needs.
            self.level, self.top, self.entry = np.zeros(n, np.int64), 0, 0
            self.links = [self._exact_links()]
            return
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64), 6)
        self.level = level
        self.links = [np.full((n, 2 * m if l == 0 else m), -1, np.int32) for l in range(int(level.max(initial=0)) + 1)]
        self.entry, self.top = 0, -1
        at = 0
        while at < n:
            size = min(n - at, max(64, min(self.batch, at)))
            self._insert(np.arange(at, at + size))
            at += size

    def _exact_links(self, rows: int = 256) -> np.ndarray:
        """The neighbour array of codes compared with each other: the nearest first, of equally near
        ones the lower node."""
        n = len(self.codes)
        links = np.full((n, min(self.m, max(n - 1, 1))), -1, np.int32)
        node = np.arange(n, dtype=np.int32)
        for at in range(0, n if n > 1 else 0, rows):
            own = self.codes[at : at + rows]
            keys = (np.bitwise_count(own[:, None] ^ self.codes[None, :]).astype(np.int32) << 16) | node[None, :]
            keys[np.arange(len(own)), at + np.arange(len(own))] = np.iinfo(np.int32).max
            some = links.shape[1]
            if some < n - 1:
                keys = np.partition(keys, some - 1, axis=1)[:, :some]
            keys.sort(axis=1)
            links[at : at + rows] = keys[:, :some] & 0xFFFF
        return links

    def nearest(self, nodes: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(neighbours, distances) of nodes, the nearest first: read off the neighbour array where it is
        exact, else searched for."""
        if not self.exact:
            return self.search_own(nodes, ef)
        near = self.links[0][nodes].astype(np.int64)
        return near, np.where(near < 0, 64, np.bitwise_count(self.codes[nodes][:, None] ^ self.codes[near]).astype(np.int64))

    # ------------------------------------------------------------ search

    def _keys(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """distance << 33 | node << 1, or _NONE for a free place."""
        d = np.bitwise_count(queries[:, None] ^ self.codes[nodes]).astype(np.int64)
        return np.where(nodes < 0, _NONE, (d << 33) | (nodes.astype(np.int64) << 1))

    def beam(self, queries: np.ndarray, start: np.ndarray, layer: int, ef: int, width: int = 4) -> np.ndarray:
        """Keys of the best ``ef`` nodes of a layer for each query, from start nodes (B, s)."""
        links = self.links[layer]
        n_q = len(queries)
        beam = np.full((n_q, ef), _NONE, np.int64)
        first = self._keys(queries, start)
        seen = np.zeros((n_q, len(self.codes) + 1), bool)  # the last column stands for free places
        seen[np.arange(n_q)[:, None], start] = True
        first.sort(axis=1)
        beam[:, : min(ef, first.shape[1])] = first[:, :ef]
        active = np.arange(n_q)
        while len(active):
            rows = beam[active]
            open_ = ((rows & 1) == 0) & (rows < _NONE)
            some = open_.any(axis=1)
            if not some.all():
                active, rows, open_ = active[some], rows[some], open_[some]
                if not len(active):
                    break
            # The nearest unexpanded nodes of each query, up to ``width`` of them.
            nth = np.cumsum(open_, axis=1)
            pick = open_ & (nth <= width)
            r, c = np.nonzero(pick)
            nodes = np.full((len(active), width), -1, np.int64)
            nodes[r, nth[r, c] - 1] = (rows[r, c] & (_ID * 2 - 1)) >> 1
            rows |= pick
            near = links[nodes]
            near[nodes < 0] = -1
            near = near.reshape(len(active), -1)
            fresh = ~seen[active[:, None], near] & (near >= 0)
            near = np.where(fresh, near, -1)
            seen[active[:, None], near] = True
            keys = np.concatenate([rows, self._keys(queries[active], near)], axis=1)
            keys.sort(axis=1)
            # Two expanded nodes may share a fresh neighbour: of equal keys one stays, and the other's
            # place is filled in the next step.
            keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = _NONE
            beam[active] = keys[:, :ef]
        return beam

    @staticmethod
    def nodes_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of keys; -1 and 64 for free places."""
        free = keys >= _NONE
        return np.where(free, -1, (keys & (_ID * 2 - 1)) >> 1), np.where(free, 64, keys >> 33)

    def descend(self, queries: np.ndarray, to: np.ndarray) -> dict[int, np.ndarray]:
        """Greedy descent from the entry; the start nodes of each layer at or above ``to``."""
        cur = np.full((len(queries), 1), self.entry, np.int64)
        starts = {}
        for layer in range(self.top, -1, -1):
            starts[layer] = cur
            down = to < layer
            if down.any():
                got, _ = self.nodes_of(self.beam(queries[down], cur[down], layer, 1, 1))
                cur = cur.copy()
                cur[down] = got
        return starts

    def search_own(self, nodes: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``ef`` nodes for nodes of the graph: descent by the hierarchy, and the node's own
        links, both start the search of the lowest layer."""
        q = self.codes[nodes]
        start = self.descend(q, np.zeros(len(q), np.int64))[0] if self.top >= 0 else np.zeros((len(q), 1), np.int64)
        return self.nodes_of(self.beam(q, np.concatenate([nodes[:, None], np.where(start == nodes[:, None], -1, start)], axis=1), 0, ef))

    # ------------------------------------------------------------ construction

    def _insert(self, new: np.ndarray) -> None:
        """Adds a batch: each node is searched for in the graph before the batch, and compared with
        the batch itself, then linked both ways."""
        q, lv = self.codes[new], self.level[new]
        inner = np.bitwise_count(q[:, None] ^ q[None, :]).astype(np.int64)
        inner = (inner << 33) | (new[None, :].astype(np.int64) << 1)
        inner[np.arange(len(new)), np.arange(len(new))] = _NONE
        starts = self.descend(q, lv) if self.top >= 0 else {}
        cur: np.ndarray | None = None
        for layer in range(len(self.links) - 1, -1, -1):
            rows = np.flatnonzero(lv >= layer)
            if not len(rows):
                continue
            wide = self.links[layer].shape[1]
            mates = np.where(lv[None, :] >= layer, inner[rows], _NONE)
            some = min(self.m, mates.shape[1])
            keys = np.partition(mates, some - 1, axis=1)[:, :some]
            if layer <= self.top:
                start = starts[layer][rows]
                keys = np.concatenate([keys, self.beam(q[rows], start, layer, self.ef)], axis=1)
            keys &= ~np.int64(1)
            keys.sort(axis=1)
            chosen = self._diverse(keys, wide // 2 if layer == 0 else wide, fill=wide)
            self.links[layer][new[rows]] = chosen
            self._link_back(new[rows], chosen, layer)
        highest = int(lv.max())
        if highest > self.top:
            self.top, self.entry = highest, int(new[int(lv.argmax())])

    def _diverse(self, keys: np.ndarray, want: int, fill: int) -> np.ndarray:
        """Neighbours from sorted candidate keys: one is taken if it is nearer to the query than to
        every neighbour taken before it; free places up to ``fill`` go to the nearest of the rest."""
        nodes, dist = self.nodes_of(keys)
        n, c = nodes.shape
        taken = np.full((n, fill), -1, np.int64)
        count = np.zeros(n, np.int64)
        used = np.zeros((n, c), bool)
        line = np.arange(n)
        code = self.codes[nodes]
        got = np.zeros((n, want), np.uint64)
        for j in range(c):
            apart = np.bitwise_count(code[:, j, None] ^ got)
            close = (apart <= dist[:, j, None]) & (np.arange(want)[None, :] < count[:, None])
            ok = (nodes[:, j] >= 0) & ~close.any(axis=1) & (count < want)
            r = line[ok]
            taken[r, count[r]], got[r, count[r]] = nodes[r, j], code[r, j]
            used[r, j] = True
            count[r] += 1
        left = ~used & (nodes >= 0)
        rank = np.cumsum(left, axis=1) - 1 + count[:, None]
        r, j = np.nonzero(left & (rank < fill))
        taken[r, rank[r, j]] = nodes[r, j]
        return taken.astype(np.int32)

    def _link_back(self, new: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        wide = links.shape[1]
        r, j = np.nonzero(chosen >= 0)
        to, back = chosen[r, j].astype(np.int64), new[r]
        # Nearest first, so that a node with more offers than places sees the best ones first.
        order = np.lexsort((np.bitwise_count(self.codes[to] ^ self.codes[back]), to))
        to, back = to[order], back[order]
        first = np.flatnonzero(np.r_[True, np.diff(to) != 0]) if len(to) else np.empty(0, np.int64)
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        for turn in range(int(place.max(initial=-1)) // wide + 1):
            own = (place >= turn * wide) & (place < (turn + 1) * wide)
            nodes, row = np.unique(to[own], return_inverse=True)
            offer = np.full((len(nodes), wide), -1, np.int64)
            offer[row, place[own] - turn * wide] = back[own]
            both = np.concatenate([links[nodes].astype(np.int64), offer], axis=1)
            keys = self._keys(self.codes[nodes], both)
            keys.sort(axis=1)
            same = keys[:, 1:] == keys[:, :-1]
            keys[:, 1:][same] = _NONE
            keys.sort(axis=1)
            links[nodes] = self._diverse(keys, wide // 2 if layer == 0 else wide, fill=wide)


def shard_neighbours(codes: np.ndarray, k: int, keep: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, distance) of the up to ``keep`` best neighbours within k bits of every code
    of one shard; of equally near ones the lower node."""
    graph = FlatGraph(codes, m=max(10, keep))
    out = []
    batch = max(16, min(2_048, MAX_SEEN // (len(codes) + 1)))
    for at in range(0, len(codes), batch):
        nodes = np.arange(at, min(at + batch, len(codes)))
        near, dist = graph.nearest(nodes, ef)
        ok = (near >= 0) & (near != nodes[:, None]) & (dist <= k)
        ok &= np.cumsum(ok, axis=1) <= keep
        r, c = np.nonzero(ok)
        out.append((nodes[r], near[r, c], dist[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def shard_codes(codes: DataFrame, k: int, n: int) -> DataFrame:
    """(id, code, cell): every code in one shard of each of k + 1 bands.  A hot shard, one whose band
    value very many codes share, is sharded again by bands of other bits; no near pair is lost."""
    wanted = max(0, (max(1, n // SHARD)).bit_length() - 1)
    layout = [(off, min(width, wanted)) for off, width in hamming.bands(k, 1)]
    value = lambda off, width: F.shiftrightunsigned("code", off).bitwiseAND(F.lit((1 << width) - 1))
    each = [F.xxhash64(F.lit(b), value(off, width)) for b, (off, width) in enumerate(layout)]
    out = codes.withColumn("cell", F.explode(F.array(*each)))
    big = out.groupBy("cell").count().filter(F.col("count") > LARGE_SHARD).select("cell")
    if n <= LARGE_SHARD or big.isEmpty():
        return out
    inner = [F.xxhash64(F.col("cell"), F.lit(b), value(off, width)) for b, (off, width) in enumerate(hamming.bands(k, 1))]
    split = out.join(big, "cell", "left_semi").withColumn("cell", F.explode(F.array(*inner)))
    return out.join(big, "cell", "left_anti").unionByName(split)


def nearest_codes(codes: DataFrame, k: int, keep: int, ef: int = 32) -> DataFrame:
    """(id, near_id, distance): for each distinct code (id, code) up to ``keep`` others within k bits,
    the nearest first and of equally near ones the smaller id, as the shards' graphs find them."""
    c = codes.select("id", "code").filter("id is not null and code is not null")
    n = c.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
        if not parts:
            return
        ident, code, cell = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ident, cell))  # lower nodes are smaller ids: ties go to them
        ident, code, cell = ident[order], code[order].view(np.uint64), cell[order]
        starts = np.flatnonzero(np.r_[True, np.diff(cell) != 0, True])
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1:
                a, b, d = shard_neighbours(code[s:e], k, keep, ef)
                yield pa.RecordBatch.from_arrays([pa.array(ident[s:e][a]), pa.array(ident[s:e][b]), pa.array(d.astype(np.int32))], names=["id", "near_id", "distance"])

    sharded = shard_codes(c, k, n)
    # About a second a task: a shard's work is far larger than its bytes.
    tasks = fan_out(codes.sparkSession, n * (k + 1), 60_000)
    found = sharded.select("id", "code", "cell").repartition(tasks, "cell").mapInArrow(run, "id bigint, near_id bigint, distance int")
    # What one code finds, the other has found as well; shards repeat each other.  An explode, since a
    # union would search twice.
    both = found.select(F.explode(F.array(F.struct("id", "near_id", "distance"), F.struct(F.col("near_id").alias("id"), F.col("id").alias("near_id"), "distance"))).alias("_p")).select("_p.*")
    best = both.groupBy("id", "near_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "near_id"))
    return best.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def similar_files(rows: DataFrame, code: str, ident: str, k: int, keep: int = 3, ef: int = 32) -> DataFrame:
    """(a, b), a < b: pairs of rows of which at least one is among the up to ``keep`` nearest others
    of the other (fewest differing bits, at most k; of equal ones the smaller ident).

    Rows with a NULL code or ident are in no pair; copies of a code are at distance 0 of each other
    and stand for one vector in the graphs.  Repeated rows of one ident count once."""
    spark: SparkSession = rows.sparkSession
    r = rows.select(F.col(code).alias("code"), F.col(ident).alias("id")).filter("code is not null and id is not null").distinct()
    with staging(spark, "nearest") as area:
        reps = area.write(hamming.representatives(r, "code", "id"), total=F.sum("n"))
        total = seen_in(reps, "total")
        near = nearest_codes(reps.select(F.col("rep").alias("id"), "code"), k, keep, ef)
        # The smallest members of each code: a member's own copies, and what others may take of them.
        rank = F.row_number().over(W.partitionBy("code").orderBy("id"))
        first = r.withColumn("_r", rank).filter(F.col("_r") <= keep + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("first"))
        members = area.write(reps.join(first, "code").select("code", "rep", "n", "first"))
        of = members.select(F.col("rep").alias("near_id"), F.slice("first", 1, keep).alias("_first"))
        offers = near.join(of, "near_id").select(F.col("id").alias("rep"), F.transform("_first", lambda x: F.struct(F.col("distance").alias("distance"), x.alias("id"))).alias("_o"))
        # At most ``keep`` codes with ``keep`` members each.
        offers = offers.groupBy("rep").agg(F.flatten(F.collect_list("_o")).alias("_o"))
        own = F.transform("first", lambda x: F.struct(F.lit(0).alias("distance"), x.alias("id")))
        lists = members.join(offers, "rep", "left").select("code", "n", F.slice(F.sort_array(F.concat(own, F.coalesce("_o", F.array().cast("array<struct<distance:int,id:bigint>>")))), 1, keep + 1).alias("best"))
        lists = area.write(lists)
        area.drop(reps, members)
        met = join_hot(r, lists, "code", "n", total)
        taken = met.select("id", F.explode(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, keep)).alias("_t"))
        return taken.select(F.least("id", "_t.id").alias("a"), F.greatest("id", "_t.id").alias("b")).distinct()
