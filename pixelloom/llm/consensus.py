"""One surviving record for each group of duplicates, field by field (problem 2).

A field's values are split into tokens and aligned progressively: the value of most weight first,
each next one against the profile of those before.  In every column of the alignment the tokens
vote with the weight of their values; the winners make the consensus, and the existing value closest
to it (by token edit distance) survives.  A value compared whole is one token, and its alignment has
one column.

A field is either voted on, where a value weighs as many votes as it has holders, or trusted, where
each value outweighs all that rank below it together, so that the tokens of the most trusted one win
every column and it survives unless nothing else can be told from it.  Equal values are pooled
before anything is shuffled by group.  Many groups are aligned at once, as arrays.  The values of a
group of more than ``BLOCK`` are aligned in blocks, each with the group's first value as its seed;
columns are named by their place in the seed, and votes are summed over the blocks by that name, so
no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pixelloom.functions.skew import join_hot
from pixelloom.session import fan_out, seen_in, staging

#: Distinct values of a group that are aligned with each other.
BLOCK = 64
#: Alignment costs: a gap, and two columns without a common vote.
GAP, APART = 1_000, 1_500
#: Cells of an alignment held at once; a longer pair of sequences is halved first.
MAX_CELLS = 16_000_000


def counting_hash(blake3: Column) -> Column:
    """Whether a content hash is one: 32 bytes, not all of them zero."""
    return F.coalesce((F.octet_length(blake3) == 32) & (blake3 != F.lit(bytes(32))), F.lit(False))


def duplicate_members(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(group, member, path, size, width, height): rows of ``hashes`` whose counting blake3 another
    row shares, with their catalogue row; a row without one has NULL fields.  ``group`` is the
    smallest file_id that holds the hash."""
    h = hashes.select("file_id", "blake3").filter(counting_hash(F.col("blake3")) & F.col("file_id").isNotNull())
    groups = h.groupBy("blake3").agg(F.min("file_id").alias("group"), F.count("*").alias("n")).filter("n > 1")
    total = h.count()
    members = join_hot(h, groups, "blake3", "n", total).select("group", F.col("file_id").alias("member"))
    f = files.select(F.col("id").alias("member"), "path", "size", "width", "height")
    return members.join(f, "member", "left")


def path_tokens(path: Column) -> Column:
    """Separators, words and what stands between them: nothing of a path is lost."""
    return F.split(path, r"(?<=[\\/ ._-])|(?=[\\/ ._-])")


def surviving_fields(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(group_id, size_id, dims_id, path_id): for each set of byte-identical files the members that
    hold the surviving size (most votes, then largest), dimensions (most votes, then most pixels,
    then wider) and path (fewest characters, then first in byte order: shorter paths are trusted).

    Sizes of 0 and below, and dimensions outside 1 to 60,000, have no vote; a field without any vote
    is 0.  Repeated hash rows vote once each."""
    m = duplicate_members(files, hashes)
    none = F.lit(0).cast("bigint")
    row = lambda field, ok, value, prior, k1, k2: F.when(ok, F.struct(F.lit(field).alias("field"), value.alias("value"), prior.cast("bigint").alias("prior"), k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2")))
    size, w, h = F.col("size"), F.col("width"), F.col("height")
    each = F.array_compact(F.array(
        row(0, size > 0, size.cast("string"), none, size, none),
        row(1, w.between(1, 60_000) & h.between(1, 60_000), F.concat_ws("x", w, h), none, w * h, w),
        row(2, F.lit(True), F.coalesce("path", F.lit("")), F.coalesce(-F.char_length("path"), F.lit(-(2**40))), none, none),
    ))
    values = m.select("group", "member", F.explode(each).alias("_v")).select("group", "member", "_v.*")
    tokens = F.when(F.col("field") == 2, path_tokens(F.col("value"))).otherwise(F.array("value"))
    best = survivors(values, tokens, trusted=(2,))
    found = lambda i, name: F.coalesce(F.min(F.when(F.col("field") == i, F.col("member"))), F.lit(0).cast("bigint")).alias(name)
    return best.groupBy(F.col("group").alias("group_id")).agg(found(0, "size_id"), found(1, "dims_id"), found(2, "path_id"))


def consensus_of_tokens(values: DataFrame, tokens: Column) -> DataFrame:
    """(group, value, distance, votes): for each group the existing value closest to the consensus of
    its aligned tokens; of equally close ones that with most votes, then the first in byte order.

    ``values``: group bigint, value string; ``tokens`` splits ``value``.  NULL values and groups don't
    vote; a group without any vote is absent; a value without tokens is one empty token."""
    none = F.lit(0).cast("bigint")
    v = values.select("group", "value").filter("group is not null and value is not null")
    v = v.select("group", none.alias("member"), F.lit(0).alias("field"), "value", none.alias("prior"), none.alias("k1"), none.alias("k2"))
    return survivors(v, tokens).select("group", "value", "distance", "votes")


def survivors(values: DataFrame, tokens: Column, trusted: tuple[int, ...] = ()) -> DataFrame:
    """(group, field, value, member, distance, votes): of each group and field the value closest to the
    consensus of its aligned tokens, with the smallest member that holds it.

    ``values``: group bigint, member bigint, field int, value string, prior, k1, k2 bigint; ``tokens``
    splits ``value``.  Of equal votes, and of equally close values, the first wins: by prior (higher
    first), votes (most first, unless the field is trusted), k1, k2 (higher first) and value."""
    spark = values.sparkSession
    votes = F.count("*").alias("votes")
    pooled = values.groupBy("group", "field", "prior", "k1", "k2", "value").agg(votes, F.min("member").alias("member"))
    weighed = F.when(F.col("field").isin(list(trusted)), F.lit(0).cast("bigint")).otherwise(-F.col("votes"))
    pooled = pooled.select("group", "field", (-F.col("prior")).alias("o1"), weighed.alias("o2"), (-F.col("k1")).alias("o3"), (-F.col("k2")).alias("o4"), "value", "member", "votes", tokens.alias("tokens"))
    pooled = pooled.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))))
    with staging(spark, "consensus") as area:
        pooled = area.write(pooled)
        total = seen_in(pooled)
        first = F.min(F.struct("o1", "o2", "o3", "o4", "value", "tokens")).alias("_first")
        large = area.write(pooled.groupBy("group", "field").agg(F.count("*").alias("n"), first).filter(F.col("n") > BLOCK))
        tasks = fan_out(spark, total, 50_000)
        settle = lambda rows: _over_groups(rows, ("group", "field"), tasks, lambda t: _settled(t, trusted), SETTLED)
        if not seen_in(large):
            return settle(pooled)
        key = F.struct("group", "field")
        spread = join_hot(pooled.withColumn("_k", key), large.select(key.alias("_k"), "n", F.col("_first.tokens").alias("seed"), F.col("_first.value").alias("seed_value")), "_k", "n", total, how="left").drop("_k")
        spread = area.write(spread)
        parts = spread.filter("n is not null").withColumn("block", F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / BLOCK)))
        cast = _over_groups(parts, ("group", "field", "block"), tasks, lambda t: _block_votes(t, trusted), VOTES)
        agreed = area.write(_agreed(cast, large, trusted))
        met = join_hot(parts.withColumn("_k", key).drop("seed", "seed_value", "block", "n"), agreed.select(key.alias("_k"), "consensus").join(large.select(key.alias("_k"), "n"), "_k"), "_k", "n", total)
        scored = met.select("group", "field", "o1", "o2", "o3", "o4", "value", "member", "votes", _token_distance("tokens", "consensus").alias("distance"))
        best = scored.groupBy("group", "field").agg(F.min(F.struct("distance", "o1", "o2", "o3", "o4", "value", "member", "votes")).alias("_b"))
        return settle(spread.filter("n is null").drop("n", "seed", "seed_value")).unionByName(best.select("group", "field", "_b.value", "_b.member", "_b.distance", "_b.votes"))


# ---------------------------------------------------------------- over partitions

SETTLED = "group bigint, field int, value string, member bigint, distance int, votes bigint"
VOTES = "group bigint, field int, at int, nth int, token string, votes bigint, o1 bigint, o2 bigint, o3 bigint, o4 bigint, value string"
ORDER = ("o1", "o2", "o3", "o4", "value")


def _over_groups(rows: DataFrame, keys: tuple[str, ...], tasks: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs ``work`` on tables of whole groups, many at a time: a task's rows come sorted by group, and
    the last group of a batch waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(k)) for k in keys]
            fresh = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            ends = [batch.column(k)[0].as_py() for k in keys] != [held[-1].column(k)[-1].as_py() for k in keys] if held else False
            if ends:
                fresh = np.r_[0, fresh]
            if len(fresh):
                whole = pa.Table.from_batches([*held, batch.slice(0, fresh[-1])])
                held = [batch.slice(fresh[-1])]
                yield from work(whole).to_batches()
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sorted_groups(t: pa.Table, keys: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    """The table in order of its groups and, within them, of its values; the groups' starts."""
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (*keys, *ORDER)])).combine_chunks()
    differ = np.any([np.diff(t.column(k).to_numpy()) != 0 for k in keys], axis=0)
    return t, np.flatnonzero(np.r_[True, differ])


def _token_ids(*columns: pa.ChunkedArray) -> tuple[list[tuple[np.ndarray, np.ndarray]], pa.Array]:
    """Token lists as numbers: for each column the ids and the offsets of its lists; and the tokens."""
    flat = [pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0) for c in columns]
    ids = pa.chunked_array([f.flatten() for f in flat]).combine_chunks().dictionary_encode()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    every, out, at = ids.indices.to_numpy(), [], 0
    for f in flat:
        lengths = pc.list_value_length(f).to_numpy()
        out.append((every[at : at + lengths.sum()], np.r_[0, np.cumsum(lengths)]))
        at += lengths.sum()
    return out, ids.dictionary


def _padded(ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(len(rows), longest) ids of some lists, -1 beyond their ends, and their lengths."""
    length = offsets[rows + 1] - offsets[rows]
    place = np.arange(max(1, int(length.max(initial=1))))
    ids = ids if len(ids) else np.full(1, -1)
    at = np.minimum(offsets[rows][:, None] + place[None, :], len(ids) - 1)
    return np.where(place[None, :] < length[:, None], ids[at], -1).astype(np.int32), length


def _batches(size: np.ndarray, longest: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of similar numbers of values and tokens together, few enough that their cells fit."""
    kind = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) * 64 + np.ceil(np.log2(np.maximum(longest, 1))).astype(np.int64)
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        width = int(longest[own].max())
        step = max(1, MAX_CELLS // ((2 * width + 1) * (width + 1) * max(1, int(size[own].max()) // 8)))
        for s in range(0, len(own), step):
            yield own[s : s + step]


def _settled(t: pa.Table, trusted: tuple[int, ...]) -> pa.Table:
    """The survivor of each group of a table."""
    t, start = _sorted_groups(t, ("group", "field"))
    size = np.diff(np.r_[start, len(t)])
    [(ids, offsets)], _ = _token_ids(t.column("tokens"))
    votes, field = t.column("votes").to_numpy(), t.column("field").to_numpy()
    longest = np.maximum.reduceat(np.diff(offsets), start)
    chosen, far = start.copy(), np.zeros(len(start), np.int64)
    several = np.flatnonzero(size > 1)
    for pick in _batches(size[several], longest[several]):
        g = several[pick]
        n = int(size[g].max())
        row = np.minimum(start[g][:, None] + np.arange(n)[None, :], len(t) - 1)
        inside = np.arange(n)[None, :] < size[g][:, None]
        seq, length = _padded(ids, offsets, row.ravel())
        seq, length = seq.reshape(len(g), n, -1), np.where(inside, length.reshape(len(g), n), 0)
        weight = np.where(inside, _weights(votes[row], np.isin(field[start[g]], trusted)), 0.0)
        columns, _ = align(seq, length, weight)
        agreed, n_agreed = consensus(columns, weight)
        gi, vi = np.nonzero(inside)
        apart = np.full(inside.shape, np.iinfo(np.int64).max)
        apart[gi, vi] = edit_distances(seq[gi, vi], length[gi, vi], agreed[gi], n_agreed[gi])
        best = apart.argmin(axis=1)  # of equal ones the first
        chosen[g], far[g] = start[g] + best, apart[np.arange(len(g)), best]
    out = t.take(pa.array(chosen))
    return pa.table([out.column(c) for c in ("group", "field", "value", "member")] + [pa.array(far.astype(np.int32)), out.column("votes")], names=["group", "field", "value", "member", "distance", "votes"])


def _weights(votes: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Weights of values in their order: votes, or a third of the weight of the one before."""
    falling = 3.0 ** -np.arange(votes.shape[1], dtype=np.float64)
    return np.where(trusted[:, None], falling[None, :], votes.astype(np.float64))


# ---------------------------------------------------------------- groups in blocks


def _block_votes(t: pa.Table, trusted: tuple[int, ...]) -> pa.Table:
    """Votes of a large group's block by column and token (NULL for a gap), with the first value that
    casts them.  A column is named by its place in the seed (``at``) and, if inserted after that place,
    by its number there (``nth``)."""
    t, start = _sorted_groups(t, ("group", "field", "block"))
    size = np.diff(np.r_[start, len(t)])
    [(ids, offsets), (seed_ids, seed_offsets)], words = _token_ids(t.column("tokens"), t.column("seed"))
    votes, field = t.column("votes").to_numpy(), t.column("field").to_numpy()
    is_seed = np.asarray(pc.equal(t.column("value"), t.column("seed_value")))
    rows_out: list[tuple[np.ndarray, ...]] = []
    longest = np.maximum(np.maximum.reduceat(np.diff(offsets), start), np.diff(seed_offsets)[start])
    for g in _batches(size + 1, longest):
        # The seed stands first; where it is of this block, its own row is left out, which is the first.
        present = is_seed[start[g]]
        n = size[g] - present
        place = np.arange(max(1, int(n.max())))
        inside = place[None, :] < n[:, None]
        row = np.minimum((start[g] + present)[:, None] + place[None, :], len(t) - 1)
        rest, n_rest = _padded(ids, offsets, row.ravel())
        first, n_first = _padded(seed_ids, seed_offsets, start[g])
        width = max(rest.shape[1], first.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=-1)  # noqa: B023, E731
        seq = np.concatenate([wide(first)[:, None], wide(rest).reshape(len(g), len(place), width)], axis=1)
        length = np.concatenate([n_first[:, None], np.where(inside, n_rest.reshape(inside.shape), 0)], axis=1)
        of = np.concatenate([start[g][:, None], row], axis=1)
        cast = np.concatenate([np.where(present, votes[start[g]], 0)[:, None], np.where(inside, votes[row], 0)], axis=1)
        weight = _weights(np.maximum(cast, np.r_[[1], [0] * len(place)] * cast.max(axis=1)[:, None]), np.isin(field[start[g]], trusted)) * (length > 0)
        m, used = align(seq, length, weight)
        seeded = m[:, 0] >= 0
        index = np.broadcast_to(np.arange(m.shape[2]), seeded.shape)
        at = np.cumsum(seeded, axis=1) - 1
        nth = index - np.maximum.accumulate(np.where(seeded, index, -1), axis=1)
        b, v, c = np.nonzero((cast > 0)[:, :, None] & (index < used[:, None])[:, None, :])
        key = (b * m.shape[2] + c) * (len(words) + 1) + m[b, v, c] + 1
        _, where, back = np.unique(key, return_index=True, return_inverse=True)  # the first value is the best one
        rows_out.append((of[b, v][where], at[b, c][where], nth[b, c][where], m[b, v, c][where], np.bincount(back, cast[b, v]).astype(np.int64)))
    row, at, nth, tok, n = (np.concatenate(x) for x in zip(*rows_out))
    out = t.take(pa.array(row))
    token = words.take(pa.array(np.maximum(tok, 0)))
    token = pc.if_else(pa.array(tok >= 0), token, pa.scalar(None, pa.string()))
    parts = [out.column("group"), out.column("field"), pa.array(at.astype(np.int32)), pa.array(nth.astype(np.int32)), token, pa.array(n), *[out.column(c) for c in ORDER]]
    return pa.table(parts, names=["group", "field", "at", "nth", "token", "votes", *ORDER])


def _agreed(cast: DataFrame, large: DataFrame, trusted: tuple[int, ...]) -> DataFrame:
    """(group, field, consensus) from the votes of all blocks.  Votes that an inserted column didn't
    get are for its gap, which the seed, the first of all values, holds too."""
    order = F.struct(*ORDER)
    by_token = cast.groupBy("group", "field", "at", "nth", "token").agg(F.sum("votes").alias("votes"), F.min(order).alias("first"))
    by_column = by_token.groupBy("group", "field", "at", "nth")
    rank = F.struct(F.when(F.col("field").isin(list(trusted)), F.lit(0).cast("bigint")).otherwise(-F.col("votes")).alias("against"), "first", "token")
    said = by_column.agg(F.sum("votes").alias("cast"), F.min(F.when(F.col("token").isNotNull(), rank)).alias("best"), F.min(F.when(F.col("token").isNull(), rank)).alias("gap"), F.coalesce(F.sum(F.when(F.col("token").isNull(), F.col("votes"))), F.lit(0)).alias("gaps"))
    # The seed's columns were met by every block, and so hold all votes of a group.
    total = said.filter("nth = 0 and at >= 0").groupBy("group", "field").agg(F.max("cast").alias("total"))
    seed = large.select("group", "field", *[F.col(f"_first.{c}").alias(f"_{c}") for c in ORDER])
    said = said.join(total, ["group", "field"]).join(seed, ["group", "field"])
    inserted = F.struct(F.when(F.col("field").isin(list(trusted)), F.lit(0).cast("bigint")).otherwise(-(F.col("gaps") + F.col("total") - F.col("cast"))).alias("against"), F.struct(*[F.col(f"_{c}").alias(c) for c in ORDER]).alias("first"))
    won = F.struct("best.against", "best.first")
    ahead = F.when((F.col("nth") > 0) | (F.col("at") < 0), won < inserted).when(F.col("gap").isNull(), True).otherwise(won < F.struct("gap.against", "gap.first"))
    kept = said.filter(F.col("best").isNotNull() & ahead)
    lists = kept.groupBy("group", "field").agg(F.sort_array(F.collect_list(F.struct("at", "nth", "best.token"))).alias("_c"))
    return large.select("group", "field").join(lists, ["group", "field"], "left").select("group", "field", F.coalesce(F.col("_c.token"), F.array().cast("array<string>")).alias("consensus"))


@F.arrow_udf(IntegerType())
def _token_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    [(x, at_x), (y, at_y)], _ = _token_ids(pa.chunked_array([a]), pa.chunked_array([b]))
    out = np.empty(len(a), np.int32)
    longest = np.maximum(np.diff(at_x), np.diff(at_y))
    for own in _batches(np.ones(len(a), np.int64), longest):
        out[own] = edit_distances(*_padded(x, at_x, own), *_padded(y, at_y, own))
    return pa.array(out)


# ---------------------------------------------------------------- alignment on arrays


def align(seq: np.ndarray, length: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Progressive alignments of many groups at once: ``seq`` (groups, values, tokens) of ids, -1 beyond
    ``length``; ``weight`` (groups, values).  Returns the columns (groups, values, columns), -1 for a
    gap, and their number by group.

    A value is aligned against the profile of those before it by dynamic programming: two columns
    match at the share of the votes that disagree, and a gap costs ``GAP``."""
    groups, n, _ = seq.shape
    columns = np.full(seq.shape, -1, np.int32)
    columns[:, 0] = seq[:, 0]
    used = length[:, 0].copy()
    for t in range(1, n):
        a = np.flatnonzero(length[:, t] > 0)
        if not len(a):
            continue
        wide = int(max(1, used[a].max()))
        prof, own = columns[a, :t, :wide], seq[a, t, : max(1, int(length[a, t].max()))]
        share = weight[a, :t] / np.maximum(weight[a, :t].sum(1, keepdims=True), 1e-300)
        left, right, count = _paths(prof, share, used[a], own, length[a, t])
        room = max(int(count.max()), columns.shape[2])
        new = np.full((groups, n, room), -1, np.int32)
        new[:, :, : columns.shape[2]] = columns
        c = left.shape[1]
        line = np.arange(len(a))[:, None]
        moved = np.where(left[:, None, :] >= 0, prof[line[:, :, None], np.arange(t)[None, :, None], np.maximum(left, 0)[:, None, :]], -1)
        new[a[:, None], :t] = -1
        new[a[:, None, None], np.arange(t)[None, :, None], np.arange(c)[None, None, :]] = moved
        new[a[:, None], t, np.arange(c)[None, :]] = np.where(right >= 0, own[line, np.maximum(right, 0)], -1)
        columns, used[a] = new, count
    return columns, used


def _costs(prof: np.ndarray, share: np.ndarray, own: np.ndarray, i: int) -> np.ndarray:
    """Costs of matching column ``i`` of each profile with each token."""
    agree = (share[:, :, None] * (prof[:, :, i, None] == own[:, None, :])).sum(1)
    return np.rint(APART * (1 - agree)).astype(np.int32)


def _row(before: np.ndarray, match: np.ndarray) -> np.ndarray:
    """The next row of the alignment's cost table: a running minimum takes the place of the step that
    depends on the cell to the left."""
    row = before + GAP
    row[:, 1:] = np.minimum(row[:, 1:], before[:, :-1] + match)
    slope = GAP * np.arange(row.shape[1], dtype=np.int32)
    return np.minimum.accumulate(row - slope, axis=1) + slope


def _paths(prof: np.ndarray, share: np.ndarray, n_cols: np.ndarray, own: np.ndarray, n_own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group the column of the profile and the token that meet in each column of the alignment (-1
    for a gap), and the number of these."""
    groups, p, m = len(prof), prof.shape[2], own.shape[1]
    if groups == 1 and p > 1 and (p + 1) * (m + 1) > MAX_CELLS:
        left, right = _halved(prof[:, :, : n_cols[0]], share, own[:, : n_own[0]])
        return left[None], right[None], np.array([len(left)])
    table = np.empty((p + 1, groups, m + 1), np.int32)
    table[0] = GAP * np.arange(m + 1, dtype=np.int32)
    for i in range(p):
        table[i + 1] = _row(table[i], _costs(prof, share, own, i))
    i, j = n_cols.astype(np.int64), n_own.astype(np.int64)
    line = np.arange(groups)
    left, right = np.full((groups, p + m), -1, np.int64), np.full((groups, p + m), -1, np.int64)
    step = 0
    while True:
        open_ = (i > 0) | (j > 0)
        if not open_.any():
            break
        here = table[i, line, j]
        up = open_ & (i > 0) & (here == table[np.maximum(i - 1, 0), line, j] + GAP)
        back = open_ & ~up & (j > 0) & (here == table[i, line, np.maximum(j - 1, 0)] + GAP)
        both = open_ & ~up & ~back
        i, j = i - (up | both), j - (back | both)
        left[up | both, step], right[back | both, step] = i[up | both], j[back | both]
        step += 1
    left, right = left[:, :step], right[:, :step]
    count = ((left >= 0) | (right >= 0)).sum(1)
    # Steps run from the end; each path is turned round within its own length.
    turn = count[:, None] - 1 - np.arange(step)[None, :]
    keep = turn >= 0
    return tuple(np.where(keep, x[line[:, None], np.maximum(turn, 0)], -1) for x in (left, right)) + (count,)


def _halved(prof: np.ndarray, share: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The path of one long pair in linear space: the profile is cut in the middle, and the sequence
    where the costs of both halves are least in sum."""
    p, m = prof.shape[2], own.shape[1]
    if (p + 1) * (m + 1) <= MAX_CELLS or p < 2:
        left, right, _ = _paths(prof, share, np.array([p]), own, np.array([m]))
        return left[0], right[0]

    def last(prof: np.ndarray, own: np.ndarray) -> np.ndarray:
        row = (GAP * np.arange(m + 1, dtype=np.int32))[None]
        for i in range(prof.shape[2]):
            row = _row(row, _costs(prof, share, own, i))
        return row[0]

    mid = p // 2
    cut = int((last(prof[:, :, :mid], own).astype(np.int64) + last(prof[:, :, : mid - 1 : -1], own[:, ::-1])[::-1]).argmin())
    a = _halved(prof[:, :, :mid], share, own[:, :cut])
    b = _halved(prof[:, :, mid:], share, own[:, cut:])
    return tuple(np.r_[x, np.where(y >= 0, y + shift, -1)] for x, y, shift in zip(a, b, (mid, cut)))


def consensus(columns: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, number) of each group's consensus: the token of most weight in each column, of equal
    ones that of the first value; gaps drop out."""
    groups, n, wide = columns.shape
    votes = np.zeros(columns.shape)
    for v in range(n):
        votes += weight[:, v, None, None] * (columns == columns[:, v, None, :])
    votes[weight <= 0] = -1
    token = np.take_along_axis(columns, votes.argmax(axis=1)[:, None, :], axis=1)[:, 0]
    order = np.argsort(token < 0, axis=1, kind="stable")
    return np.take_along_axis(token, order, axis=1), (token >= 0).sum(1)


def edit_distances(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of token sequences, one pair a row."""
    row = np.broadcast_to(np.arange(b.shape[1] + 1), (len(a), b.shape[1] + 1)).astype(np.int32)
    slope = np.arange(b.shape[1] + 1, dtype=np.int32)
    end = row[np.arange(len(a)), n_b].copy()
    for i in range(a.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (a[:, i, None] != b))
        row = np.minimum.accumulate(new - slope, axis=1) + slope
        done = n_a == i + 1
        end[done] = row[done, n_b[done]]
    return end


def token_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two token sequences."""
    [(x, at_x), (y, at_y)], _ = _token_ids(pa.chunked_array([[a]], pa.list_(pa.string())), pa.chunked_array([[b]], pa.list_(pa.string())))
    one = np.zeros(1, np.int64)
    return int(edit_distances(*_padded(x, at_x, one), *_padded(y, at_y, one))[0])
