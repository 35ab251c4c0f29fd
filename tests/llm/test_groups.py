"""Problems 2, 4, 5 and 6: groups, survivors, neighbours and batches of picture hashes."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import components, consensus, history, hnsw, segments
from pixelloom.session import Staging


def codes(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64).view(np.uint64)
    near = np.concatenate([base[: n // 3]] * 2)
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    return np.concatenate([base, near])


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


# ------------------------------------------------------------------ components
def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {(x, root(x)) for x in parent}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)],  # a long chain
    [(i + 1, i) for i in range(0, 100, 2)] + [(0, i) for i in range(0, 100, 7)],
    [(0, i) for i in range(1, 300)],  # a hub
    [(5, 5), (6, 7), (7, 6), (6, 7)],
    [(random.Random(i).randrange(120), random.Random(-i).randrange(120)) for i in range(1, 90)],
    [(a * 2, b * 2 + 1) for a, b in zip(np.random.default_rng(0).permutation(64).tolist(), np.random.default_rng(1).permutation(64).tolist())],
])
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame([(a, b, 1) for a, b in edges] + [(None, 3, 1), (4, None, 1)], "a bigint, b bigint, node int")
    got = {tuple(r) for r in components.connected_components(df, Staging(spark, "t")).collect()}
    assert got == union_find(edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint"), Staging(spark, "t")).count() == 0


def test_near_groups_of_nulls_copies_and_hot_codes(spark):
    rows = [(i, 77) for i in range(50, 450)] + [(1, 76), (2, None), (None, 77), (3, 10**15), (3, 10**15), (4, 0x0FF0FF0FF0FF)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "file_id bigint, dhash bigint, group_id string")
    got = {tuple(r) for r in components.near_groups(df, "dhash", "file_id", 5).collect()}
    assert got == {(i, 1) for i in [1, *range(50, 450)]} | {(3, 3)}
    assert components.near_groups(df.limit(0), "dhash", "file_id", 5).count() == 0


# ------------------------------------------------------------------ survivors
FILES = "id bigint, path string, size bigint, width bigint, height bigint, extra string, group int, member int"


def survivors(spark, files, hashes):
    f = spark.createDataFrame([(*x, "e", 1, 1) for x in files], FILES)
    h = spark.createDataFrame([(i, b, "z") for i, b in hashes], "file_id bigint, blake3 binary, path string")
    return sorted(map(tuple, consensus.surviving_fields(f, h).select("group_id", "size_id", "dims_id", "path_id").collect()))


def test_votes_and_ties(spark):
    h = bytes([1]) * 32
    files = [(1, "ccc", 10, 5, 5), (2, "bb", 10, 4, 9), (3, "aa", 12, 9, 4), (4, "dddd", 12, 70000, 5), (5, "eeee", 0, 0, 0), (6, "é", None, None, 3)]
    # sizes tie at two votes: the larger; dims 4x9 and 9x4 tie on pixels: the wider
    assert survivors(spark, files, [(i, h) for i in range(1, 7)]) == [(1, 3, 3, 6)]
    assert survivors(spark, files, [(2, h), (3, h)]) == [(2, 3, 3, 3)]  # equally short: byte order
    assert survivors(spark, files, [(5, h), (99, h)]) == [(5, 0, 0, 5)]
    assert survivors(spark, [], [(5, h), (99, h)])[0][:3] == (5, 0, 0)


def test_what_is_no_hash_makes_no_group(spark):
    assert survivors(spark, [(1, "a", 1, 1, 1), (2, "b", 1, 1, 1)], [(1, bytes(32)), (2, bytes(32)), (1, b""), (2, b""), (1, None), (2, None), (1, b"x" * 31), (2, b"x" * 31), (1, b"y" * 32)]) == []


def test_a_group_of_a_third_of_all_rows(spark):
    h, files = bytes([7]) * 32, [(i, f"p{i:06d}", 5, 3, 3) for i in range(3000)]
    hashes = [(i, h if i % 3 == 0 else i.to_bytes(4, "big") * 8) for i in range(1, 3000)]
    assert survivors(spark, files, hashes) == [(3, 3, 3, 3)]


def run_consensus(spark, values, **kw):
    df = spark.createDataFrame([(g, v, 1) for g, v in values], "group bigint, value string, votes int")
    return {r["group"]: (r["value"], r["distance"]) for r in consensus.consensus_of_tokens(df, F.filter(F.split("value", " "), lambda t: t != ""), **kw).collect()}


def test_consensus_takes_the_value_nearest_to_the_vote(spark):
    values = [(1, "a b c d"), (1, "a b x d"), (1, "a b c e"), (2, "only"), (2, "only"), (3, None), (None, "v"), (4, ""), (4, ""), (5, "k"), (5, "l"), (6, "a c d"), (6, "a b c d"), (6, "a b c d e")]
    assert run_consensus(spark, values) == {1: ("a b c d", 0), 2: ("only", 0), 4: ("", 0), 5: ("k", 0), 6: ("a b c d", 0)}
    assert run_consensus(spark, []) == {}


def test_long_values_are_aligned_whole(spark, monkeypatch):
    # All values agree but for a word each, of which no two are the same; one of them has none.
    words = [f"w{i}" for i in range(1000)]
    odd = lambda i: " ".join(words[:i] + ["x"] + words[i + 1 :])
    values = [(1, odd(i)) for i in (10, 400, 401, 990)] + [(1, " ".join(words))]
    assert run_consensus(spark, values)[1] == (" ".join(words), 0)
    monkeypatch.setattr(consensus, "MAX_CELLS", 50_000)  # pairs are halved first
    assert run_consensus(spark, values)[1] == (" ".join(words), 0)


def test_large_groups_are_aligned_in_blocks(spark, monkeypatch):
    values = [(1, f"the {i} cat sat down") for i in range(60)] + [(1, "the grey cat sat down")] * 9 + [(2, "a b"), (2, "a c")]
    whole = run_consensus(spark, values)
    monkeypatch.setattr(consensus, "BLOCK", 4)
    assert whole[1][0] == "the grey cat sat down" and run_consensus(spark, values) == whole


def test_blocks_choose_what_the_whole_group_chooses(spark, monkeypatch):
    rnd = random.Random(4)
    values = []
    for g in range(12):
        base = [rnd.choice("abcdefgh") for _ in range(8)]
        for _ in range(40):
            own = list(base)
            for _ in range(rnd.randrange(3)):
                own[rnd.randrange(len(own))] = rnd.choice("abcdefgh")
            if rnd.random() < 0.3:
                del own[rnd.randrange(len(own))]
            values += [(g, " ".join(own))] * rnd.randrange(1, 3)
    whole = run_consensus(spark, values)
    monkeypatch.setattr(consensus, "BLOCK", 8)
    blocks = run_consensus(spark, values)
    assert sum(whole[g][0] == blocks[g][0] for g in whole) >= 11


@pytest.mark.parametrize("block", [3, 64])
def test_trusted_values_outweigh_all_below_them(spark, monkeypatch, block):
    monkeypatch.setattr(consensus, "BLOCK", block)
    paths = [f"/a/b{i:02}/long name.jpg" for i in range(20)] + ["/z/y.jpg", "/z/x.jpg", "/a/b00/long name 2.jpg"]
    files = spark.createDataFrame([(i, p, 5 if i % 2 else 6, 10, 20) for i, p in enumerate(paths)], "id bigint, path string, size bigint, width bigint, height bigint")
    hashes = spark.createDataFrame([(i, bytes([7]) * 32) for i in range(len(paths))], "file_id bigint, blake3 binary")
    assert [tuple(r) for r in consensus.surviving_fields(files, hashes).collect()] == [(0, 0, 0, paths.index("/z/x.jpg"))]


def test_fields_come_through_the_alignment(spark, monkeypatch):
    monkeypatch.setattr(consensus, "align", None)
    files = spark.createDataFrame([(i, f"/{i}", i, 10, 20) for i in range(3)], "id bigint, path string, size bigint, width bigint, height bigint")
    with pytest.raises(Exception, match="NoneType"):
        consensus.surviving_fields(files, spark.createDataFrame([(i, bytes([7]) * 32) for i in range(3)], "file_id bigint, blake3 binary")).collect()


def test_alignment_of_values():
    seq = np.array([[[1, 2, 3], [1, 3, -1], [1, 3, -1]]], np.int32)
    length, weight = np.array([[3, 2, 2]]), np.array([[1.0, 1.0, 5.0]])
    columns, used = consensus.align(seq, length, weight)
    assert columns[0, :, : used[0]].tolist() == [[1, 2, 3], [1, -1, 3], [1, -1, 3]]
    token, n = consensus.consensus(columns, weight)
    assert token[0, : n[0]].tolist() == [1, 3]
    assert consensus.token_distance(list("kitten"), list("sitting")) == 3 and consensus.token_distance([], ["a"]) == 1


# ------------------------------------------------------------------ neighbours
def exact_neighbours(rows, k, keep):
    out = set()
    for a, x in rows:
        near = sorted((bits(x, y), b) for b, y in rows if b != a and bits(x, y) <= k)[:keep]
        out |= {(min(a, b), max(a, b)) for _, b in near}
    return out


def test_similar_files_reach_the_exact_ones(spark):
    c = codes(900, 3).view(np.int64).tolist()
    rows = list({i: x for i, x in enumerate(c + c[:40] + c[:5] * 6)}.items())
    df = spark.createDataFrame([(i, x, 1) for i, x in rows] + [(None, 5, 1), (10**6, None, 1)], "file_id bigint, dhash bigint, rep int")
    got = {tuple(r) for r in hnsw.similar_files(df, "dhash", "file_id", 5).collect()}
    want = exact_neighbours(rows, 5, 3)
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


@pytest.mark.parametrize("one_batch", [100, 4_096])
def test_graphs_over_many_shards(spark, monkeypatch, one_batch):
    monkeypatch.setattr(hnsw, "ONE_BATCH", one_batch)
    monkeypatch.setattr(hnsw, "SHARD", 200)
    monkeypatch.setattr(hnsw, "LARGE_SHARD", 300)
    c = codes(700, 4)
    c = np.concatenate([c, (c[:400] & ~np.uint64(0xFFFFFFF))])  # one band value shared by many
    rows = list(enumerate(np.unique(c).view(np.int64).tolist()))
    got = {tuple(r) for r in hnsw.similar_files(spark.createDataFrame(rows, "file_id bigint, dhash bigint"), "dhash", "file_id", 5).collect()}
    want = exact_neighbours(rows, 5, 3)
    assert len(got & want) >= 0.95 * len(want)


def test_graph_is_searched_not_scanned():
    c = np.unique(codes(4000, 8))
    graph = hnsw.FlatGraph(c)
    assert graph.links[0].shape == (len(c), 20) and graph.top >= 1
    a, b, d = hnsw.shard_neighbours(c, 5, 3, 32)
    got = set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for s in range(0, len(c), 500) for i, j in ((s + x, y) for x, y in zip(*np.nonzero(np.bitwise_count(c[s : s + 500, None] ^ c[None, :]) <= 5))) if i != j}
    assert len(got) > 0.9 * len(want) and (d <= 5).all()


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, 5)], "file_id bigint, dhash bigint")
    assert hnsw.similar_files(df, "dhash", "file_id", 5).count() == 0 == hnsw.similar_files(df.limit(0), "dhash", "file_id", 5).count()
    twice = df.unionByName(df)
    assert hnsw.similar_files(twice, "dhash", "file_id", 5).count() == 0  # one row, repeated


# ------------------------------------------------------------------ batches
HASH = "batch_no int, file_id bigint, blake3 binary, dhash bigint, pos string"


def sequential(hist, inc):
    ok = lambda b: b is not None and len(b) == 32 and b != bytes(32)
    B, D, out = {b for b, _ in hist if ok(b)}, [d for _, d in hist if d], set()
    for no, f, b, d in sorted(set(inc), key=lambda r: (r[0], r[1], r[2] or b"", r[3] or 0)):
        if (ok(b) and b in B) or (d and any(bits(d, e) <= 5 for e in D)):
            out.add((no, f))
        else:
            B |= {b} if ok(b) else set()
            D += [d] if d else []
    return out


def run_history(spark, hist, inc):
    h = spark.createDataFrame([(b, d, 1) for b, d in hist], "blake3 binary, dhash bigint, n int")
    i = spark.createDataFrame([(*r, "p") for r in inc], HASH)
    return {tuple(r) for r in history.already_known(h, i, 5).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_batches_against_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    centre = [rnd.getrandbits(63) for _ in range(12)]

    def code():
        x = rnd.choice(centre)
        for _ in range(rnd.randrange(7)):
            x ^= 1 << rnd.randrange(63)
        return rnd.choice([x, x, x, None, 0, rnd.getrandbits(63)])

    blake = lambda: rnd.choice([None, bytes(32), b"", bytes([rnd.randrange(40)]) * 32, rnd.randbytes(32)])
    hist = [(blake(), code()) for _ in range(15)]
    inc = [(rnd.randrange(1, 6), i, blake(), code()) for i in range(160)]
    inc += [(r[0] + 1, r[1], r[2], r[3]) for r in inc[:20]] + inc[:10]
    assert run_history(spark, hist, inc) == sequential(hist, inc)


def test_chain_of_batches_alternates(spark):
    # Each code is near the one before alone: every second one is a case.
    x, inc = 0x5555, []
    for i in range(20):
        x ^= 0b1111 << (3 * i)
        inc.append((1, i, None, x))
    got = run_history(spark, [], inc)
    assert got == sequential([], inc)


def test_history_edge_cases(spark):
    assert run_history(spark, [], []) == set() == run_history(spark, [(None, 5)], [])
    hot = [(1, i, bytes([9]) * 32, 12345) for i in range(300)]
    assert run_history(spark, [], hot) == {(1, i) for i in range(1, 300)}
    assert run_history(spark, [(bytes([9]) * 32, None)], hot) == {(1, i) for i in range(300)}
    assert run_history(spark, [(None, 0)], [(1, 1, None, 0), (1, 2, None, 0), (1, 3, None, None)]) == set()


def test_index_is_appended_not_rebuilt(spark, tmp_path):
    segments.CodeIndex.create(spark, str(tmp_path / "i"), 5, 100)
    index = segments.CodeIndex.open(spark, str(tmp_path / "i"))
    f = lambda *xs: spark.createDataFrame([(x, "c") for x in xs], "code bigint, cell string")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    far = 0xFFFF << 45
    assert index.known(f(far)).count() == 0 and index.known(f()).count() == 0
    index.append(f(1 << 40))
    before = files()
    assert {r["code"] for r in index.known(f((1 << 40) | 3, far)).collect()} == {(1 << 40) | 3}
    index.append(f(far))
    assert {r["code"] for r in index.known(f(far ^ 5, 0xFFFF)).collect()} == {far ^ 5}
    assert all(files()[p] == t for p, t in before.items()) and len(files()) > len(before)


def test_batches_one_by_one_give_what_all_at_once_give(spark, tmp_path):
    rnd = random.Random(8)
    pool = [rnd.getrandbits(63) for _ in range(30)]
    row = lambda b, i: (b, i, rnd.choice([None, bytes([rnd.randrange(60)]) * 32]), rnd.choice(pool) ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)))
    hist = [row(0, i)[2:] for i in range(10)]
    inc = [row(b, 100 * b + i) for b in (1, 2, 3) for i in range(30)]
    index = history.HistoryIndex.create(spark, str(tmp_path / "h"), 5, 100)
    index.append(spark.createDataFrame(hist, "blake3 binary, dhash bigint"))
    got = set()
    for b in (1, 2, 3):
        batch = spark.createDataFrame([(*r, "p") for r in inc if r[0] == b], HASH)
        got |= {tuple(r) for r in history.HistoryIndex.open(spark, str(tmp_path / "h")).check(batch).collect()}
    assert got == run_history(spark, hist, inc) == sequential(hist, inc)


def test_a_small_batch_opens_a_share_of_the_index_that_falls_with_its_size(spark, tmp_path):
    def share(n):
        index = segments.CodeIndex.create(spark, str(tmp_path / f"i{n}"), 5, n)
        rng = np.random.default_rng(n)
        index.append(spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, 300)], "code bigint"))
        asked = index._keyed(spark.createDataFrame([(12345,)], "code bigint")).select("bucket").distinct()
        stored = index.stored([r["bucket"] for r in asked.collect()])
        opened = [r[0] for r in stored.select(F.input_file_name()).distinct().collect()]
        size = lambda paths: sum(p.stat().st_size for p in paths)
        return size(map(Path, (p.removeprefix("file://") for p in opened))) / size((tmp_path / f"i{n}" / "codes").rglob("*.parquet"))

    small, large = share(100), share(5_000_000)
    assert large < small / 3


@pytest.mark.parametrize("walk", [7, 100_000])
def test_large_components_are_settled_from_the_front(spark, monkeypatch, walk):
    monkeypatch.setattr(history, "WALK", walk)
    rnd = random.Random(walk)
    x, inc = rnd.getrandbits(60), []
    for i in range(80):
        x ^= (1 << rnd.randrange(60)) | (1 << rnd.randrange(60))
        inc.append((1, i, rnd.choice([None, bytes([rnd.randrange(9)]) * 32]), x))
    assert run_history(spark, [], inc) == sequential([], inc)


def test_writes_do_not_grow_with_a_chain(spark, monkeypatch):
    written = []
    real = Staging.write
    monkeypatch.setattr(Staging, "write", lambda self, *a, **k: written.append(1) or real(self, *a, **k))

    def writes(n):
        written.clear()
        x, inc = 0x5555, []
        for i in range(n):
            x ^= 0b1111 << (3 * i)
            inc.append((1, i, None, x))
        run_history(spark, [], inc)
        return len(written)

    assert writes(4) == writes(16)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_string_index_equals_brute_force(spark, tau):
    rnd = random.Random(tau)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 12))) for _ in range(60)] + [None, "", "x" * 300, "x" * 299 + "y"]

    def distance(a, b):
        return consensus.token_distance(list(a), list(b))

    df = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "id bigint, text string, length int")
    index = segments.StringIndex(Staging(spark, "t"), tau)
    index.append(df.filter("id < 40"))
    index.append(df.filter("id >= 40"))
    got = {(r["id"], r["stored_id"], r["distance"]) for r in index.probe(df).collect()}
    ok = [(i, w) for i, w in enumerate(words) if w is not None]
    assert got == {(i, j, distance(a, b)) for i, a in ok for j, b in ok if abs(len(a) - len(b)) <= tau and distance(a, b) <= tau}
