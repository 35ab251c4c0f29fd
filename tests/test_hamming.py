import tracemalloc

import numpy as np
import pytest

from pixelloom.operators import duplicates, graphs, hamming


def codes(n, seed=1, planted=0.3):
    """Random codes with planted neighbours, distinct."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64).view(np.uint64)
    near = base[: int(n * planted)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    return np.unique(np.concatenate([base, near]))


def brute(code, k):
    i, j = np.nonzero(np.triu(np.bitwise_count(code[:, None] ^ code[None, :]) <= k, 1))
    return set(zip(i.tolist(), j.tolist()))


def frame(spark, code):
    return spark.createDataFrame([(i, int(c.astype(np.int64) if hasattr(c, "astype") else c), "x") for i, c in enumerate(code.view(np.int64))], "id bigint, code bigint, cell string")


@pytest.mark.parametrize("k", [0, 3, 5])
def test_pairs_equal_brute_force(spark, k):
    c = codes(600)
    got = [(r["a"], r["b"], r["distance"]) for r in hamming.near_pairs(frame(spark, c), k).collect()]
    assert len(got) == len(set(got)) and {g[:2] for g in got} == brute(c, k)
    assert all(d == int(np.bitwise_count(c[a] ^ c[b])) for a, b, d in got)


@pytest.mark.parametrize("r", [1, 2, 3])
def test_every_scheme_is_complete(spark, monkeypatch, r):
    monkeypatch.setattr(hamming, "scheme", lambda n, k: r)
    c = codes(400, seed=r)
    assert {(x["a"], x["b"]) for x in hamming.near_pairs(frame(spark, c), 5).collect()} == brute(c, 5)


def test_hot_cells_are_split_and_keep_all_pairs(spark):
    # All codes share most of their bits, so every band is hot.
    rng = np.random.default_rng(5)
    c = np.unique(rng.integers(0, 2**14, 500).astype(np.uint64) << np.uint64(20))
    df = frame(spark, c).select("id", "code")
    cells = hamming.cells(df, 3, len(c), hot=50)
    found = hamming.over_cells(cells, 3, "a bigint, b bigint, distance int", hamming.pairs_in_cell, 4).distinct()
    assert {(x["a"], x["b"]) for x in found.collect()} == brute(c, 3)


@pytest.mark.parametrize("bits", [4, 9, 12, 64])
def test_large_cells_are_cut_and_keep_all_pairs(monkeypatch, bits):
    monkeypatch.setattr(hamming, "LARGE_CELL", 10)
    monkeypatch.setattr(hamming, "BLOCK", 16)
    rng = np.random.default_rng(bits)
    c = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) & np.uint64(2**bits - 1)) if bits < 64 else codes(200)
    ident = np.arange(len(c))
    every = [np.concatenate(x) for x in zip(*hamming.pairs_in_cell(ident, c, 5))]
    assert set(zip(every[0].tolist(), every[1].tolist())) == brute(c, 5)
    linked = np.arange(len(c))
    for a, b in hamming.forest_in_cell(ident, c, 5):
        linked[b] = a
    want = np.arange(len(c))
    graphs.join_labels(want, *(np.array(x) for x in zip(*brute(c, 5))))
    assert linked.tolist() == want.tolist()
    probe = np.arange(len(c)) % 3 == 0
    known = {int(x) for (part,) in hamming.known_in_cell(ident, c, 5, probe) for x in part}
    assert known == {x for pair in brute(c, 5) for x, y in (pair, pair[::-1]) if probe[x] and not probe[y]}


def test_a_dense_cell_needs_no_pair_list():
    # 100,000 codes in 17 bits are billions of near pairs and one component.
    rng = np.random.default_rng(3)
    c = np.sort(rng.permutation(2**17)[:100_000]).astype(np.uint64) << np.uint64(11)
    tracemalloc.start()
    edges = list(hamming.forest_in_cell(np.arange(len(c)), c, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(a) for a, _ in edges) == len(c) - 1 and all((a == 0).all() for a, _ in edges)
    assert peak < 100_000_000


def test_a_dense_cluster_gives_few_edges(spark):
    c = np.unique(np.array([sum(1 << b for b in bits) for bits in [(i, j) for i in range(30) for j in range(30)]], dtype=np.uint64))
    edges = hamming.near_forest(frame(spark, c), 5).count()
    assert edges <= 6 * len(c)


def test_empty_null_and_extra_columns(spark):
    empty = spark.createDataFrame([], "id bigint, code bigint, cell bigint, probe boolean")
    assert hamming.near_pairs(empty, 5).count() == 0 and hamming.near_forest(empty, 5).count() == 0
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (None, 7, 1), (3, None, 1), (4, 6, 1)], "file_id bigint, dhash bigint, n int")
    assert sorted(map(tuple, hamming.representatives(rows, "dhash", "file_id").collect())) == [(6, 4, 1), (7, 1, 3)]
    with pytest.raises(ValueError):
        hamming.near_pairs(empty, 40)


def star_rows(spark, c):
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(c.view(np.int64))], "file_id bigint, dhash bigint")


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_groups_equal_union_find(spark, monkeypatch, limit):
    monkeypatch.setattr(graphs, "TASK_EDGES", limit)
    c = codes(300, seed=9, planted=0.8)
    chain = np.cumsum(np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(1, 40, dtype=np.uint64)]))
    c = np.unique(np.concatenate([c, chain]))
    parent = list(range(len(c)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in brute(c, 2):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    sizes = {}
    for i in range(len(c)):
        sizes[root(i)] = sizes.get(root(i), 0) + 1
    want = {(i, root(i)) for i in range(len(c)) if sizes[root(i)] > 1}
    assert {tuple(r) for r in duplicates.near_groups(star_rows(spark, c), 2).select("file_id", "group_id").collect()} == want


def test_representative_pairs_and_members_give_all_pairs_of_files(spark, monkeypatch):
    from pixelloom.plans.catalogue_queries import _j3, _j7, _j8

    few = codes(60).view(np.int64)
    rows = [(i, int(few[0] if i % 3 == 0 else few[i % len(few)])) for i in range(300)]
    hashes = spark.createDataFrame([(i, b"x", d) for i, d in rows] + [(999, b"x", None)], "file_id bigint, blake3 binary, dhash bigint")
    want = {k: brute(np.array([d for _, d in rows], np.int64).view(np.uint64), k) for k in (3, 5)}
    join_hot = duplicates.join_hot
    for floor in (20_000, 10):
        monkeypatch.setattr(duplicates, "join_hot", lambda *a, floor=floor: join_hot(*a, floor=floor))
        members = {}
        found = _j8(hashes).collect()
        for r in found:
            members.setdefault(r["representative"], []).append(r["file_id"])
        assert len(found) == 300 and all(r["n"] == len(members[r["representative"]]) for r in found)
        inside = {(a, b) for m in members.values() for a in m for b in m if a < b}
        for k, pairs in ((5, _j3), (3, _j7)):
            across = {(min(x, y), max(x, y)) for r in pairs(hashes).collect() for x in members[r["a"]] for y in members[r["b"]]}
            assert inside | across == want[k]
