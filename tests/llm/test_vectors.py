import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import clusters as C
from quern.llm import graph as G
from quern.llm import kcenter as K
from quern.llm import vectors as V

SCHEMA = "key bigint, vector array<float>"


def noisy(n_groups, size, dim=128, spread=0.35, singles=200, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_groups):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(size):
            x = base + spread * rng.normal(size=dim) / np.sqrt(dim)
            out.append(x / np.linalg.norm(x))
    out += list(rng.normal(size=(singles, dim)))
    order = rng.permutation(len(out))
    return [(int(k) + 1, [float(v) for v in np.float32(out[i])]) for k, i in enumerate(order)]


DIRT = [(None, [1.0] * 128), (9001, None), (9002, []), (9003, [1.0] * 3), (9004, [0.0] * 128), (9005, [float("nan")] + [1.0] * 127), (9006, [None] + [1.0] * 127), (9007, [float("inf")] + [1.0] * 127)]


def brute(rows, k=5, similarity=0.75):
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    keys = np.array([r[0] for r in rows])
    u = V.unit(np.array([r[1] for r in rows], float))
    q = V.micro(u, u)
    r, c = V.best(q, keys, keys, k)
    ok = q[r, c] >= similarity * V.MICRO
    return {(int(keys[a]), int(keys[b]), int(q[a, b])) for a, b in zip(r[ok], c[ok])}, keys, q


def test_neighbours_equal_brute_force(spark):
    rows = noisy(40, 7)
    rows += [(k + 5000, v) for k, v in rows[:30]]  # copies under other keys: ties
    df = spark.createDataFrame([*rows, *DIRT], SCHEMA).withColumn("neighbour", F.lit(1)).withColumn("comp", F.lit("x"))
    got = {tuple(r) for r in V.similar_neighbours(df).collect()}
    assert got == brute(rows)[0]


@pytest.mark.parametrize(("group", "chunk"), [(10, 16)])
def test_large_groups_take_the_chunked_way(spark, monkeypatch, group, chunk):
    rows = noisy(3, 24, singles=40)
    rows += [(7000 + i, rows[0][1]) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {tuple(r) for r in C.similarity_clusters(df).select("key", "cluster", "size").collect()}
    monkeypatch.setattr(V, "GROUP_ROWS", group)
    monkeypatch.setattr(V, "CHUNK_ROWS", chunk)
    small = V.chunk_pairs
    monkeypatch.setattr(V, "chunk_pairs", lambda large: small(large, chunk))
    want, keys, q = brute(rows)
    assert {tuple(r) for r in V.similar_neighbours(df).collect()} == want
    assert {tuple(r) for r in C.similarity_clusters(df).select("key", "cluster", "size").collect()} == plain
    assert len({c for _, c, _ in plain}) == 3


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert V.similar_neighbours(empty).count() == 0 and C.similarity_clusters(empty).count() == 0 and K.varied_subset(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 128), (1, [1.0] * 128)], SCHEMA)
    assert V.similar_neighbours(one).count() == 0
    assert V.nearest_of(empty, one).count() == 0


def test_clusters_need_five_and_all_pairs(spark):
    rows = noisy(6, 5, singles=50, seed=1) + [(9000 + i, r[1]) for i, r in enumerate(noisy(4, 4, singles=0, seed=2))]
    got = C.similarity_clusters(spark.createDataFrame([*rows, *DIRT], SCHEMA)).collect()
    assert len(got) == 30 and {r["size"] for r in got} == {5}
    text = spark.createDataFrame([(r["key"], None if i else "t") for i, r in enumerate(got)], "key bigint, text string")
    about = C.describe_clusters(spark.createDataFrame(got), text).collect()
    assert len(about) == 6 and all(len(r["typical_keys"]) == 3 for r in about)
    assert all(r["typical_keys"][0] in {g["key"] for g in got if g["cluster"] == r["cluster"]} for r in about)


def test_average_linkage_against_the_plain_algorithm():
    rng = np.random.default_rng(3)
    for trial in range(5):
        x = V.unit(np.repeat(rng.normal(size=(4, 6)), 8, 0) + 0.6 * rng.normal(size=(32, 6)))
        groups = [[i] for i in range(32)]
        while True:  # always the best pair
            best = max(((np.mean(x[a] @ x[b].T), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(0, 0, 0))
            if best[0] < 0.7:
                break
            groups[best[1]] += groups.pop(best[2])
        lab = C.link_average(x, np.ones(32), 0.7, 31)
        assert sorted(sorted(g) for g in groups) == sorted(sorted(np.flatnonzero(lab == v).tolist()) for v in np.unique(lab)), trial


def test_peel_keeps_a_clique():
    x = V.unit(np.array([[1, 0, 0], [1, 0.1, 0], [1, 0, 0.1], [0.7, 0.7, 0]]))
    assert C.peel(x, 750_000).tolist() == [0, 1, 2]


def test_bucket_labels_in_tiles():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)
    words = base[rng.integers(0, 6, 300)]
    lab = V.bucket_labels(words, 80, tile=16)
    want = {tuple(w): np.flatnonzero((words == w).all(1)) for w in np.unique(words, axis=0)}
    assert all((lab[m] == m[0]).all() or len(set(lab[m])) == 1 for m in want.values()) and len(set(lab.tolist())) == len(want)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (5, 5), (None, 4), (30, 20), (20, 10), (10, 3)], "a bigint, b bigint")
    assert {tuple(r) for r in G.connected_components(links).collect()} == {(1, 1), (2, 1), (3, 1), (10, 1), (20, 1), (30, 1), (7, 7), (8, 7), (9, 7)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint")
    assert {r["comp"] for r in G.connected_components(chain).collect()} == {0}
    assert G.connected_components(chain.limit(0)).count() == 0


def test_nearest_of_a_query_set(spark):
    rows = noisy(10, 4, singles=150, seed=7)
    df = spark.createDataFrame([*rows, *DIRT], SCHEMA)
    want = brute(rows, 5, -2)[0]
    q = df.where("key % 10 = 0")
    for block in (7, 4096):
        got = {(r["key"], r["neighbour"], r["micro"]) for r in V.nearest_of(q, df, block=block).collect()}
        assert got == {w for w in want if w[0] % 10 == 0}


def test_varied_subset(spark):
    rows = noisy(1, 400, singles=600, seed=9) + [(9100 + i, noisy(0, 0, singles=1, seed=99)[0][1]) for i in range(300)]
    df = spark.createDataFrame([*rows, *DIRT], SCHEMA)
    got = K.varied_subset(df, 0.05).collect()
    assert len(got) == 65 and len({r["key"] for r in got}) == 65
    vec = dict(rows)
    u = V.unit(np.array([vec[r["key"]] for r in got], float))
    assert ((u @ u.T) > 0.75).sum() == 65  # neither the near group nor the copies are there twice
    assert K.varied_subset(df.limit(3), 0.01).count() == 1


@pytest.mark.parametrize("block", [128, 1024, 4096])
def test_a_tight_group_has_one_place_at_every_block_size(spark, monkeypatch, block):
    """Half of the rows are one tight group; the covering radius stays near that of exact farthest-first."""
    rng = np.random.default_rng(17)
    base = rng.normal(size=128)
    x = np.concatenate([base + 0.02 * rng.normal(size=(1_500, 128)), rng.normal(size=(1_500, 128))])
    x = np.float32(V.unit(x))[rng.permutation(3_000)]
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "PIVOTS", 256)
    got = K.varied_subset(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA), 0.1).collect()
    u = V.unit(x.astype(float))
    mine = u[[r["key"] for r in got]]
    assert len({r["key"] for r in got}) == 300 and ((mine @ V.unit(base[None])[0]) > 0.9).sum() == 1
    cover = lambda p: np.sqrt(2 - 2 * (u @ p.T).max(1).min())
    exact = cover(u[K.farthest_first(u, 300)[0]])
    print(f"block {block}: covering radius {cover(mine):.3f}, exact farthest-first {exact:.3f}")
    assert cover(mine) < 1.2 * exact


def plain_peel(u, floor):
    live = np.arange(len(u))
    while (bad := (V.micro(u[live], u[live]) < floor).sum(1)).any():
        live = np.delete(live, np.argmax(bad))
    return live.tolist()


def test_peel_by_vectors_and_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    pairs, want = [], set()
    for comp in range(4):
        u = V.unit(rng.normal(size=(50, 6)) + 3 * rng.normal(size=6))
        left = plain_peel(u, 750_000)
        assert C.peel(u, 750_000).tolist() == left
        a, b = np.nonzero(np.triu(V.micro(u, u) < 750_000))
        assert set(C.peel_pairs(a, b).tolist()) == set(range(50)) - set(left)
        pairs += [(comp, 100 * comp + int(x), 100 * comp + int(y)) for x, y in zip(a, b)]
        want |= {100 * comp + x for x in set(range(50)) - set(left)}
    df = spark.createDataFrame(pairs, "comp bigint, a bigint, b bigint")
    for bound in (10, 4_000_000):
        monkeypatch.setattr(C, "MISS_PAIRS", bound)
        assert {r["key"] for r in C.misfits(df).collect()} == want


@pytest.mark.parametrize("group", [10, 40])
def test_a_stray_row_does_not_take_a_large_cluster_along(spark, monkeypatch, group):
    """30 rows similar to each other and one that is similar to them on the average only."""
    x = np.zeros((31, 128))
    x[:, 0] = 1
    x[:10, 1], x[10:20, 1], x[20:30, 1] = -0.2, 0.1, 0.2
    x[np.arange(30), np.arange(30) + 5] = 0.05
    x[30, 1] = 0.7
    x = V.unit(x)
    q = V.micro(x, x)
    assert (q[:30, :30] >= 750_000).all() and 5 < (q[30, :30] < 750_000).sum() < 20 and q[30, :30].mean() > 750_000
    df = spark.createDataFrame([(i + 1, [float(v) for v in r]) for i, r in enumerate(x)] + [(k + 1000, v) for k, v in noisy(0, 0, singles=400, seed=4)], SCHEMA)
    monkeypatch.setattr(V, "GROUP_ROWS", group)
    small = V.chunk_pairs
    monkeypatch.setattr(V, "chunk_pairs", lambda large: small(large, 16))
    got = C.similarity_clusters(df).collect()
    assert {(r["key"], r["cluster"], r["size"]) for r in got} == {(i, 1, 30) for i in range(1, 31)}
    mean = x[:30].sum(0)
    assert all(abs(r["typicality"] - x[r["key"] - 1] @ mean / np.linalg.norm(mean)) < 2e-6 for r in got)


def test_large_groups_are_linked_to_the_end(spark, monkeypatch):
    """Many small clusters in one linked group: their parts seldom meet by chance."""
    monkeypatch.setattr(V, "GROUP_ROWS", 2)
    rows = [(5 * g + i + 1, [1.0 if d == g else 0.01 * i if d == 100 else 0.0 for d in range(128)], 1, 60) for g in range(12) for i in range(5)]
    df = spark.createDataFrame(rows, "key bigint, vector array<float>, comp bigint, n bigint")
    got = {(r["key"], r["cluster"], r["size"]) for r in C._link_large(df, 128, 0.75).collect()}
    assert got == {(5 * g + i + 1, 5 * g + 1, 5) for g in range(12) for i in range(5)}


@pytest.mark.parametrize(("group", "link"), [(50, 30), (50, 65_536), (8_192, 65_536)])
def test_overlapping_groups_are_linked_alike_at_every_size(spark, monkeypatch, group, link):
    """One linked group whose clusters are not closed: rows along an arc, with copies."""
    rng = np.random.default_rng(21)
    at = np.sort(rng.uniform(0, 6, 220))
    x = np.zeros((220, 128))
    x[:, 0], x[:, 1] = np.cos(at), np.sin(at)
    x[:, 2:] = 0.05 * rng.normal(size=(220, 126)) / np.sqrt(126) * 11
    x[200:] = x[:20]
    x = np.float32(x)
    u = V.unit(x.astype(float))
    lab = C.link_rows(u, x.astype(float), 0.75)
    df = spark.createDataFrame([(i + 1, [float(v) for v in r], 1, 220) for i, r in enumerate(x)], "key bigint, vector array<float>, comp bigint, n bigint")
    small = V.chunk_pairs
    monkeypatch.setattr(V, "chunk_pairs", lambda large: small(large, 64))
    want = {}
    for c in np.unique(lab):
        m = np.flatnonzero(lab == c)
        m = m[C.peel(u[m], 750_000)]
        want |= {int(i) + 1: (int(m[0]) + 1, len(m)) for i in m}
    assert len({w for w, _ in want.values()}) > 4
    monkeypatch.setattr(V, "GROUP_ROWS", group)
    monkeypatch.setattr(C, "LINK_ROWS", link)
    got = {r["key"]: (r["cluster"], r["size"]) for r in C._link_large(df, 128, 0.75).collect()}
    assert got == want


def test_a_hot_group_of_copies_keeps_exact_neighbours(spark, monkeypatch):
    rows = noisy(1, 30, singles=20, seed=13)
    rows += [(4000 + i, rows[i % 2][1]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(V, "GROUP_ROWS", 10)
    small = V.chunk_pairs
    monkeypatch.setattr(V, "chunk_pairs", lambda large: small(large, 16))
    assert {tuple(r) for r in V.similar_neighbours(df).collect()} == brute(rows)[0]


def test_index_records_do_not_grow_with_the_rows(spark):
    """A row goes to the same number of cells at every row count, and pairs at the threshold meet as promised."""
    rng = np.random.default_rng(2)
    x = V.unit(rng.normal(size=(3_000, 128)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)

    class Many:  # the sample of a table that says it has n rows
        def __init__(self, n):
            self.n = n

        def count(self):
            return self.n

        def sample(self, share, seed):
            return df

    counts = set()
    for n in (20_000, 2_000_000, 40_000_000):
        ix = V.fit_index(Many(n), 128, 0.75, 0.95)
        counts.add(len(V._placed(ix, np.arange(100), ix.codes(x[:100]), ix.cells(x[:100]))) / 100)
        one, two = V._trial(x, 0.75, np.random.default_rng(9))
        a, b = ix.cells(one), ix.cells(two)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.93
        assert (np.bitwise_count(ix.codes(one) ^ ix.codes(two)).sum(1) <= ix.near).mean() > 0.99
    assert counts == {V.TABLES * V.PROBES}


def test_hot_cells_are_cut_into_pieces_without_losing_pairs():
    rng = np.random.default_rng(4)
    x = V.unit(rng.normal(size=(64, 128)))
    rot = np.linalg.qr(rng.normal(size=(128, 128)))[0].astype(np.float32)
    ix = V.Index(np.zeros(128), np.hstack([rot, rot]), tuple(np.stack([rot[:, :2]] * V.TABLES) for _ in range(2)), 12, 80)
    hot = V.replace(ix, pieces=((3, 5), (20, 3)))
    keys, words, cells = np.arange(64), ix.codes(x), ix.cells(x)

    def met(rec):
        return {(a, b) for bucket in np.unique(rec["bucket"]) for m in [np.sort(rec["key"][rec["bucket"] == bucket])] for i, a in enumerate(m.tolist()) for b in m.tolist()[i + 1 :]}

    assert met(V._placed(ix, keys, words, cells)) == met(V._placed(hot, keys, words, cells))
