"""Clustering against brute force, over several block sizes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import density as dn
from opinara.operators import features as ft
from opinara.operators import hierarchy as hy
from opinara.operators import masks as mk
from opinara.operators import neighbours as nb
from opinara.operators import partition as pt


def frame(spark, v, g="g"):
    return spark.createDataFrame([(g, i, [float(x) for x in row]) for i, row in enumerate(v)], "g string, id long, vec array<double>")


def brute_dbscan(d, eps, min_pts):
    near = d <= eps + 1e-9
    core = near.sum(axis=1) >= min_pts
    label = np.where(core, np.arange(len(d)), -1)
    changed = True
    while changed:
        changed = False
        for i, j in itertools.product(np.flatnonzero(core), repeat=2):
            if near[i, j] and label[j] < label[i]:
                label[i], changed = label[j], True
    for i in np.flatnonzero(~core):
        hit = label[near[i] & core]
        label[i] = hit.min() if len(hit) else -1
    return dict(enumerate(label))


@pytest.mark.parametrize("rows,bound", [(1000, 1_000_000), (16, 1_000_000), (16, 10)])
def test_dbscan_equals_brute_force(spark, rows, bound):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(c, 0.15, (30, 2)) for c in ((0, 0), (1, 1), (2, 0))] + [np.repeat([[3.0, 3.0]], 8, axis=0)])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    grid = dn.dbscan_grid(frame(spark, v), "g", "id", "vec", [0.1, 0.2], [3, 6, 9], "euclidean", rows, bound).collect()
    for e, m in itertools.product([0.1, 0.2], [3, 6, 9]):
        assert {r.id: r.label for r in grid if r.eps == e and r.min_pts == m} == brute_dbscan(d, e, m)


def brute_reach(v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    core = np.sort(d, axis=1)[:, k]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def test_spanning_tree_weight(spark):
    v = np.random.default_rng(5).normal(size=(60, 5))
    _, _, edges = dn.reach_edges(frame(spark, v), "g", "id", "vec", 3, rows=16)
    got = sorted((r.w, r.a, r.b) for r in edges.collect())
    w = brute_reach(v, 3)
    a, b = dn._spanning_tree(w)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0.0
    for x, i, j in got:
        if root(i) != root(j):
            parent[root(i)] = root(j)
            total += x
    assert total == pytest.approx(w[a, b].sum())


def brute_hdbscan(v, min_size, k, unit=True):
    """The condensed tree from the top: take the dearest edge of the spanning tree away, over and over."""
    w = brute_reach(v, k)
    np.fill_diagonal(w, np.inf)

    def tree(points):
        sub = w[np.ix_(points, points)].copy()
        np.fill_diagonal(sub, 0)
        a, b = dn._spanning_tree(sub)
        return [(sub[i, j], min(points[i], points[j]), max(points[i], points[j])) for i, j in zip(a, b)]

    def parts(points, edges):
        label = {p: p for p in points}
        for _, i, j in edges:
            x, y = label[i], label[j]
            for p in points:
                if label[p] == y:
                    label[p] = x
        return [[p for p in points if label[p] == x] for x in set(label.values())]

    def walk(points, birth):
        """(stability of the chosen clusters, the clusters) below a cluster born at ``birth``."""
        own, left, edges = 0.0, list(points), sorted(tree(points))
        while True:
            if len(left) == 1:  # only a single point of its own
                return own, [], own, points
            weight, _, _ = edges.pop()
            lam = 1 / max(weight, 1e-12)
            two = parts(left, edges)
            big = [p for p in two if len(p) >= min_size]
            own += sum(lam - birth for p in two if len(p) < min_size for _ in p)
            if len(big) == 2:
                own += len(left) * (lam - birth)
                below = [walk(p, lam) for p in big]
                best = sum(x[0] for x in below)
                kept = [c for x in below for c in x[1]]
                return (own, [points], own, points) if own >= best else (best, kept, own, points)
            if not big:
                return own, [points], own, points
            left = big[0]
            edges = [e for e in edges if e[1] in set(left)]

    label = dict.fromkeys(range(len(v)), -1)
    own, left, edges = 0.0, list(range(len(v))), sorted(tree(range(len(v))))
    while edges:  # the root is never chosen: go down to its first split
        weight, _, _ = edges.pop()
        two = [p for p in parts(left, edges) if len(p) >= min_size]
        if len(two) == 2:
            for c in [c for p in two for c in walk(p, 1 / max(weight, 1e-12))[1]]:
                for p in c:
                    label[p] = min(c)
            break
        if not two:
            break
        left = two[0]
        edges = [e for e in edges if e[1] in set(left)]
    return label


def grown(seed, spread=0.3):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(0, spread, (n, 3)) + c for n, c in ((25, (1, 0, 0)), (14, (0, 1, 0)), (9, (0, 0, 1)), (8, (1, 1, 0)))])
    return np.concatenate([v, np.repeat(v[3:4], 5, axis=0), np.repeat(v[30:31], 4, axis=0)])


@pytest.mark.parametrize("rows,run_edges", [(1024, 1_000_000), (16, 20)])
def test_hdbscan_equals_brute_force(spark, rows, run_edges):
    df, want = None, {}
    for g, (seed, spread) in enumerate([(1, 0.05), (2, 0.3), (3, 0.5), (4, 0.2)]):
        v = grown(seed, spread)
        part = frame(spark, v, f"g{g}").withColumn("id", F.col("id") + 1000 * g)
        df = part if df is None else df.unionByName(part)
        want |= {i + 1000 * g: c if c < 0 else c + 1000 * g for i, c in brute_hdbscan(v, 4, 3).items()}
    df = df.unionByName(frame(spark, np.eye(3)[:2], "few").withColumn("id", F.col("id") + 9000))
    got = {r.id: r.label for r in dn.hdbscan(df, "g", "id", "vec", 4, 3, rows=rows, run_edges=run_edges).collect()}
    assert got == want | {9000: -1, 9001: -1}
    assert len(set(want.values())) > 8


def test_hdbscan_finds_separate_groups(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.02, (12, 3)) + c for c in np.eye(3)])
    rows = dn.hdbscan(frame(spark, v), "g", "id", "vec", 3, 3).collect()
    label = {r.id: r.label for r in rows}
    found = [{label[i] for i in range(a, a + 12)} - {-1} for a in (0, 12, 24)]
    assert all(found) and not any(x & y for x, y in itertools.combinations(found, 2))
    assert dn.hdbscan(frame(spark, v).limit(0), "g", "id", "vec").count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([("k", i, i + 1) for i in range(40)] + [("k", 100, 100)], "k string, a long, b long")
    got = {r.node: r.label for r in nb.components(edges, ["k"]).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100}


def test_mean_distance_closed_form(spark):
    v = np.random.default_rng(2).normal(size=(20, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = [1 - u[i] @ u[j] for i, j in itertools.combinations(range(20), 2)]
    got = mk.mean_pair_distance(frame(spark, v), ["g"]).first().mean_distance
    assert got == pytest.approx(np.mean(pairs))


def test_mask_blocks_do_not_change_the_best(spark, monkeypatch):
    v = np.random.default_rng(4).normal(size=(40, 4))
    df = frame(spark, v)
    masks = df.where("id < 15").select(F.col("id").alias("mask_id"), F.concat(F.lit("m"), "id").alias("mask"), "vec")
    pick = lambda: {r.id: r.best.mask_id for r in mk.best_mask(df, "vec", masks).collect()}
    whole = pick()
    monkeypatch.setattr(mk, "BLOCK_BYTES", 4 * 8 * 4)
    assert pick() == whole


def brute_kmeans(v, k):
    """Farthest-first from the first row, then Lloyd until no label changes."""
    m = [v[0]]
    while len(m) < k:
        d = np.min([((v - c) ** 2).sum(axis=1) for c in m], axis=0)
        if d.max() <= 0:
            break
        m.append(v[d.argmax()])
    m, old = np.array(m), None
    while True:
        d = ((v[:, None] - m[None]) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        if old is not None and (label == old).all():
            return label, d.min(axis=1)
        old = label
        m = np.array([v[label == c].mean(axis=0) if (label == c).any() else m[c] for c in range(len(m))])


def test_kmeans_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(120, 3))
    repeated = np.concatenate([np.repeat([[0.0, 0.0, 0.0]], 300, axis=0), np.repeat(np.eye(3), 10, axis=0)])
    for v in (plain, repeated, repeated[:50]):
        label, d = brute_kmeans(v, 4)
        got = pt.kmeans_groups(frame(spark, v), "g", "id", "vec", 4).collect()
        assert {r.id: r.cluster for r in got} == dict(enumerate(label.tolist()))
        assert sum(r.d2 for r in got) == pytest.approx(d.sum())
    assert len({r.cluster for r in pt.kmeans_groups(frame(spark, repeated), "g", "id", "vec", 4).collect()}) == 4


def test_ward_parts_rare_rows_off_many_copies(spark):
    v = np.concatenate([np.repeat([[1.0, 0.0, 0.0]], 200, axis=0), [[0.0, 1.0, 0.0]] * 2])
    assert len({r.cluster for r in hy.ward_by_distance(frame(spark, v), "g", "id", "vec", 0.5, unit=True).collect()}) == 2
    nulls = frame(spark, v).unionByName(spark.createDataFrame([("g", 999, None)], "g string, id long, vec array<double>"))
    assert pt.kmeans_groups(nulls, "g", "id", "vec", 2).count() == len(v)


def test_masks_may_be_missing_and_vectors_null(spark):
    df = frame(spark, np.eye(3)).unionByName(spark.createDataFrame([("g", 9, None)], "g string, id long, vec array<double>"))
    none = df.limit(0).select(F.col("id").alias("mask_id"), F.lit("m").alias("mask"), "vec")
    assert {r.best for r in mk.best_mask(df, "vec", none).collect()} == {None}
    assert {len(r.sims) for r in mk.mask_similarities(df, "vec", none).collect()} == {0}
    one = df.where("id = 0").select(F.col("id").alias("mask_id"), F.lit("m").alias("mask"), "vec")
    yes, no = mk.split_by_mask(df, "vec", one, 0.5)
    assert {r.id for r in yes.collect()} == {0} and {r.id for r in no.collect()} == {1, 2, 9}


def test_ward_parts_separate_groups(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 0.02, (10, 3)) + c for c in np.eye(3)])
    got = {r.id: r.cluster for r in hy.ward_by_distance(frame(spark, v), "g", "id", "vec", 1.0, unit=True).collect()}
    assert len(set(got.values())) == 3
    assert all(len({got[i] for i in range(a, a + 10)}) == 1 for a in (0, 10, 20))


def test_map_error_falls(spark):
    v = np.random.default_rng(9).random((60, 4))
    _, errors = pt.train_map(frame(spark, v), "id", "vec", 6, 6, epochs=4)
    assert errors[-1] < errors[0]


def test_review_clusters_read_every_sentence(spark):
    from types import SimpleNamespace

    from opinara.plans.q_clusters import sentence_table

    vectors = spark.createDataFrame([(i, 7, [1.0, 0.0]) for i in (0, 1, 5_000_000_000)], "id long, product int, vec array<double>")
    said = [(i, p, f"good screen and {w} sound {i % 7}-{p}", 5, "en") for i in (0, 1, 5_000_000_000) for p, w in enumerate(("loud", "clear", "loud"))]
    t = SimpleNamespace(vectors=vectors, sentences=spark.createDataFrame(said, "id long, spos int, sentence string, rating int, category string"))
    got = sentence_table(t, least=2).collect()
    assert sorted(r.sentence for r in got) == sorted(s for _, _, s, _, _ in said) and len({r.id for r in got}) == 9
    by = {r.sentence: r.vec for r in got}
    assert len({tuple(np.round(v, 6)) for v in by.values()}) > 3  # sentences of a text have their own vectors


def test_copies_are_pairs_too(spark):
    v = np.concatenate([np.eye(3), np.eye(3)[:2], np.eye(3)[:1], [[1.0, 0.3, 0.0]]])
    pairs, members = nb.close_pairs(frame(spark, v), "g", "id", "vec", 0.1)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j): round(1 - float(u[i] @ u[j]), 9) for i in range(7) for j in range(i + 1, 7) if 1 - u[i] @ u[j] <= 0.1}
    assert {(r.a, r.b): abs(round(r.dist, 9)) for r in nb.with_copies(pairs, members).collect()} == want
    assert {(r.rep, r.id) for r in members.collect()} == {(0, 0), (0, 3), (0, 5), (1, 1), (1, 4), (2, 2), (6, 6)}


def test_silhouettes_meet_every_vector_once(spark, monkeypatch):
    """Sixty copies of each row: as many points in the blocks as there are vectors of a cluster,
    the same values as by brute force, and nothing lost where blocks are many."""
    rng = np.random.default_rng(8)
    v = np.repeat(np.round(rng.normal(size=(25, 2)), 1), 60, axis=0)
    c = np.repeat(np.arange(25) % 3, 60)
    df = spark.createDataFrame([(i, [float(x) for x in r], int(k)) for i, (r, k) in enumerate(zip(v, c))], "id long, v array<double>, c long")
    seen, in_blocks = [], nb.in_blocks
    monkeypatch.setattr(nb, "in_blocks", lambda points, rows: seen.append(points.count()) or in_blocks(points, rows))
    got = {r.id: r.silhouette for r in ft.silhouettes(df, "id", "v", "c", rows=7).collect()}
    assert seen == [len({(*r, k) for r, k in zip(v.tolist(), c.tolist())})]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for i in range(0, len(v), 60):
        a = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i][c == k].mean() for k in range(3) if k != c[i])
        for j in range(i, i + 60):
            assert got[j] == pytest.approx((b - a) / max(a, b))
    assert len(got) == len(v)


@pytest.mark.parametrize("rows", [1024, 4])
def test_silhouettes_with_null_components_and_clusters(spark, rows):
    """An unknown distance is left out of a sum, as in SQL, wherever the blocks are cut; the rows stay."""
    at = [(0, 0.0, 0), (1, 1.0, 0), (2, None, 0), (3, 5.0, 1), (4, 6.0, 1), (5, None, None), (6, 2.0, None)] + [(i, float(i), 1) for i in range(7, 15)]
    df = spark.createDataFrame([(i, [x, 0.0], k) for i, x, k in at], "id long, v array<double>, c long")
    got = {r.id: r.silhouette for r in ft.silhouettes(df, "id", "v", "c", rows=rows).collect()}
    side = {k: [x for _, x, c in at if c == k] for k in (0, 1)}
    mean = lambda x, k, n: sum(abs(x - y) for y in side[k] if y is not None) / n
    for i, x, k in at:
        a, b = (0, 0) if x is None or k is None else (mean(x, k, len(side[k]) - 1), mean(x, 1 - k, len(side[1 - k])))
        assert got[i] == pytest.approx((b - a) / max(a, b) if max(a, b) else 0.0)


def test_block_pairs_keep_their_tasks(spark):
    """A few kilobytes of points are much work, so they are not put into one task."""
    v = np.random.default_rng(2).normal(size=(300, 2))
    blocked = nb.in_blocks(frame(spark, v).withColumnRenamed("vec", "v"), 20)
    task = nb.block_pairs(blocked, None, lambda x, y: __import__("pandas").DataFrame({"n": [__import__("pyspark").TaskContext.get().partitionId()]}), "n int")
    assert task.distinct().count() > 4


def test_a_task_holds_bands_of_blocks(spark):
    """Sixty blocks and more make eight bands, so a row is sent eight times; every pair of points meets once."""
    import pandas as pd

    v = np.random.default_rng(2).normal(size=(300, 2))
    blocked = nb.in_blocks(frame(spark, v).withColumnRenamed("vec", "v"), 5)
    assert blocked.select("block").distinct().count() > 50
    met = lambda x, y: pd.DataFrame({"g": ["g"], "n": [len(x) * (len(x) - 1) // 2 if y is None else len(x) * len(y)]})
    total = lambda f: f.groupby("g", as_index=False).sum()
    cells = nb.block_pairs(blocked, None, met, "g string, n long", merge=total).collect()
    assert len(cells) <= 36 and sum(r.n for r in cells) == 300 * 299 // 2


def test_forests_of_a_task_are_one_forest():
    import pandas as pd

    rng = np.random.default_rng(5)
    links = pd.DataFrame([("g", 0, -1, *sorted(rng.choice(40, 2, replace=False).tolist()), float(rng.integers(1, 6))) for _ in range(200)], columns=["g", "e", "m", "a", "b", "w"])
    touch = pd.DataFrame([("g", 0, 3, 7, 8, 0.0)] * 2, columns=links.columns)
    got = dn._thinned(pd.concat([links, touch]))
    assert (got["m"] >= 0).sum() == 1 and (got["m"] < 0).sum() <= 39
    for m in range(1, 6):
        labels = []
        for f in (links, got[got["m"] < 0]):
            forest = dn.Forest(40)
            for a, b in f.loc[f["w"] >= m, ["a", "b"]].to_numpy().tolist():
                forest.join(a, b)
            labels.append(forest.labels().tolist())
        assert labels[0] == labels[1]


def test_grid_sizes_equal_the_rows_of_every_cell(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(c, 0.15, (40, 2)) for c in ((0, 0), (1, 1))] + [np.repeat([[3.0, 3.0]], 9, axis=0), [[9.0, 9.0]]])
    eps, least = [0.05, 0.1, 0.3], [2, 3, 5, 8, 12]
    labels = dn.dbscan_grid(frame(spark, v), "g", "id", "vec", eps, least, "euclidean", 16)
    wanted = {(r.eps, r.min_pts, r.label): r["count"] for r in labels.groupBy("eps", "min_pts", "label").count().collect()}
    sizes = dn.grid_sizes(frame(spark, v), "g", "id", "vec", eps, least, "euclidean", rows=16)
    assert {(r.eps, r.min_pts, r.label): r.n for r in sizes.collect()} == wanted
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for e, m in itertools.product(eps, least):
        assert {r.id: r.label for r in labels.where((F.col("eps") == e) & (F.col("min_pts") == m)).collect()} == brute_dbscan(d, e, m)


def test_points_in_at_every_step_are_joined_at_once():
    """Two clumps of 300 and a thin bridge: forest edges of dense points without a walk over them."""
    v = np.concatenate([np.random.default_rng(1).normal(c, 0.05, (300, 1)) for c in (0, 2)] + [np.linspace(0.2, 1.8, 12)[:, None]])
    d = np.abs(v - v.T)
    near = d <= 0.16
    n = near.sum(axis=1).astype(float)
    a, b, w = dn._core_forest(near, n, 2, 49)
    assert w.max() == 49 and (w == 49).sum() >= 590
    for m in (2, 3, 5, 49):
        forest = dn.Forest(len(v))
        for x, y in zip(a[w >= m].tolist(), b[w >= m].tolist()):
            forest.join(x, y)
        on, label = n >= m, forest.labels()
        ids = brute_dbscan(np.where(on[:, None] & on[None], d, 9.0), 0.16, 1)
        assert all(label[i] == ids[i] for i in np.flatnonzero(on))
