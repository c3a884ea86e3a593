"""Vector operators against brute force, with edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import hnsw, topk

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def table(spark, x, extra=()):
    rows = [(i, [float(np.float32(v)) for v in r], i % 3, "n") for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


EDGE = [(9001, None, 1, "n"), (9002, [1.0, None, 0.0, 0.0], 1, "n"), (9003, [float("nan")] * 4, 1, "n"), (9004, [0.0] * 4, 1, "n"),
        (9005, [1.0], 1, "n"), (9006, [], 1, "n"), (None, [1.0, 1.0, 1.0, 1.0], 1, "n"), (9008, [float("inf"), 1.0, 1.0, 1.0], 1, "n")]


@pytest.mark.parametrize("cell", [16, 4096])
def test_top_k_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", cell)
    monkeypatch.setattr(topk, "GROUP_ROWS", 7)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(150, 4)), np.repeat(rng.normal(size=(1, 4)), 80, axis=0), rng.normal(size=(40, 4)) * 0.05 + 1])
    df = table(spark, x, EDGE)
    got = topk.top_k(df, "vec_id", "embedding", F.col("key") % 20 == 0, 20, lambda v: np.floor(64 * v)).collect()
    whole = np.vstack([np.floor(64 * x.astype(np.float32).astype(float)), np.zeros((1, 4))])
    ids = np.array([*range(len(x)), 9004])  # the zero vector takes part
    want = []
    for i in range(0, len(x), 20):
        s = (whole @ whole[i]).astype(int)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        want += [(i, r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert sorted(map(tuple, got)) == want


def test_top_k_of_few_or_no_rows(spark):
    few = table(spark, np.eye(4)[:3])
    got = topk.top_k(few, "vec_id", "embedding", F.col("key") % 2 == 0, 5).collect()
    assert sorted((r.query, r.rank, r.key) for r in got) == [(0, 1, 1), (0, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert topk.top_k(few.limit(0), "vec_id", "embedding", F.lit(True), 5).count() == 0
    big = spark.createDataFrame([(1, [2.0 ** 30, 3.0]), (2, [2.0 ** 30, 1.0])], "vec_id long, embedding array<double>")
    assert {r.score for r in topk.top_k(big, "vec_id", "embedding", F.lit(True), 5).collect()} == {2 ** 60 + 3}


def brute_links(x, ok):
    n = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    near = (n @ n.T >= 0.95) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.where(near.any(axis=1), np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1)), label)
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.mark.parametrize("rows", [(64, 50), (16_384, 4_096)])
def test_near_vectors_equal_brute_force(spark, rows):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    x = np.vstack([rng.normal(size=(200, 16)), *[c + rng.normal(size=(n, 16)) * 0.12 for c, n in zip(centre, [90, 40] + [4] * 10)]])
    x = np.vstack([x, np.repeat(x[5:6], 30, axis=0), np.zeros((1, 16))]).astype(np.float32).astype(float)
    ok = (x != 0).any(axis=1)
    links, label = brute_links(x, ok)
    wide = [(i, v if v is None else (v * 4)[:16] if len(v) == 4 else v, l, n) for i, v, l, n in EDGE if i != 9004]
    wide = [w for w in wide if w[0] is not None]
    got = {r.vec_id: r for r in hnsw.near_vectors(table(spark, x, wide), "vec_id", "embedding", shard_rows=rows[0], block_rows=rows[1]).collect()}
    assert len(got) == len(x) + len(wide)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert found.sum() >= 0.99 * links.sum() and (found <= links).all()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[w[0]].n_links == 0 and got[w[0]].component_id == w[0] and got[w[0]].kept for w in wide)


def test_near_vectors_of_no_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, "n"), (4, [1.0, 0.0], 1, "n")], SCHEMA)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df, "vec_id", "embedding").collect()} == {
        (None, 0, None, False), (4, 0, 4, True)}
    assert hnsw.near_vectors(df.limit(0), "vec_id", "embedding").count() == 0
