"""Ward trees against joining the nearest pair over and over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import hierarchy as hy
from tests.test_clusters import frame


def brute_ward(v, stop):
    """Joins the cheapest pair until ``stop(clusters left, cost)``."""
    parts = [(1.0, x, [i]) for i, x in enumerate(v)]
    while len(parts) > 1:
        n, m = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        c = np.sqrt(2 * n[:, None] * n[None] / (n[:, None] + n[None])) * np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
        np.fill_diagonal(c, np.inf)
        i, j = sorted(divmod(int(c.argmin()), len(parts)))
        if stop(len(parts), c[i, j]):
            break
        a, b = parts[i], parts[j]
        parts[i] = (a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2])
        del parts[j]
    return {i: min(p[2]) for p in parts for i in p[2]}


def points(n=90, seed=3):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(c, 0.2, (n // 3, 3)) for c in ((0, 0, 1), (1, 1, 0), (2, 0, 0))])
    return np.concatenate([v, np.repeat(v[4:5], 6, axis=0), np.zeros((2, 3))])


@pytest.mark.parametrize("bound,rows", [(2048, 1024), (20, 16)])
def test_ward_equals_brute_force(spark, bound, rows):
    v = points()
    members, joins = hy.ward_tree(frame(spark, v), "g", "id", "vec", in_one_task=bound, rows=rows)
    for t in (0.4, 1.5, 50.0):
        got = {r.id: r.cluster for r in hy.tree_labels(members, joins.where(F.col("cost") <= t)).collect()}
        assert got == brute_ward(v, lambda k, c, t=t: c > t)
    got = {r.id: r.cluster for r in hy.ward_by_count(frame(spark, v), "g", "id", "vec", 4, in_one_task=bound, rows=rows).collect()}
    assert got == brute_ward(v, lambda k, c: k == 4)


def test_rounds_end_at_the_distance(spark):
    v = points()
    got = {r.id: r.cluster for r in hy.ward_by_distance(frame(spark, v), "g", "id", "vec", 0.4, in_one_task=1, rows=16).collect()}
    assert got == brute_ward(v, lambda k, c: c > 0.4)


def test_tree_has_every_join_at_its_cost(spark):
    v = points(60, 5)
    _, joins = hy.ward_tree(frame(spark, v), "g", "id", "vec", in_one_task=10, rows=16)
    rows = joins.collect()
    assert len(rows) == len(np.unique(v, axis=0)) - 1 and len({r.b for r in rows}) == len(rows)
    _, whole = hy.ward_tree(frame(spark, v), "g", "id", "vec")
    assert sorted(r.cost for r in rows) == pytest.approx(sorted(r.cost for r in whole.collect()))


def test_groups_do_not_meet(spark):
    a, b = points(60, 1), points(30, 2)
    df = frame(spark, a, "a").unionByName(frame(spark, b, "b").withColumn("id", F.col("id") + 1000))
    df = df.unionByName(spark.createDataFrame([("a", 5000, None), ("c", 6000, [1.0, 0.0, 0.0])], df.schema))
    rows = hy.ward_by_count(df, "g", "id", "vec", 3, in_one_task=40, rows=16).collect()
    assert {r.id: r.cluster for r in rows if r.g == "a"} == brute_ward(a, lambda k, c: k == 3)
    assert {r.id: r.cluster - 1000 for r in rows if r.g == "b"} == {i + 1000: c for i, c in brute_ward(b, lambda k, c: k == 3).items()}
    assert [(r.id, r.cluster) for r in rows if r.g == "c"] == [(6000, 6000)]
    assert hy.ward_by_count(df.limit(0), "g", "id", "vec", 3).count() == 0


def test_unit_length(spark):
    v = points(60, 7)[:-2]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {r.id: r.cluster for r in hy.ward_by_distance(frame(spark, v), "g", "id", "vec", 1.0, unit=True).collect()}
    assert got == brute_ward(u, lambda k, c: c > 1.0)
