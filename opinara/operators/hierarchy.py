"""Agglomerative clustering of many groups with Ward's criterion.

The cost of joining two clusters is sqrt(2 a b / (a + b)) times the distance of their
means, a and b being their sizes, so a cluster is fully described by its size and mean.
Clusters that are each other's nearest can be joined at once, in any order: no join makes
two clusters closer than they were (the criterion is reducible), so the tree is the one
that joining the single nearest pair over and over gives, up to ties.

A group of few clusters is finished in one task.  A larger one goes through rounds: block
pairs report each cluster's nearest other, mutual pairs are joined, and only clusters that
were joined or have lost their nearest search again.  The tree is stored as one row for
every join: cluster ``b`` goes into ``a`` at ``cost``, clusters being named by their
smallest row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opinara.functions import vectors as vx
from opinara.operators import neighbours as nb
from opinara.session import cut

IN_ONE_TASK = 2048
MERGE = "g string, a long, b long, cost double"


def ward_costs(n1: np.ndarray, v1: np.ndarray, n2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """Cost of joining each cluster of the first list with each of the second."""
    d2 = np.maximum(0.0, (v1**2).sum(axis=1)[:, None] + (v2**2).sum(axis=1)[None, :] - 2 * v1 @ v2.T)
    return np.sqrt(2 * n1[:, None] * n2[None, :] / (n1[:, None] + n2[None, :]) * d2)


def nearest_chain(ids: np.ndarray, n: np.ndarray, v: np.ndarray) -> list[tuple[int, int, float]]:
    """All joins of one list of clusters: follow nearest neighbours until two clusters
    are each other's nearest, join them, go on from the one before."""
    size, names = n.astype(float).copy(), ids.copy()
    d2 = ward_costs(size, v, size, v) ** 2
    np.fill_diagonal(d2, np.inf)
    alive, out, chain = np.ones(len(ids), bool), [], []
    for _ in range(len(ids) - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            j = int(d2[i].argmin())
            if len(chain) > 1 and d2[i, chain[-2]] <= d2[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        low, high = sorted((i, j), key=lambda x: names[x])
        cost = float(d2[i, j])
        out.append((int(names[low]), int(names[high]), float(np.sqrt(cost))))
        total = size[i] + size[j] + size
        row = ((size[i] + size) * d2[i] + (size[j] + size) * d2[j] - size * cost) / total
        row[~alive] = np.inf
        row[[low, high]] = np.inf
        d2[low], d2[:, low] = row, row
        d2[high], d2[:, high] = np.inf, np.inf
        alive[high] = False
        size[low] += size[high]
    return out


def _finish(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("id")
    joins = nearest_chain(f["id"].to_numpy(), f["w"].to_numpy(), nb.matrix(f))
    return pd.DataFrame([(f["g"].iloc[0], *j) for j in joins], columns=["g", "a", "b", "cost"])


def _nearest(x: pd.DataFrame, y: pd.DataFrame | None, most: float | None) -> pd.DataFrame:
    """For every searching cluster of either block the nearest of the other (the smallest
    name on a tie)."""
    other = x if y is None else y
    c = ward_costs(x["w"].to_numpy(), nb.matrix(x), other["w"].to_numpy(), nb.matrix(other))
    if y is None:
        np.fill_diagonal(c, np.inf)
    out = []
    for a, b, m in [(x, other, c)] if y is None else [(x, y, c), (y, x, c.T)]:
        rows = np.flatnonzero(a["search"].to_numpy())
        if len(rows) and m.shape[1]:
            at = m[rows].argmin(axis=1)
            cost = m[rows, at]
            ok = np.isfinite(cost) if most is None else cost <= most
            out.append(pd.DataFrame({"g": a["g"].iloc[0], "id": a["id"].to_numpy()[rows][ok], "cost": cost[ok], "to": b["id"].to_numpy()[at][ok]}))
    return pd.concat(out) if out else pd.DataFrame({"g": [], "id": [], "cost": [], "to": []}).astype({"g": str, "id": "int64", "cost": float, "to": "int64"})


def _least(f: pd.DataFrame) -> pd.DataFrame:
    return f.sort_values(["cost", "to"]).drop_duplicates("id")


def _round(state: DataFrame, most: float | None, rows: int) -> tuple[DataFrame, DataFrame]:
    """(joins, clusters afterwards) of one round.  ``state``: g, id, w, v, cost, to; the
    last two null where the cluster has to search."""
    blocked = nb.in_blocks(state.withColumn("search", F.col("to").isNull()), rows)
    found = nb.block_pairs(blocked, most, lambda x, y: _nearest(x, y, most), "g string, id long, cost double, to long", "search", _least)
    best = found.groupBy("g", "id").agg(F.min(F.struct("cost", "to")).alias("b")).select("g", "id", "b.*")
    kept = state.where(F.col("to").isNotNull()).select("g", "id", "cost", "to")
    near = cut(best.unionByName(kept))
    back = near.select("g", F.col("id").alias("to"), F.col("to").alias("back"))
    joins = cut(near.join(back, ["g", "to"]).where((F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))).select(
        "g", F.col("id").alias("a"), F.col("to").alias("b"), "cost"))
    moved = joins.select("g", F.col("b").alias("id"), F.col("a").alias("into")).unionByName(joins.select("g", F.col("a").alias("id"), F.col("a").alias("into")))
    weighted = F.transform("v", lambda x: x * F.col("w"))
    parts = state.select("g", "id", F.col("w").alias("n"), weighted.alias("part")).join(moved, ["g", "id"])
    joined = parts.groupBy("g", F.col("into").alias("id")).agg(F.sum("n").alias("w"), vx.sum_vector(F.col("part")).alias("s"))
    joined = joined.select("g", "id", "w", F.transform("s", lambda x: x / F.col("w")).alias("v"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("long").alias("to"))
    gone = moved.select("g", F.col("id").alias("to"), F.lit(True).alias("lost"))
    left = state.select("g", "id", "w", "v").join(moved, ["g", "id"], "left_anti").join(near, ["g", "id"], "left").join(gone, ["g", "to"], "left")
    keep = F.col("lost").isNull()
    left = left.select("g", "id", "w", "v", F.when(keep, F.col("cost")).alias("cost"), F.when(keep, F.col("to")).alias("to"))
    return joins, cut(joined.unionByName(left))


def ward_tree(df: DataFrame, group: str, key: str, vec: str, unit: bool = False, most: float | None = None,
              in_one_task: int = IN_ONE_TASK, rows: int = nb.BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members g, rep, id; joins g, a, b, cost): the tree of every group over its distinct
    vectors, of unit length if ``unit``; equal ones are one cluster from the start.

    With ``most`` the joins of larger groups end at that cost, which also spares block
    pairs further apart.  Rows with a null vector take no part.
    """
    v = vx.normalise(F.col(vec)) if unit else F.col(vec)
    points, members = nb.distinct_points(df.where(F.col(vec).isNotNull()).withColumn("__v", v), group, key, "__v", "euclidean")
    none = (F.lit(None).cast("double").alias("cost"), F.lit(None).cast("long").alias("to"))
    state, trees = points.select("g", "id", "w", "v", *none), []
    while True:
        large = cut(state.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > in_one_task).select("g"))
        trees.append(cut(state.join(large, "g", "left_anti").groupBy("g").applyInPandas(_finish, MERGE)))
        state = state.join(large, "g", "left_semi")
        if large.isEmpty():
            break
        joins, state = _round(state, most, rows)
        if joins.isEmpty():  # nothing left within ``most``
            break
        trees.append(joins)
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return members, out


def roots(joins: DataFrame) -> DataFrame:
    """g, rep, root of every cluster that went into another: a cluster goes into one other
    only, so its path is followed by doubling."""
    at = cut(joins.select("g", F.col("b").alias("rep"), F.col("a").alias("root")))
    while True:
        hop = at.select("g", F.col("rep").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(hop, ["g", "root"], "left").select("g", "rep", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("g", "rep", "root")
        if step.where("moved").isEmpty():
            return at


def tree_labels(members: DataFrame, joins: DataFrame) -> DataFrame:
    return members.join(roots(joins), ["g", "rep"], "left").select("g", "id", F.coalesce("root", "rep").alias("cluster"))


def ward_by_distance(df: DataFrame, group: str, key: str, vec: str, max_distance: float, unit: bool = False, **how) -> DataFrame:
    """g, id, cluster: the clusters left when no join costs ``max_distance`` or less; named by
    their smallest id."""
    members, joins = ward_tree(df, group, key, vec, unit, max_distance, **how)
    return tree_labels(members, joins.where(F.col("cost") <= max_distance))


def ward_by_count(df: DataFrame, group: str, key: str, vec: str, clusters: int, unit: bool = False, **how) -> DataFrame:
    """g, id, cluster: every group cut into ``clusters`` (as many as distinct vectors, if
    fewer) by leaving out its dearest joins."""
    members, joins = ward_tree(df, group, key, vec, unit, **how)
    dear = joins.withColumn("rk", F.row_number().over(W.partitionBy("g").orderBy(F.desc("cost"), F.desc("b")))).where(F.col("rk") < clusters)
    return tree_labels(members, joins.join(dear.select("g", "b"), ["g", "b"], "left_anti"))
