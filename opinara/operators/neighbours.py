"""Close pairs of vectors inside groups, without forming all pairs.

Points of a group are cut into blocks of bounded size along one direction; the
gap between two blocks on that direction is a lower bound of the distance, so
block pairs further apart than the radius are never joined.  A task sees two
blocks, works on them as matrices, and emits only what the caller needs: counts,
pairs inside the radius, or a spanning forest.  A hot group becomes many block
pairs, and equal vectors are one weighted point from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opinara.functions import vectors as vx
from opinara.session import cut, many_tasks

TOLERANCE = 1e-9
STRIPES = 64
BLOCK_ROWS = 1024
BANDS = 8
BAND_ROWS = 65_536  # of a band, so that a task's two bands fit its memory


def distinct_points(df: DataFrame, group: str, key: str, vec: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """(points g, id, w, v) and (members g, rep, id): equal vectors become one point
    named by its smallest id.  Zero vectors have no cosine and stay out of both."""
    v = vx.as_double(F.col(vec))
    if metric == "cosine":
        v = vx.normalise(v)
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("id"), v.alias("v"))
    if metric == "cosine":
        rows = rows.where(F.exists("v", lambda x: x != 0))
    points = cut(rows.groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("w")))
    # the vector's hash names it: joining on 16 bytes instead of the whole array
    name = lambda d: d.withColumn("h", F.xxhash64("v"))
    copies = name(points.where("w > 1")).select("g", "h", F.col("v").alias("pv"), F.col("id").alias("rep"))
    extra = name(rows).join(copies, ["g", "h"]).where(F.col("v") == F.col("pv")).select("g", "rep", "id")
    single = points.where("w = 1").select("g", F.col("id").alias("rep"), "id")
    return points, single.unionByName(extra)


def in_blocks(points: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Points with ``block`` and the projection ``k`` it was cut along."""
    dim = F.size("v")
    k = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.sqrt(dim)
    df = points.withColumn("k", k)
    cuts = F.percentile_approx("k", [i / STRIPES for i in range(1, STRIPES)], 10000)
    sizes = df.groupBy("g").agg(F.ceil(F.count("*") / rows).alias("nb"), cuts.alias("cuts"))
    fine = F.size(F.filter("cuts", lambda c: c < F.col("k")))
    stripe = F.when(F.col("nb") <= 1, 0).otherwise(F.floor(fine * F.least("nb", F.lit(STRIPES)) / STRIPES))
    df = df.join(sizes, "g").withColumn("stripe", stripe.cast("long")).drop("cuts", "nb")
    parts = df.groupBy("g", "stripe").agg(F.ceil(F.count("*") / rows).alias("parts"))
    sub = F.pmod(F.xxhash64("id"), F.col("parts"))
    return cut(df.join(parts, ["g", "stripe"]).withColumn("block", F.col("stripe") * 1_000_000 + sub).drop("stripe", "parts"))


def block_pairs(blocked: DataFrame, radius: float | None, fn: Callable, schema: str, wanted: str | None = None,
                merge: Callable | None = None) -> DataFrame:
    """Run ``fn(left, right)`` on every pair of blocks closer than ``radius``; with
    ``wanted``, a boolean column, only on pairs of which a block holds such a row.

    ``right`` is ``None`` for a block with itself; both are pandas frames.  Blocks that follow
    one another make up to ``BANDS`` bands a group, and a task holds two bands: a row is sent
    once for every band it meets, not for every block.  ``merge`` makes one frame of those
    that several pairs of a task have given, laid end to end."""
    asks = F.lit(True) if wanted is None else F.max(wanted)
    span = blocked.groupBy("g", "block").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), asks.alias("asks"), F.count("*").alias("n"))
    group = W.partitionBy("g")
    wide = F.least(F.ceil(F.count("*").over(group) / BANDS), F.greatest(F.floor(BAND_ROWS / F.max("n").over(group)), F.lit(1)))
    span = cut(span.withColumn("band", F.floor((F.row_number().over(group.orderBy("block")) - 1) / wide)))
    a = span.select("g", F.col("block").alias("bi"), F.col("band").alias("ci"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("asks").alias("asks1"))
    b = span.select("g", F.col("block").alias("bj"), F.col("band").alias("cj"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("asks").alias("asks2"))
    pairs = a.join(b, "g").where("bi <= bj AND (asks1 OR asks2)")
    if radius is not None:
        r = F.lit(radius + TOLERANCE)
        pairs = pairs.where((F.col("lo2") - F.col("hi1") <= r) & (F.col("lo1") - F.col("hi2") <= r))
    ends = F.array(F.struct(F.col("bi").alias("block"), F.lit(0).alias("side"), F.col("lo1").alias("lo"), F.col("hi1").alias("hi"), F.col("asks1").alias("asks")),
                   F.struct(F.col("bj").alias("block"), (F.col("ci") < F.col("cj")).cast("int").alias("side"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("asks2").alias("asks")))
    places = cut(pairs.select("g", "ci", "cj", F.explode(ends).alias("x")).select("g", "ci", "cj", "x.*").distinct())
    both = blocked.join(places, ["g", "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = pd.concat(batches).sort_values("id")
        blocks = [(f, *f[["block", "side", "lo", "hi", "asks"]].iloc[0]) for _, f in cell.groupby("block")]
        across, held = cell["side"].any(), None
        for x, bi, side, lo1, hi1, asks1 in blocks:
            if side:
                continue
            out = [] if held is None else [held]
            for y, bj, other, lo2, hi2, asks2 in blocks:
                near = radius is None or (lo2 - hi1 <= radius + TOLERANCE and lo1 - hi2 <= radius + TOLERANCE)
                if other == across and bi <= bj and (asks1 or asks2) and near:
                    found = fn(x, None if bi == bj else y)
                    if merge is None:
                        yield found
                    else:
                        out.append(found)
            if out:
                held = merge(pd.concat(out))
        if held is not None:
            yield held

    # few bytes but much work: left to its size, the shuffle would be put together into very few tasks
    return both.repartition(many_tasks(blocked), "g", "ci", "cj").groupBy("g", "ci", "cj").applyInPandas(run, schema)


def matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - a @ b.T
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d, None] - b[None, :, d]) ** 2
    return np.sqrt(out)


def search_radius(eps: float, metric: str) -> float:
    """Euclidean radius of a cosine distance between unit vectors."""
    return float(np.sqrt(2 * min(eps, 2.0))) if metric == "cosine" else float(eps)


def close_pairs(df: DataFrame, group: str, key: str, vec: str, eps: float, metric: str = "cosine",
                rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs g, a, b, dist; members g, rep, id): distinct points (a < b) no further apart
    than ``eps``, and the rows of each point, so that pairs of equal vectors and of their
    copies are known without being written out (:func:`with_copies` does that)."""
    points, members = distinct_points(df, group, key, vec, metric)

    def near(x, y):
        same = y is None
        y = x if same else y
        d = distances(matrix(x), matrix(y), metric)
        hit = d <= eps + TOLERANCE
        if same:
            hit &= np.triu(np.ones_like(hit), 1)
        i, j = np.nonzero(hit)
        ia, jb = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        return pd.DataFrame({"g": x["g"].iloc[0], "a": np.minimum(ia, jb), "b": np.maximum(ia, jb), "dist": d[i, j]})

    return block_pairs(in_blocks(points, rows), search_radius(eps, metric), near, "g string, a long, b long, dist double"), members


def with_copies(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """g, a, b, dist of all rows (a < b): every copy in the place of its point, and the
    copies of one point at distance 0.  As many rows as there are pairs of copies."""
    side = lambda name: members.select("g", F.col("rep").alias(name), F.col("id").alias(f"{name}_id"))
    across = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).select("g", "a_id", "b_id", "dist")
    several = members.groupBy("g", "rep").agg(F.count("*").alias("n")).where("n > 1").select("g", "rep")
    held = members.join(several, ["g", "rep"], "left_semi")
    alike = held.select("g", "rep", F.col("id").alias("a_id")).join(held.select("g", "rep", F.col("id").alias("b_id")), ["g", "rep"]).where("a_id < b_id")
    rows = across.unionByName(alike.select("g", "a_id", "b_id", F.lit(0.0).alias("dist")))
    return rows.select("g", F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "dist")


def components(edges: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """keys, node, label: label is the smallest node of the connected component.

    ``edges`` holds keys, a, b; a node without a neighbour comes as an edge to
    itself.  Every round takes the neighbours' smallest label and then the label's
    label, so the number of rounds grows with the logarithm of the path length.
    """
    edges = cut(edges.select(*keys, "a", "b").distinct())
    links = edges.where("a <> b")
    links = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(nodes.groupBy(*keys, F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    for _ in range(rounds):
        far = links.join(label.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(
            *keys, F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        low = label.join(far, [*keys, "node"], "left").select(
            *keys, "node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = low.select(*keys, F.col("node").alias("label"), F.col("label").alias("next"))
        moved = cut(low.join(jump, [*keys, "label"]).select(
            *keys, "node", "old", F.least("label", "next").alias("label")))
        label = moved.select(*keys, "node", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return label
    raise RuntimeError("components did not settle; raise rounds")


def group_key(*cols: Column) -> Column:
    return F.concat_ws("\u0001", *[c.cast("string") for c in cols])
