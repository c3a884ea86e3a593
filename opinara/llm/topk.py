"""Exact top-k inner products over a pivot-distance index.

Every row is keyed by its nearest pivot and its distance to it; the rows of a pivot
are cut into annuli by distance, and large annuli into parts.  A query first searches
the part in which it lies itself.  Its k-th score there is a radius, and it goes on
only to annuli which the triangle inequality lets reach into that radius.  Inside a
part the rows are sorted by distance and only the window that can still count is scored.

Inner products become distances by one more component: a row gets the root of what its
squared norm lacks to the largest one, a query gets 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.shared import written
from opinara.llm.vectors import matrix, packed

CELL_ROWS = 4096
GROUP_ROWS = 2048
SAMPLE = 2048
MAX_PIVOTS, MAX_ANNULI = 64, 16
SLACK = 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles while every sum is exact in them, else Python integers."""
    if q.size == 0 or x.size == 0 or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0 ** 53:
        return q @ x.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(x).T


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first rows of the sample, beginning with its first row."""
    picks, far = [0], np.full(len(x), np.inf)
    while len(picks) < min(count, len(x)):
        far = np.minimum(far, ((x - x[picks[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        picks.append(int(far.argmax()))
    return x[picks]


class Directory:
    """Pivots and annuli: bounded by MAX_PIVOTS * MAX_ANNULI entries, whatever the table."""

    def __init__(self, pivots: np.ndarray, norm2: float):
        self.pivots, self.norm2 = pivots, norm2  # pivots with the extra component

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(axis=1)))[:, None]])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = self.lifted(x)
        d2 = (y * y).sum(axis=1)[:, None] + (self.pivots ** 2).sum(axis=1) - 2 * y @ self.pivots.T
        p = d2.argmin(axis=1)
        return p, np.sqrt(np.maximum(0.0, d2[np.arange(len(x)), p]))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        d2 = (q * q).sum(axis=1)[:, None] + (self.pivots ** 2).sum(axis=1) - 2 * q @ self.pivots[:, :-1].T
        return np.sqrt(np.maximum(0.0, d2))

    def radius(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The distance within which rows of a score of ``floor`` or more lie."""
        r2 = (q * q).sum(axis=1) + self.norm2 - 2 * floor
        return np.sqrt(np.maximum(0.0, r2)) * (1 + SLACK) + SLACK * np.sqrt(1 + self.norm2)


def _closest(keys, x, qkeys, q, floor, r, far, directory: Directory, k: int):
    """Top k of one part for a block of queries; its rows are sorted by ``r``."""
    reach = directory.radius(q, floor)
    lo, hi = np.searchsorted(r, (far - reach).min(), "left"), np.searchsorted(r, (far + reach).max(), "right")
    keys, x = keys[lo:hi], x[lo:hi]
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = []
    for at in range(0, len(q), 256):
        s = products(q[at:at + 256], x)
        own = qkeys[at:at + 256, None] == keys[None, :]
        f = floor[at:at + 256]
        masked = np.where(own, -np.inf, s.astype(float))
        if masked.shape[1] > k:
            f = np.maximum(f, np.partition(masked, -k, axis=1)[:, -k])
        i, j = np.nonzero((masked >= f[:, None]) & ~own)
        order = np.lexsort((keys[j], -masked[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[rank < k], j[rank < k]
        out.append((qkeys[at + i], keys[j], s[i, j].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(asked: DataFrame, placed: DataFrame, directory: Directory, k: int) -> DataFrame:
    """(query, key, score): the best of every (grp, cell) that ``asked`` names."""
    wanted = asked.select(F.col("grp").alias("for_grp"), F.col("cell").alias("in_cell")).distinct()
    rows = placed.select(F.col("cell").alias("in_cell"), F.col("key").alias("row"), F.col("v").alias("x"), F.col("r").alias("at"))
    rows = rows.join(wanted, "in_cell")

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query": [], "key": [], "score": []}).astype("int64")
        d = d.sort_values(["at", "row"])
        got = _closest(d["row"].to_numpy(), matrix(d["x"]), q["key"].to_numpy(), matrix(q["v"]), q["floor"].to_numpy(),
                       d["at"].to_numpy(), q["far"].to_numpy(), directory, k)
        return pd.DataFrame(dict(zip(("query", "key", "score"), got)))

    return asked.groupBy("grp", "cell").cogroup(rows.groupBy("for_grp", "in_cell")).applyInPandas(run, "query long, key long, score long")


def top_k(df: DataFrame, key: str, vec: str, queries, k: int = 20, scale=None) -> DataFrame:
    """(query, rank, key, score): the ``k`` rows of largest inner product for every row
    whose key satisfies ``queries`` (a condition on column ``key``), itself left out, ties
    to the smaller key.  ``scale`` maps a matrix to integers held as doubles.

    A query has fewer rows if the table has.  Null, null-holding and non-finite vectors
    and null keys take no part; a repeated key counts once (see ``packed``).
    """
    rows = written(packed(df, key, vec, scale))

    def norms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"n": [len(f)], "norm2": [float((matrix(f["v"]) ** 2).sum(axis=1).max()) if len(f) else 0.0]})

    size = rows.mapInPandas(norms, "n long, norm2 double").agg(F.sum("n").alias("n"), F.max("norm2").alias("norm2")).first()
    n, norm2 = size.n or 0, size.norm2 or 0.0
    pivot_count = int(min(MAX_PIVOTS, max(1, n // (2 * CELL_ROWS))))
    annuli = int(min(MAX_ANNULI, max(1, n // (CELL_ROWS * pivot_count))))
    sample = matrix([r.v for r in rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()])
    directory = Directory(np.zeros((0, 1)), norm2)
    directory.pivots = choose_pivots(directory.lifted(sample), pivot_count) if len(sample) else np.zeros((1, 2))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p, r = directory.place(matrix(f["v"])) if len(f) else (np.zeros(0, int), np.zeros(0))
            yield f.assign(p=p, r=r)

    keyed = written(rows.mapInPandas(place, "key long, v binary, p int, r double"))
    marks = [i / annuli for i in range(1, annuli)]
    cuts = keyed.groupBy("p").agg(F.percentile_approx("r", marks, 1000).alias("cuts")).collect() if marks else []
    annulus = F.lit(0)
    for c in cuts:  # at most MAX_PIVOTS rows of MAX_ANNULI - 1 cuts
        inside = sum((F.when(F.col("r") > x, 1).otherwise(0) for x in c.cuts), F.lit(0))
        annulus = F.when(F.col("p") == c.p, inside).otherwise(annulus)
    ringed = keyed.withColumn("a", annulus)
    entries = ringed.groupBy("p", "a").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).collect()
    first, listed = 0, []
    for e in sorted(entries, key=lambda e: (e.p, e.a)):
        parts = -(-e.n // CELL_ROWS)
        listed.append((e.p, e.a, e.lo, e.hi, first, parts))
        first += parts
    cell = F.lit(0).cast("long")
    for p, a, _, _, at, parts in listed:
        cell = F.when((F.col("p") == p) & (F.col("a") == a), F.lit(at) + F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(cell)
    placed = written(ringed.withColumn("cell", cell))

    asked = placed.where(queries)
    total = max(1, asked.count())
    groups = -(-total // GROUP_ROWS)
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(groups)))
    home = asked.select("grp", "cell", "key", "v", F.lit(float("-inf")).alias("floor"), F.lit(0.0).alias("far"))
    seeds = _search(home, placed, directory, k)
    floors = seeds.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    known = asked.select("grp", "key", "v").join(floors.select(F.col("query").alias("key"), "low"), "key", "left")

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            q, floor = matrix(f["v"]), f["low"].astype(float).fillna(-np.inf).to_numpy()
            far, reach = directory.query_distances(q), directory.radius(q, floor)
            for p, _, lo, hi, at, parts in listed:
                near = np.flatnonzero((far[:, p] - reach <= hi) & (far[:, p] + reach >= lo))
                for part in range(parts if len(near) else 0):
                    g = f.iloc[near]
                    yield pd.DataFrame({"grp": g["grp"], "cell": at + part, "key": g["key"], "v": g["v"], "floor": floor[near], "far": far[near, p]})

    asks = known.mapInPandas(expand, "grp long, cell long, key long, v binary, floor double, far double")
    found = _search(asks, placed, directory, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "key", "score")

