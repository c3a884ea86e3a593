"""Centre-based clustering of many groups at once: k-means and self-organising maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import vectors as vx
from opinara.session import cut

SETTLED = 1e-12


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _with_nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Points with the nearest centre ``c`` of their group (the first on a tie) and its
    squared distance ``d2``.  ``centres`` has one row per group, an array ``ms``; whether
    that table is broadcast is left to Spark's own check of its size."""
    each = F.transform("ms", lambda m, i: F.struct(_squared(F.col("v"), m).alias("d2"), i.alias("c")))
    return points.join(centres, "g").withColumn("_b", F.array_min(each)).withColumns(
        {"c": F.col("_b.c"), "d2": F.col("_b.d2")}).drop("_b", "ms")


def _starts(points: DataFrame, k: int) -> DataFrame:
    """g, ms: farthest-first starts over all rows of each group, beginning with the row of
    the smallest id.  A row equal to a start is at distance 0 and never becomes one, so
    repeated rows cost no centre; a group has fewer than ``k`` only for want of distinct rows."""
    centres = cut(points.groupBy("g").agg(F.array(F.min_by("v", "id")).alias("ms")))
    for _ in range(k - 1):
        rank = F.struct(F.col("d2"), (-F.col("id")).alias("i"))
        far = _with_nearest(points, centres).groupBy("g").agg(F.max("d2").alias("far"), F.max_by("v", rank).alias("v"))
        more = F.when(F.col("far") > 0, F.array_append("ms", F.col("v"))).otherwise(F.col("ms"))
        centres = cut(centres.join(far, "g").select("g", more.alias("ms")))
    return centres


def kmeans_groups(df: DataFrame, group: str, key: str, vec: str, k: int = 5) -> DataFrame:
    """g, id, cluster, d2: Lloyd steps for all groups in the same jobs until no centre moves.

    A group with fewer distinct rows than ``k`` gets as many clusters as distinct rows;
    rows with a null vector take no part."""
    points = cut(df.where(F.col(vec).isNotNull()).select(
        F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("id"), vx.as_double(F.col(vec)).alias("v")))
    return _lloyd(points, k)


def _lloyd(points: DataFrame, k: int) -> DataFrame:
    centres = _starts(points, k)
    while True:
        means = _with_nearest(points, centres).groupBy("g", "c").agg(vx.mean_vector(F.col("v")).alias("m"))
        per = means.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("by"))
        # a centre that has lost its rows stays where it is
        moved = F.transform("ms", lambda m, i: F.coalesce(F.element_at("by", i), m))
        shift = F.array_max(F.zip_with("ms", "to", lambda a, b: _squared(a, b) / (1 + F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))))
        step = cut(centres.join(per, "g").withColumn("to", moved).select("g", F.col("to").alias("ms"), shift.alias("shift")))
        centres = step.select("g", "ms")
        if step.where(F.col("shift") > SETTLED**2).isEmpty():
            return _with_nearest(points, centres).select("g", "id", F.col("c").alias("cluster"), "d2")


# --- self-organising map ---------------------------------------------------------------------


def hex_distances(width: int, height: int) -> np.ndarray:
    """Squared distances between the units of a hexagonal map with joined edges."""
    y, x = np.divmod(np.arange(width * height), width)
    px, py = x + 0.5 * (y % 2), y * np.sqrt(3) / 2
    dx = np.abs(px[:, None] - px[None, :])
    dy = np.abs(py[:, None] - py[None, :])
    dx, dy = np.minimum(dx, width - dx), np.minimum(dy, height * np.sqrt(3) / 2 - dy)
    return dx**2 + dy**2


def _unit_broadcast(df: DataFrame, codebook: np.ndarray):
    """The unit-length codebook; its size is the map's, 2,500 units by default."""
    size = np.linalg.norm(codebook, axis=1, keepdims=True)
    return df.sparkSession.sparkContext.broadcast(np.divide(codebook, size, out=np.zeros_like(codebook), where=size > 0))


def _closest(pdf: pd.DataFrame, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.stack(pdf["v"].to_numpy())
    n = np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.divide(v, n, out=np.zeros_like(v), where=n > 0) @ book.T
    unit = sim.argmax(axis=1)
    return v, unit, 1 - sim[np.arange(len(unit)), unit]


def project(df: DataFrame, key: str, vec: str, codebook: np.ndarray) -> DataFrame:
    """id, unit, error: the closest unit by cosine distance."""
    shared = _unit_broadcast(df, codebook)
    rows = df.select(F.col(key).cast("long").alias("id"), vx.as_double(F.col(vec)).alias("v"))

    def nearest(batches):
        for pdf in batches:
            _, unit, error = _closest(pdf, shared.value)
            yield pd.DataFrame({"id": pdf["id"], "unit": unit, "error": error})

    return rows.mapInPandas(nearest, "id long, unit int, error double")


def _unit_sums(rows: DataFrame, codebook: np.ndarray) -> DataFrame:
    """unit, n, s, e per batch: row counts, vector sums and errors of the units hit."""
    shared = _unit_broadcast(rows, codebook)

    def sums(batches):
        for pdf in batches:
            v, unit, error = _closest(pdf, shared.value)
            hit, at = np.unique(unit, return_inverse=True)
            s = np.zeros((len(hit), v.shape[1]))
            np.add.at(s, at, v)
            yield pd.DataFrame({"unit": hit, "n": np.bincount(at), "s": list(s), "e": np.bincount(at, weights=error)})

    return rows.mapInPandas(sums, "unit int, n long, s array<double>, e double")


def train_map(df: DataFrame, key: str, vec: str, width: int = 50, height: int = 50, epochs: int = 10, seed: int = 32):
    """(codebook, mean error per epoch).  Batch training: every epoch assigns all rows,
    sums them per unit on Spark, and smooths the unit sums over the map."""
    data = df.select(F.col(key).cast("long").alias("id"), vx.as_double(F.col(vec)).alias("v"))
    data = cut(data)
    stats = data.agg(vx.mean_vector(F.col("v")).alias("m"),
                     vx.mean_vector(F.transform("v", lambda x: x * x)).alias("q")).first()
    mean, square = np.asarray(stats.m), np.asarray(stats.q)
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    codebook = mean + spread * np.random.default_rng(seed).standard_normal((width * height, len(mean)))
    d2, errors = hex_distances(width, height), []
    for e in range(epochs):
        radius = max(width, height) / 4 * (0.5 / (max(width, height) / 4)) ** (e / max(1, epochs - 1))
        sums = _unit_sums(data, codebook).groupBy("unit").agg(
            F.sum("n").alias("n"), vx.sum_vector(F.col("s")).alias("s"), F.sum("e").alias("e")).collect()
        n, s = np.zeros(len(codebook)), np.zeros_like(codebook)
        for row in sums:  # at most one row per unit of the map
            n[row.unit], s[row.unit] = row.n, row.s
        errors.append(float(sum(r.e for r in sums) / max(1.0, n.sum())))
        h = np.exp(-d2 / (2 * radius**2))
        weight = h @ n
        fresh = np.divide(h @ s, weight[:, None], out=np.zeros_like(s), where=weight[:, None] > 1e-12)
        codebook = np.where(weight[:, None] > 1e-12, fresh, codebook)
    return codebook, errors


def codebook_frame(spark, codebook: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(codebook)], "unit int, weights array<double>")
