"""Centroid clustering of integer vectors held as bit planes.

A vector of 64 integer components of w bits is w words of 64 bits: word i holds bit i of
every component, and the last word, the sign's, counts negatively (two's complement).
With planes X of a vector and C of a centroid, their dot product is the sum of
weight(i) * weight(j) * popcount(X[i] & C[j]); lengths and distances follow from dot
products, and a cluster's sums from counts of the members' bits.  All are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import written

SIZE = 64
LARGEST = 1 << 27  # 64 squared differences of such components still fit a long
STEP = 4096  # vectors compared at once: bounds a task's memory


def width_of(least: int, most: int) -> int:
    """Bits of a two's complement that holds ``least`` to ``most``."""
    return max(1, (most if most >= -least else -least - 1).bit_length() + 1)


def weights(width: int) -> np.ndarray:
    """What a bit of each plane counts; the last is the sign's."""
    w = np.int64(1) << np.arange(width, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def to_planes(x: np.ndarray, width: int) -> np.ndarray:
    """(n, 64) integers as (n, width) words."""
    bits = (x[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def plane_bits(planes: np.ndarray) -> np.ndarray:
    """(n, width) words as (n, width, 64) bits."""
    n, width = planes.shape
    return np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, width, 8), axis=2, bitorder="little")


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of (n, w) with (k, v) planes.  Sums may wrap on the way, not in the end."""
    by = weights(c.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for i, w in enumerate(weights(x.shape[1])):
        out += w * (np.bitwise_count(x[:, i, None, None] & c[None]) @ by)
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Squared length of each vector of (n, w) planes."""
    w, out = weights(x.shape[1]), np.zeros(len(x), np.int64)
    for i in range(x.shape[1]):
        out += w[i] * (np.bitwise_count(x[:, i, None] & x) @ w)
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of (n, w) to (k, v) planes."""
    return lengths(x)[:, None] - 2 * dots(x, c) + lengths(c)[None, :]


@dataclass(frozen=True)
class Clusters:
    """``rows``: (key, cluster, distance) of every kept vector; ``centroids``: their
    components in order."""

    rows: DataFrame
    centroids: np.ndarray


def bit_planes(df: DataFrame, key: str, vec: str, scale: int) -> tuple[DataFrame, int]:
    """((key, planes binary), width): floor(scale * component) of the vectors that have
    exactly 64 components, none null or non-finite.  The width is that of the widest
    component.  A row is a vector, repeated keys and null keys included; a component of
    2**27 and more after scaling raises, as its distances need not fit a long."""
    whole = (F.size(vec) == SIZE) & F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = df.where(F.col(vec).isNotNull()).where(whole).select(
        F.col(key).cast("long").alias("key"), F.transform(vec, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double")).alias("v"))
    least, most = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if least is None:
        least = most = 0
    if max(-least, most) >= LARGEST:
        raise ArithmeticError(f"a scaled component beyond {LARGEST}: squared distances may not fit a long")
    width = width_of(int(least), int(most))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE).astype(np.int64)
            planes = [p.tobytes() for p in to_planes(x, width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(planes, pa.binary())], names=["key", "planes"])

    return kept.mapInArrow(pack, "key long, planes binary"), width


def _planes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def first_centroids(planes: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:key``; null keys come last and
    equal ones by their planes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = planes.select(order.alias("h"), "planes").orderBy(F.col("h").asc_nulls_last(), "planes").limit(k).collect()
    return unpacked(np.array([np.frombuffer(r.planes, "<u8") for r in rows]).reshape(-1, width))


def unpacked(planes: np.ndarray) -> np.ndarray:
    """(n, width) words as (n, 64) integers."""
    return (plane_bits(planes).astype(np.int64) * weights(planes.shape[1])[None, :, None]).sum(axis=1)


def member_sums(planes: DataFrame, centroids: np.ndarray, width: int) -> dict[int, tuple[int, np.ndarray]]:
    """Count and component sums of every non-empty cluster.  A task adds up its own
    members, so (k x 65) rows leave it, however many vectors it reads."""
    c = to_planes(centroids, width)
    k = len(c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, n = np.zeros((k, width, SIZE), np.int64), np.zeros(k, np.int64)
        for b in batches:
            whole = _planes(b.column(0), width)
            for at in range(0, len(whole), STEP):
                x = whole[at:at + STEP]
                own = distances(x, c).argmin(axis=1)
                n += np.bincount(own, minlength=k)
                ones = plane_bits(x)
                for j in np.unique(own):
                    bits[j] += ones[own == j].sum(axis=0, dtype=np.int64)
        total = (bits * weights(width)[None, :, None]).sum(axis=1)
        out = np.column_stack([total, n])
        j, at = np.nonzero(np.repeat(n[:, None] > 0, SIZE + 1, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(at, pa.int32()), pa.array(out[j, at], pa.int64())], names=["cluster", "at", "part"])

    parts = planes.select("planes").mapInArrow(add, "cluster int, at int, part long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(r.cluster, [0] * (SIZE + 1))[r.at] = int(r.s)
    return {j: (row[SIZE], row[:SIZE]) for j, row in found.items()}


def cluster(df: DataFrame, key: str, vec: str, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> Clusters:
    """Lloyd's rounds over bit planes: each assigns every vector to the nearest centroid
    (ties: the smaller number) and moves non-empty centroids to floor(sum / count).

    The planes are written once and read by every round; only k x 64 sums come back.
    Fewer than k vectors are as many centroids; none give an empty result.  Vectors that
    are null, of another length or hold null or non-finite components take no part.
    """
    planes, width = bit_planes(df, key, vec, scale)
    planes = written(planes)
    centroids = first_centroids(planes, k, seed, width)
    for _ in range(rounds if len(centroids) else 0):
        for j, (n, total) in member_sums(planes, centroids, width).items():
            centroids[j] = [t // n for t in total]
    c = to_planes(centroids, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = _planes(b.column(1), width)
            own, far = np.zeros(len(whole), np.int32), np.zeros(len(whole), np.int64)
            for at in range(0, len(whole), STEP):
                d = distances(whole[at:at + STEP], c)
                own[at:at + STEP] = d.argmin(axis=1)
                far[at:at + STEP] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), pa.array(far)], names=["key", "cluster", "distance"])

    return Clusters(planes.mapInArrow(assign, "key long, cluster int, distance long"), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """``found.rows`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``: the k
    sums are small, so they are taken first and every vector's row carries its own."""
    from hashlib import sha256

    rows = found.rows
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    spark = rows.sparkSession
    named = [(j, s, sum(sums.values()), sha256(",".join(map(str, found.centroids[j].tolist())).encode()).hexdigest()) for j, s in sorted(sums.items())]
    per = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster")  # one row a cluster: at most k
