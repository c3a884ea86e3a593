"""SimHash near-duplicates with a pigeonring filter.

The 64 bits of a fingerprint lie on a ring of 2d+1 segments.  If two fingerprints
differ in d bits or fewer, some segment starts a chain in which every first l segments
together differ in at most l*d/(2d+1) bits: none in the first two, which makes them a
join key, and few in the following ones, which is tested before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.components import connected, merge_labels
from opinara.llm.shared import written

BLOCK = 2048
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the hashed word shingles, bit by bit; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 18):
        part = words[at:at + (1 << 18) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [words]
        h = np.fromiter(map(_hash, map(b" ".join, grams)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long; null has that of no words."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.withColumn(out, run(F.col(text)))


def ring(bits: int) -> list[int]:
    """Bit masks of the segments of the ring for distance ``bits``, as even as 64 allows."""
    m = 2 * bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def chain_masks(start: int, bits: int) -> list[tuple[int, int]]:
    """(mask, most differing bits) of the chains from ``start`` that are longer than the key."""
    segments = ring(bits)
    m, out, mask = len(segments), [], 0
    for length in range(1, m + 1):
        mask |= segments[(start + length - 1) % m]
        if length > 2:
            out.append((mask, length * bits // m))
    return out or [(mask, bits)]


def links(fps: np.ndarray, start: int, bits: int, side: np.ndarray | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components of ``fps`` (equal in the key that begins at ``start``)
    under links of ``bits`` or fewer; with ``side`` only links across the two sides."""
    fps = fps.view(np.uint64)
    labels = np.arange(len(fps)) if labels is None else labels
    checks = chain_masks(start, bits)
    for at in range(0, len(fps), 256):
        x = fps[at:at + 256, None] ^ fps[None, :]
        near = np.bitwise_count(x & np.uint64(checks[0][0])) <= checks[0][1]
        if side is not None:
            near &= side[at:at + 256, None] != side[None, :]
        a, b = np.nonzero(near)
        for mask, most in checks[1:]:
            ok = np.bitwise_count(x[a, b] & np.uint64(mask)) <= most
            a, b = a[ok], b[ok]
        labels = merge_labels(labels, a + at, b)
    return labels


def _ring_keys(fp: Column, bits: int) -> Column:
    """One key for each start: the ring position and the bits of two segments."""
    segments = ring(bits)
    m = len(segments)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return F.array(*[F.struct(F.lit(i).alias("start"),
                              fp.bitwiseAND(F.lit(signed(segments[i] | segments[(i + 1) % m]))).alias("bits")) for i in range(m)])


def fingerprint_links(fps: DataFrame, bits: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (column ``fp``) as all pairs
    within ``bits`` would.  A key's fingerprints are compared in blocks of about
    ``block``, and a task returns a spanning set, never all pairs."""
    if bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keyed = fps.select("fp", F.explode(_ring_keys(F.col("fp"), bits)).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("start", "bits").agg(F.count("*").alias("n")).where("n > 1")
    placed = keyed.join(sizes, ["start", "bits"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    cells = placed.select("start", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("start", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    cells = cells.repartition("start", "bits", "i", "j").sortWithinPartitions("start", "bits", "i", "j", "fp")

    def compare(start, i, j, own, fp):
        labels = links(fp, start, bits, None if i == j else own)
        moved = labels != np.arange(len(fp))
        return fp[moved], fp[labels[moved]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            cell = f[["start", "bits", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield _cells(f, cell, np.concatenate([[0], cuts]) if last else [], compare)
            held = f.iloc[last:].reset_index(drop=True)  # its cell may go on
        if held is not None and len(held):
            yield _cells(held, held[["start", "bits", "i", "j"]].to_numpy(), [0, len(held)], compare)

    return cells.mapInPandas(run, "a long, b long")


def _cells(f: pd.DataFrame, cell: np.ndarray, cuts, compare) -> pd.DataFrame:
    fp, own, out = f["fp"].to_numpy(), f["own"].to_numpy(), []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo > 1:
            out.append(compare(int(cell[lo, 0]), int(cell[lo, 2]), int(cell[lo, 3]), own[lo:hi], fp[lo:hi]))
    cat = lambda i: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64)
    return pd.DataFrame({"a": cat(0), "b": cat(1)})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """(key, fp, component): the smallest key reachable over links of ``bits`` or fewer
    differing fingerprint bits, a row for every row of ``docs``.

    Equal fingerprints are one node, so exact copies cost one row in everything after
    the first grouping.  Null and wordless texts share fingerprint 0 and link like others.
    A null key stays null in its row and names no component unless all keys are null.
    """
    rows = written(with_fingerprint(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", shingle).drop("_text"))
    nodes = written(rows.groupBy("fp").agg(F.min("_key").alias("first")))
    reached = connected(fingerprint_links(nodes.select("fp"), bits))
    placed = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    names = placed.groupBy("root").agg(F.min("first").alias("name"))
    assign = placed.join(names, "root").select("fp", F.col("name").alias("component"))
    return rows.join(assign, "fp").select(F.col("_key").alias(key), "fp", "component")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
