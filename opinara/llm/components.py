"""Connected components: inside a block of nodes with numpy, over all blocks with Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import forget, written


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (each node's smallest known companion, by position) after adding the
    links ``a``-``b``: hook larger labels onto smaller ones and shorten paths until still."""
    while True:
        x, y = labels[a], labels[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        if (lo == hi).all():
            return labels
        np.minimum.at(labels, hi, lo)
        while (labels != (up := labels[labels])).any():
            labels = up


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the
    smallest node reachable.

    Alternates two star steps: every node links its larger neighbours, then its smaller
    ones, to the smallest of them.  Edges never grow in number, minima are taken before
    rows are joined, and each round is a table in the shared folder.
    """
    lower = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(lower(edges))
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = lower(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        then = written(lower(small))
        seen = then.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        forget(now)
        now = then
        if seen == state or not seen.n:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node")))
