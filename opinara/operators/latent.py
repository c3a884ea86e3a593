"""Key sentences by latent semantic analysis, group by group.

A group's texts are the columns of a term matrix, an entry being the smoothed frequency of
a term among those of its text.  A text ranks by the length of its column within the
leading left singular directions; with all directions that is the column's own length.

Where a group has few terms or few texts, one task solves the small side's Gram matrix.
A larger group is brought to its leading directions by block power steps: in one task where
its matrix has few entries, else by joins and sums; only the Gram matrix of the block, a few
columns wide, is formed per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.functions import vectors as vx
from opinara.operators.groups import Fold, fold_groups
from opinara.session import cut, many_tasks

SMALL_SIDE = 1500
HELD_ENTRIES = 2_000_000  # of a group's matrix in one task
STEP_ENTRIES = 250_000


def term_matrix(texts: DataFrame, groups: list[str], key: str, text: str, smooth: float = 0.4) -> DataFrame:
    """groups, key, term, x: smooth + (1 - smooth) * frequency / largest frequency of the text."""
    counts = texts.select(*groups, key, F.explode(tx.term_list(F.col(text))).alias("term")).groupBy(*groups, key, "term").agg(F.count("*").alias("n"))
    most = counts.groupBy(*groups, key).agg(F.max("n").alias("most"))
    return counts.join(most, [*groups, key]).select(*groups, key, "term", (smooth + (1 - smooth) * F.col("n") / F.col("most")).alias("x"))


def _sums(to: np.ndarray, n: int, x: np.ndarray, of: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For every row of one side the sum of x times the block's rows; entries stand in order of ``to``."""
    out = np.zeros((n, block.shape[1]))
    for k in range(0, len(to), STEP_ENTRIES):
        part = slice(k, k + STEP_ENTRIES)
        first = np.flatnonzero(np.diff(to[part], prepend=-1))
        out[to[part][first]] += np.add.reduceat(x[part, None] * block[of[part]], first, axis=0)
    return out


def _turn(gram: np.ndarray) -> np.ndarray:
    """What makes a block with this Gram matrix orthonormal, longest column first; columns without length become zero."""
    values, q = np.linalg.eigh(gram)
    keep = values > values.max(initial=0.0) * 1e-13
    return np.divide(q, np.sqrt(np.where(keep, values, 1.0)), out=np.zeros_like(q), where=keep[None, :])[:, ::-1]


def _powered_here(term: np.ndarray, doc: np.ndarray, x: np.ndarray, sizes: tuple[int, int], dimensions: int, rounds: int, extra: int) -> np.ndarray:
    """Ranks of a group by the steps of :func:`_powered`, its matrix in one task."""
    known = doc >= 0
    sides = []
    for a, b in ((term, doc), (doc, term)):
        order = np.argsort(np.where(known, a, -1), kind="stable")[np.count_nonzero(~known):]
        sides.append((a[order], x[order], b[order]))
    to_terms = lambda block: _sums(sides[0][0], sizes[0], *sides[0][1:], block)
    to_docs = lambda block: _sums(sides[1][0], sizes[1], *sides[1][1:], block)
    block = np.random.default_rng(3).choice([-1.0, 1.0], (sizes[0], dimensions + extra))
    for r in range(rounds + 1):
        block = to_terms(to_docs(block)) if r else block
        block = block @ _turn(block.T @ block)
    return np.sqrt((to_docs(block[:, :dimensions]) ** 2).sum(axis=1))


def _solved(f: pd.DataFrame, groups: list[str], key: str, dimensions: int, small: int, rounds: int, extra: int) -> pd.DataFrame:
    """Ranks of one group: from the Gram matrix of its smaller side, or by power steps if that is large."""
    (term, terms), (doc, docs) = pd.factorize(f["term"], sort=True), pd.factorize(f[key], sort=True)
    x = f["x"].to_numpy()
    told = {g: [f[g].iloc[0]] * len(docs) for g in groups}
    if min(len(terms), len(docs)) > small:
        return pd.DataFrame({**told, key: docs, "rank": _powered_here(term, doc, x, (len(terms), len(docs)), dimensions, rounds, extra)})
    short, long = (term, doc) if len(terms) <= len(docs) else (doc, term)
    order = np.argsort(long, kind="stable")
    gram = np.zeros((min(len(terms), len(docs)),) * 2)
    for part in np.split(order, np.flatnonzero(np.diff(long[order])) + 1):
        gram[np.ix_(short[part], short[part])] += np.outer(x[part], x[part])
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1][:dimensions], 0), vectors[:, ::-1][:, :dimensions]
    if len(terms) <= len(docs):
        inside = np.zeros((len(docs), len(values)))
        np.add.at(inside, doc, vectors[term] * x[:, None])
        rank = np.sqrt((inside**2).sum(axis=1))
    else:
        rank = np.sqrt((vectors**2 * values).sum(axis=1))
    return pd.DataFrame({**told, key: docs, "rank": rank})


def _across(matrix: DataFrame, block: DataFrame, by: list[str], to: list[str]) -> DataFrame:
    """to, vec: for every row of the other side the sum of x times the block's rows."""
    part = F.transform("vec", lambda v: v * F.col("x"))
    return matrix.join(block, by).select(*to, part.alias("part")).groupBy(*to).agg(vx.sum_vector(F.col("part")).alias("vec"))


def _orthonormal(block: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The block with orthonormal columns in every group; columns without length become zero."""

    def update(s, rows):
        x = np.stack(rows["vec"].to_numpy())
        return s + x.T @ x

    def finish(s):
        return pd.DataFrame({"turn": [_turn(s).ravel()]})

    @F.pandas_udf("array<double>")
    def turned(vec: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([v @ t.reshape(n, n) for v, t in zip(vec, turn)])

    gram = Fold(lambda: np.zeros((n, n)), update, lambda a, b: a + b, finish)
    turns = fold_groups(block.select(*groups, "vec"), groups, gram, "turn array<double>")
    return cut(block.join(turns, groups).withColumn("vec", turned("vec", "turn")).drop("turn"))


def _powered(matrix: DataFrame, groups: list[str], key: str, dimensions: int, rounds: int, extra: int) -> DataFrame:
    """Ranks of large groups by block power steps on the terms' side."""
    n, side, other = dimensions + extra, [*groups, "term"], [*groups, key]
    sign = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(F.xxhash64("term", i) % 2 == 0, 1.0).otherwise(-1.0))
    block = _orthonormal(cut(matrix.select(*side).distinct().withColumn("vec", sign)), groups, n)
    for _ in range(rounds):
        block = _orthonormal(cut(_across(matrix, _across(matrix, block, side, other), other, side)), groups, n)
    # the last step's columns come in order of length, so the leading ones are the first
    lead = block.withColumn("vec", F.slice("vec", 1, dimensions))
    return _across(matrix, lead, side, other).select(*other, vx.norm(F.col("vec")).alias("rank"))


def latent_ranks(matrix: DataFrame, groups: list[str], key: str, dimensions: int | None = None, small: int = SMALL_SIDE, rounds: int = 10, extra: int = 8,
                 held: int = HELD_ENTRIES) -> DataFrame:
    """groups, key, rank of every text; ``dimensions=None`` keeps all directions."""
    if dimensions is None:
        return matrix.groupBy(*groups, key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("rank"))
    matrix = cut(matrix)
    sides = [matrix.groupBy(*groups, c).agg(F.count("*").alias("n")).groupBy(*groups).agg(F.count("*").alias(f"n_{i}"), F.sum("n").alias(f"all_{i}")) for i, c in enumerate(("term", key))]
    above = (F.least("n_0", "n_1") > small) & (F.col("all_0") > held)
    sizes = cut(sides[0].join(sides[1], groups).select(*groups, above.alias("large")))
    large = sizes.where("large").select(*groups)
    kinds = ", ".join(f"`{c}` {matrix.schema[c].dataType.simpleString()}" for c in [*groups, key])
    # a task tells terms apart by their hashes, which take less room than the words
    some = matrix.join(large, groups, "left_anti").withColumn("term", F.xxhash64("term")).repartition(many_tasks(matrix), *groups)
    out = some.groupBy(*groups).applyInPandas(lambda f: _solved(f, groups, key, dimensions, small, rounds, extra), f"{kinds}, rank double")
    if large.isEmpty():
        return out
    return out.unionByName(_powered(cut(matrix.join(large, groups, "left_semi")), groups, key, dimensions, rounds, extra))


def key_thoughts(texts: DataFrame, groups: list[str], key: str, text: str, dimensions: int | None = None, **how) -> DataFrame:
    """groups, key, text of the highest rank in every group (ties: the smaller key)."""
    ranks = latent_ranks(term_matrix(texts, groups, key, text), groups, key, dimensions, **how)
    best = ranks.groupBy(*groups).agg(F.max(F.struct(F.round("rank", 9).alias("r"), (-F.col(key)).alias("i"))).alias("b"))
    return best.select(*groups, (-F.col("b.i")).alias(key)).join(texts.select(*groups, key, text), [*groups, key])
