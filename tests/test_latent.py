"""Latent ranks against numpy's singular value decomposition."""

import random

import numpy as np
import pytest

from opinara.operators import latent as lt


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(14)]
    return [(g, 10 * k + i, " ".join(rng.choice(words[i % 3:i % 3 + 7]) for _ in range(rng.randint(1, 9))))
            for k, (g, n) in enumerate((("a", 9), ("b", 30), ("c", 1))) for i in range(n)]


def brute(rows, dimensions):
    out = {}
    for g in {r[0] for r in rows}:
        docs = [(k, t.split()) for h, k, t in rows if h == g]
        terms = sorted({w for _, t in docs for w in t})
        m = np.zeros((len(terms), len(docs)))
        for j, (_, t) in enumerate(docs):
            most = max(t.count(w) for w in t)
            for w in set(t):
                m[terms.index(w), j] = 0.4 + 0.6 * t.count(w) / most
        _, s, v = np.linalg.svd(m, full_matrices=False)
        s[dimensions if dimensions is not None else len(s):] = 0
        out |= {(g, k): float(r) for (k, _), r in zip(docs, np.sqrt((s[:, None] ** 2 * v**2).sum(axis=0)))}
    return out


@pytest.mark.parametrize("dimensions,small", [(None, 0), (1, 1500), (3, 1500), (2, 0)])
def test_ranks_equal_the_decomposition(spark, dimensions, small):
    rows = corpus()
    rows = [(g, k + 1000 * "abc".index(g), t) for g, k, t in rows]
    df = spark.createDataFrame([*rows, ("a", 9000, None), ("d", 9001, "")], "g string, id long, text string")
    got = {(r.g, r.id): r["rank"] for r in lt.latent_ranks(lt.term_matrix(df, ["g"], "id", "text"), ["g"], "id", dimensions, small=small, rounds=16).collect()}
    assert got == pytest.approx(brute(rows, dimensions), abs=1e-6 if small or dimensions is None else 1e-3)


def test_key_thought_is_the_highest_rank(spark):
    rows = [("g", 1, "one two three four"), ("g", 2, "one two three four"), ("g", 3, "one one"), ("h", 4, "x")]
    df = spark.createDataFrame(rows, "g string, id long, text string")
    assert {(r.g, r.id, r.text) for r in lt.key_thoughts(df, ["g"], "id", "text").collect()} == {("g", 1, "one two three four"), ("h", 4, "x")}
