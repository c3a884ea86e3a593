"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Labelled examples lie in an inverted index cut into blocks; each term keeps its
largest weight in every block.  A query opens the most promising blocks first and
then every block whose bound reaches the k-th cosine found, so the neighbours are
exact.  Their distance-weighted votes are turned into probabilities by a monotone
fit on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
BLOCK = 64


def features(text: str | None) -> Counter:
    """Counts of a text's words and, with ``^`` in front, of the beginnings of its longer
    words (4 and 5 letters), in which inflected and compound forms meet."""
    counts = Counter(WORD.findall(text.lower())) if text else Counter()
    for w, n in list(counts.items()):
        if len(w) > 5:
            counts["^" + w[:4]] += n
            counts["^" + w[:5]] += n
    return counts


class Index:
    """Unit TF-IDF vectors of labelled examples as postings in blocks."""

    def __init__(self, terms: list[str], idf: np.ndarray, keys: np.ndarray, labels: np.ndarray, rows: list[dict[int, float]]):
        self.terms, self.idf = {t: i for i, t in enumerate(terms)}, idf
        order = sorted(range(len(rows)), key=lambda i: (sorted(rows[i], key=lambda t: -rows[i][t])[:1], keys[i]))
        self.keys, self.labels = keys[order], labels[order]
        blocks = max(1, -(-len(rows) // BLOCK))
        ids = [(t, e, w) for e, i in enumerate(order) for t, w in self._unit(rows[i])]
        ids.sort()
        self.example = np.array([e for _, e, _ in ids], np.int64)
        self.weight = np.array([w for _, _, w in ids], np.float64)
        cell = np.array([t * blocks + e // BLOCK for t, e, _ in ids], np.int64)
        self.start = np.searchsorted(cell, np.arange(len(terms) * blocks + 1)).reshape(-1)
        self.top = np.zeros(len(terms) * blocks)
        np.maximum.at(self.top, cell, self.weight)
        self.blocks = blocks
        self.calibration = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.empty = 0.0  # score of texts without any indexed term

    def _unit(self, counts: dict[int, float]) -> list[tuple[int, float]]:
        found = [(t, (1 + np.log(n)) * self.idf[t]) for t, n in counts.items()]
        norm = np.sqrt(sum(w * w for _, w in found))
        return [(t, w / norm) for t, w in found] if norm > 0 else []

    def _add(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray, scores: np.ndarray) -> None:
        """Add the postings of ``terms`` in ``blocks`` to ``scores``."""
        cells = (terms[:, None] * self.blocks + blocks[None, :]).ravel()
        lo, n = self.start[cells], self.start[cells + 1] - self.start[cells]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        by = np.repeat(np.repeat(q, len(blocks)), n)
        scores += np.bincount(self.example[at], self.weight[at] * by, len(scores))

    def nearest(self, counts: dict[int, float], k: int, without=None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, ties to the smaller key."""
        unit = self._unit(counts)
        if not unit or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        terms, q = np.array([t for t, _ in unit]), np.array([w for _, w in unit])
        bound = q @ self.top.reshape(-1, self.blocks)[terms]
        order = np.argsort(-bound, kind="stable")
        first = order[:max(2, -(-2 * k // BLOCK))]
        scores = np.zeros(len(self.keys))
        self._add(terms, q, first, scores)
        if without is not None:
            scores[without] = 0
        floor = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        rest = order[len(first):]
        rest = rest[(bound[rest] >= floor - 1e-12) & (bound[rest] > 0)]
        if len(rest):
            self._add(terms, q, rest, scores)
            if without is not None:
                scores[without] = 0
        near = np.flatnonzero(scores >= max(np.partition(scores, -k)[-k] if len(scores) > k else 0.0, 1e-12) - 1e-12)
        best = near[np.lexsort((self.keys[near], -np.round(scores[near], 12)))[:k]]
        return best, scores[best]

    def vote(self, best: np.ndarray, cosine: np.ndarray, prior: float) -> float:
        w = 1 / (1.02 - np.minimum(cosine, 1.0))
        return float((w @ self.labels[best] + prior) / (w.sum() + 1))


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit of 0/1 outcomes, by pooling neighbours that fall."""
    xs, inverse = np.unique(x, return_inverse=True)
    n, s = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    pools: list[list[float]] = []
    for a, m, t in zip(xs, n, s):
        pools.append([a, a, m, t])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            lo, hi = pools[-2], pools.pop()
            pools[-1] = [lo[0], hi[1], lo[2] + hi[2], lo[3] + hi[3]]
    at = np.array([v for p in pools for v in p[:2]])
    return at, np.array([(p[3] + 0.05) / (p[2] + 0.1) for p in pools for _ in range(2)])


class Scorer:
    def __init__(self, index: Index, k: int, prior: float):
        self.index, self.k, self.prior = index, k, prior

    def counts(self, text: str | None) -> dict[int, float]:
        known = self.index.terms
        return {known[t]: n for t, n in features(text).items() if t in known}

    def score(self, counts: dict[int, float]) -> tuple[float, list[dict]]:
        ix = self.index
        best, cosine = ix.nearest(counts, self.k)
        if not len(best):
            return ix.empty, []
        p = float(np.interp(ix.vote(best, cosine, self.prior), *ix.calibration))
        evidence = [{"key": int(ix.keys[b]), "cosine": float(c), "toxic": int(ix.labels[b])} for b, c in zip(best[:5], cosine[:5])]
        return min(1.0, max(0.0, p)), evidence


def _term_counts(rows: DataFrame, label: str | None, known: list[str] | None) -> DataFrame:
    """(term, n, n1): documents that hold each term, all and toxic, summed per batch first."""
    keep = set(known) if known is not None else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, n1 = Counter(), Counter()
            for t, y in zip(f["text"], f["y"]):
                found = features(t).keys()
                found = found & keep if keep is not None else found
                n.update(found)
                if y:
                    n1.update(found)
            yield pd.DataFrame([(t, c, n1[t]) for t, c in n.items()], columns=["term", "n", "n1"])

    part = rows.select("text", (F.col(label) if label else F.lit(0)).alias("y")).mapInPandas(run, "term string, n long, n1 long")
    return part.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def informative_terms(rows: DataFrame, toxic: int, clean: int, bound: int = 2048, least: int = 4, share: float = 0.02, lift: float = 3.0) -> list[str]:
    """Terms whose share differs between the labels ``lift`` times and beyond chance
    (log-likelihood ratio of 15 and more) and that ``share`` of one label's documents have
    (at least ``least``), so that the rare words of one copied document tell nothing; the
    most telling ``bound`` of them."""
    a, b = F.col("n1"), F.col("n") - F.col("n1")
    pa, pb = (a + 0.5) / (toxic + 1.0), (b + 0.5) / (clean + 1.0)
    total = toxic + clean
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = 2 * (part(a, F.col("n") * (toxic / total)) + part(b, F.col("n") * (clean / total))
             + part(toxic - a, (total - F.col("n")) * (toxic / total)) + part(clean - b, (total - F.col("n")) * (clean / total)))
    common = (a >= max(least, share * toxic)) | (b >= max(least, share * clean))
    counted = _term_counts(rows, "y", None).where(common)
    picked = counted.withColumn("g", g).where((F.col("g") >= 15) & (F.greatest(pa / pb, pb / pa) >= lift))
    return sorted(r.term for r in picked.orderBy(F.desc("g"), "term").limit(bound).select("term").collect())


def fit(labelled: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = 10_000, k: int = 15) -> Scorer:
    """A scorer from ``labelled`` (key, text, label 0/1) with document frequencies over
    all of ``corpus``.  The labelled rows used are a sample of about ``sample``, drawn by
    the key's hash; rows with a null label or key are left out.  Without labelled rows
    every score is 0."""
    rows = labelled.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    rows = rows.where("key IS NOT NULL AND y IN (0, 1)")
    u = F.pmod(F.xxhash64(F.col("key"), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    size = rows.count()
    rows = rows.where(u * F.lit(float(size)) < F.lit(float(sample)))
    got = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = got.get(1, 0), got.get(0, 0)
    if not toxic or not clean:
        index = Index([], np.zeros(0), np.zeros(0, np.int64), np.zeros(0), [])
        index.empty = float(toxic > 0)
        return Scorer(index, k, index.empty)
    terms = informative_terms(rows, toxic, clean)
    docs = corpus.count()
    seen = {r.term: r.n for r in _term_counts(corpus.select(F.col(text).alias("text")), None, terms).collect()}
    idf = np.array([np.log((1 + docs) / (1 + seen.get(t, 0))) + 1 for t in terms])
    place = {t: i for i, t in enumerate(terms)}

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [{place[t]: n for t, n in features(x).items() if t in place} for x in f["text"]]
            yield pd.DataFrame({"key": f["key"], "y": f["y"], "terms": [list(c) for c in found],
                                "counts": [[float(v) for v in c.values()] for c in found]})

    sampled = sorted(rows.mapInPandas(vectors, "key long, y int, terms array<int>, counts array<double>").collect())
    counts = [dict(zip(r.terms, r.counts)) for r in sampled]
    prior = toxic / (toxic + clean)
    bare = [r.y for r, c in zip(sampled, counts) if not c]
    full = [i for i, c in enumerate(counts) if c]
    index = Index(terms, idf, np.array([sampled[i].key for i in full], np.int64), np.array([float(sampled[i].y) for i in full]),
                  [counts[i] for i in full])
    index.empty = (sum(bare) + prior) / (len(bare) + 1)
    at = {int(key_): p for p, key_ in enumerate(index.keys)}
    votes, truth = [], []
    for i in full:
        best, cosine = index.nearest(counts[i], k, at[sampled[i].key])
        votes.append(index.vote(best, cosine, prior))
        truth.append(float(sampled[i].y))
    if votes:
        index.calibration = monotone(np.array(votes), np.array(truth))
    return Scorer(index, k, prior)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", out: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """``docs`` with two more columns (replaced if there): the score, 0 to 1, and the
    evidence, the five nearest examples as structs of key, cosine and label.  A text without any indexed term, null and empty ones too, has the
    share of toxic examples among such texts and no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by fit's sample and terms

    @F.pandas_udf("score double, evidence array<struct<key:long,cosine:double,toxic:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for batch in batches:
            got = [s.score(s.counts(t)) for t in batch]
            yield pd.DataFrame({"score": [p for p, _ in got], "evidence": [e for _, e in got]})

    got = docs.withColumn("_toxicity", run(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out],
                      F.col("_toxicity.score").alias(out[0]), F.col("_toxicity.evidence").alias(out[1]))
