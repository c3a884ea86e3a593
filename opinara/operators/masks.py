"""Closeness of vectors to a set of phrase masks, and what follows from it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions import text as tx
from opinara.functions import vectors as vx
from opinara.operators.tables import first_per

BLOCK_BYTES = 32 * 2**20
BEST = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("mask_id", T.LongType()), T.StructField("mask", T.StringType())])


def unit_rows(vectors, width: int = 1) -> np.ndarray:
    """Unit vectors as a matrix; null and zero vectors are zero, ``width`` wide if all are null."""
    vectors = list(vectors)
    width = max((len(v) for v in vectors if v is not None), default=width)
    m = np.stack([np.zeros(width) if v is None else v for v in vectors]).astype(np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _mask_blocks(masks: DataFrame, vec: str):
    """Masks as matrices of at most BLOCK_BYTES; the table's size is counted first
    and a larger one is read block by block, each block to its own broadcast."""
    size = masks.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    blocks = max(1, math.ceil((size.n or 0) * (size.d or 1) * 8 / BLOCK_BYTES))
    for b in range(blocks):
        part = masks.where(F.pmod(F.xxhash64("mask_id"), F.lit(blocks)) == b) if blocks > 1 else masks
        got = part.select("mask_id", "mask", vec).orderBy("mask_id").collect()
        if got:
            yield [r[0] for r in got], [r[1] for r in got], unit_rows(r[2] for r in got)


def _chunks(m: np.ndarray, width: int):
    step = max(1, 4_000_000 // max(1, width))
    for i in range(0, len(m), step):
        yield m[i : i + step]


def _nearest(shared):
    """UDF: the best mask of each vector within one broadcast block."""

    @F.pandas_udf(BEST)
    def nearest(v: pd.Series) -> pd.DataFrame:
        ids, names, m = shared.value
        if not len(v):
            return pd.DataFrame({"s": [], "mask_id": [], "mask": []})
        at, s = [], []
        for part in _chunks(unit_rows(v, m.shape[1]), len(m)):
            sim = part @ m.T
            i = sim.argmax(axis=1)
            at.append(i)
            s.append(sim[np.arange(len(i)), i])
        at = np.concatenate(at)
        return pd.DataFrame({"s": np.concatenate(s), "mask_id": ids[at], "mask": names[at]})

    return nearest


def _per_mask(shared, k: int):
    """UDF: per mask name the similarity to its nearest phrase."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def per_mask(v: pd.Series) -> pd.Series:
        owner, m = shared.value
        out = []
        for part in _chunks(unit_rows(v, m.shape[1]), len(m)) if len(v) else ():
            sim = part @ m.T
            out += list(np.stack([sim[:, owner == i].max(axis=1) for i in range(k)], axis=1))
        return pd.Series(out, dtype=object)

    return per_mask


def best_mask(rows: DataFrame, vec: str, masks: DataFrame, name: str = "best") -> DataFrame:
    """Struct column (s, mask_id, mask): the most similar mask, the smaller id on a
    tie; null for a null vector or without masks.  The work per row is one row of a matrix product; no pair is shuffled."""
    sc = rows.sparkSession.sparkContext
    known = F.col(vec).isNotNull()
    found = [
        F.when(known, _nearest(sc.broadcast((np.asarray(ids), np.asarray(names, dtype=object), m)))(F.col(vec)))
        for ids, names, m in _mask_blocks(masks, "vec")
    ]
    if not found:  # no mask: nothing is close
        return rows.withColumn(name, F.lit(None).cast(BEST))
    if len(found) == 1:
        return rows.withColumn(name, found[0])
    top = F.greatest(*[F.struct(b["s"].alias("s"), (-b["mask_id"]).alias("i"), b["mask"].alias("m")) for b in found])
    return rows.withColumn(name, F.struct(top["s"].alias("s"), (-top["i"]).alias("mask_id"), top["m"].alias("mask")))


def mask_similarities(rows: DataFrame, vec: str, masks: DataFrame, name: str = "sims") -> DataFrame:
    """Map column: mask name -> similarity to the nearest phrase of that mask."""
    sc = rows.sparkSession.sparkContext
    maps = []
    for _, names, m in _mask_blocks(masks, "vec"):
        labels = sorted(set(names))
        udf = _per_mask(sc.broadcast((np.searchsorted(labels, names), m)), len(labels))
        maps.append(F.map_from_arrays(F.array(*map(F.lit, labels)), udf(F.col(vec))))
    if not maps:
        return rows.withColumn(name, F.create_map().cast("map<string,double>"))
    out, low = maps[0], F.lit(-2.0)
    for more in maps[1:]:
        out = F.map_zip_with(out, more, lambda _, a, b: F.greatest(F.coalesce(a, low), F.coalesce(b, low)))
    return rows.withColumn(name, out)


def mask_label(words: Column, similarity: Column, mask_words: Column, threshold: float = 0.65, band: float = 0.1) -> Column:
    """0 close to a mask; 2 a short sentence (1, 3 or 4 words) with a mask word;
    -1 just below the threshold; 1 anything else.  The first rule that fits wins."""
    n = F.size(words)
    short = n.isin(1, 3, 4) & F.arrays_overlap(words, mask_words)
    return (
        F.when(similarity > threshold, 0).when(short, 2)
        .when(F.lit(threshold) - similarity < band, -1).otherwise(1)
    )


def label_sentences(rows: DataFrame, masks: DataFrame, mask_words: list[str], sentence: str = "sentence",
                    vec: str = "vec", threshold: float = 0.65, band: float = 0.1) -> DataFrame:
    """Stateless per row, so the same call labels a batch or a stream."""
    words = F.array(*[F.lit(w) for w in mask_words]) if mask_words else F.array().cast("array<string>")
    found = best_mask(rows, vec, masks)
    label = mask_label(tx.word_list(F.col(sentence)), F.col("best.s"), words, threshold, band)
    return found.withColumn("label", label).withColumn("max_similarity", F.col("best.s")).drop("best")


def mask_flags(rows: DataFrame, vec: str, masks: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Array of the masks a row is close to; ``flags`` is empty for a row to keep."""
    sims = mask_similarities(rows, vec, masks)
    hits = F.filter(F.map_entries("sims"), lambda e: e["value"] > threshold)
    return sims.withColumn("flags", F.sort_array(F.transform(hits, lambda e: e["key"]))).drop("sims")


def assign_masks(rows: DataFrame, vec: str, masks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``mask``: the name of the best mask, null for a row close to none or without a vector."""
    found = best_mask(rows, vec, masks)
    return found.withColumn("mask", F.when(F.col("best.s") > threshold, F.col("best.mask"))).drop("best")


def split_by_mask(rows: DataFrame, vec: str, masks: DataFrame, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(rows assigned to their best mask, rows assigned to none); whoever needs both
    together takes :func:`assign_masks`, which compares once."""
    found = assign_masks(rows, vec, masks, threshold)
    return found.where("mask IS NOT NULL"), found.where("mask IS NULL").drop("mask")


def near_centroid(rows: DataFrame, keys: list[str], key: str, vec: str) -> DataFrame:
    """Rows with ``sim``, their cosine to the mean vector of their group."""
    centre = rows.groupBy(*keys).agg(vx.mean_vector(F.col(vec)).alias("centre"))
    return rows.join(centre, keys).withColumn("sim", vx.cosine(F.col(vec), F.col("centre"))).drop("centre")


def key_rows(rows: DataFrame, keys: list[str], key: str, vec: str) -> DataFrame:
    """The row nearest to its group's centroid; the smaller id on a tie."""
    best = F.max(F.struct(F.round("sim", 12).alias("sim"), (-F.col(key)).alias("i")))
    return near_centroid(rows, keys, key, vec).groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.i")).alias(key), F.col("b.sim").alias("sim"))


def key_thoughts(rows: DataFrame, keys: list[str], vec: str = "vec", review: str = "review", key: str = "id",
                 rating: str = "rating", top: int = 2) -> DataFrame:
    """Per group and sign of rating the ``top`` reviews nearest to the sentence
    centroid: once by the first sentence of a review, once by the review's mean."""
    signed = rows.withColumn("sign", F.when(F.col(rating) > 3, "positive").otherwise("negative"))
    by = [*keys, "sign"]
    # one row stands for each review: its first sentence, and its mean vector
    per = signed.groupBy(*by, review).agg(
        F.min(key).alias("first_id"), F.min_by(vec, key).alias("v_first"), vx.mean_vector(F.col(vec)).alias("v_mean"))
    centre = signed.groupBy(*by).agg(vx.mean_vector(F.col(vec)).alias("centre"))
    sim = lambda v: F.round(vx.cosine(F.col(v), F.col("centre")), 12)
    scored = per.join(centre, by).select(*by, "first_id", F.explode(F.array(
        F.struct(F.lit("sentence").alias("kind"), sim("v_first").alias("sim")),
        F.struct(F.lit("review").alias("kind"), sim("v_mean").alias("sim")))).alias("s")).select(
        *by, "first_id", "s.kind", "s.sim")
    return first_per(scored, [*by, "kind"], [F.desc("sim"), F.asc("first_id")], top)


def mean_pair_distance(rows: DataFrame, keys: list[str], vec: str = "vec", whole_matrix: bool = False) -> DataFrame:
    """Mean pairwise cosine distance per group, 0 below two members.

    With unit vectors the mean over pairs is (n - |sum u|^2 / n) / (n - 1): one
    vector sum per group and no pairs.  ``whole_matrix`` averages the full square
    with its zero diagonal."""
    unit = rows.withColumn("u", vx.normalise(F.col(vec))).where(F.exists("u", lambda x: x != 0))
    sums = unit.groupBy(*keys).agg(F.count("*").alias("n"), vx.sum_vector(F.col("u")).alias("s"))
    length2 = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    mean = F.when(F.col("n") < 2, 0.0).otherwise((F.col("n") - length2 / F.col("n")) / (F.col("n") - 1))
    if whole_matrix:
        mean = mean * (F.col("n") - 1) / F.col("n")
    return sums.select(*keys, "n", mean.alias("mean_distance"))


def short_thoughts(rows: DataFrame, key: str, thought: str, stop: DataFrame, word_vectors: DataFrame, exclusion: DataFrame,
                   threshold: float = 0.9) -> DataFrame:
    """Keys of thoughts to leave out: one word; two words ending in a stop word;
    two or three words of which one is close to an exclusion word."""
    words = rows.select(key, tx.term_list(F.col(thought)).alias("w"))
    one = words.where(F.size("w") == 1).select(key)
    pair = words.where(F.size("w") == 2).select(key, F.get("w", F.lit(1)).alias("word")).join(
        stop.select("word"), "word", "left_semi").select(key)
    near = best_mask(word_vectors, "vec", exclusion).where(F.col("best.s") > threshold).select("word")
    close = words.where(F.size("w").isin(2, 3)).select(key, F.explode("w").alias("word")).join(
        near, "word", "left_semi").select(key)
    return one.unionByName(pair).unionByName(close).distinct()


def aspect_groups(categories: DataFrame, groups: DataFrame, main: str, threshold: float = 0.4) -> DataFrame:
    """category, grp: always the main group, plus the most similar other group when
    that is the best of all groups and reaches the threshold."""
    best = best_mask(categories, "vec", groups).where((F.col("best.s") >= threshold) & (F.col("best.mask") != main))
    return categories.select("category", F.lit(main).alias("grp")).unionByName(
        best.select("category", F.col("best.mask").alias("grp")))


def aspect_names(phrases: DataFrame, lexicon: DataFrame, term_vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """phrase -> aspect: an equal lexicon term, else the aspect of the most similar
    term vector, else the phrase itself.  ``phrases`` has phrase and vec."""
    direct = phrases.join(lexicon.groupBy(F.col("term").alias("phrase")).agg(F.min("aspect").alias("direct")), "phrase", "left")
    near = best_mask(direct, "vec", term_vectors)
    close = F.when(F.col("best.s") >= threshold, F.col("best.mask"))
    return near.select("phrase", F.coalesce("direct", close, "phrase").alias("aspect"))
