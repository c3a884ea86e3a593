"""Registered queries of the corpus operators, op1 to op13, and their SQL."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import alignment, bitplanes, bpe, hnsw, langid, licences, packing, passages, secrets, simhash, suffixes, topk, toxicity
from opinara.llm.shared import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("key") % 20 == 0, 20, lambda x: np.floor(64 * x))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.95)


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) = e.vec_id AS kept
FROM embeddings e
"""


def toxicity_scorer(docs: DataFrame, labels: DataFrame) -> toxicity.Scorer:
    """Learnt from the labelled documents that are not held out."""
    known = docs.where(crc_mod("doc_id", 5) != 0).select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    return toxicity.fit(known, docs)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_scorer(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                         F.transform("evidence", lambda e: e["key"]).alias("evidence"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listed(F.col("secrets"), True), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets"), False).alias("spans"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.recognise(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id", F.size("licence_sentences").cast("long").alias("n_sentences"),
        F.concat_ws(",", "licence_sentences").alias("sentence_ids"),
        F.concat_ws(",", F.array_sort(F.array_distinct("licences.licence"))).alias("licences"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitplanes.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=8, rounds=10, scale=1024, seed=3)
    return bitplanes.with_inertia(found).select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql(k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """Centroids of each round as (cluster, at, value) rows, floor(sum / count) by exact remainders."""
    near = lambda r: (
        f"d{r} AS (SELECT x.id, c.cluster, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS distance FROM x JOIN c{r} c USING (pos) GROUP BY x.id, c.cluster), "
        f"a{r} AS (SELECT id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS o FROM d{r}) WHERE o = 1)")
    move = lambda r: (
        f"s{r} AS (SELECT cluster, pos, sum(v) AS s, count(*) AS n FROM a{r} JOIN x USING (id) GROUP BY cluster, pos), "
        f"c{r + 1} AS (SELECT c.cluster, c.pos, CAST(coalesce((s - ((s % n) + n) % n) // n, c.v) AS BIGINT) AS v FROM c{r} c LEFT JOIN s{r} USING (cluster, pos))")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT id, unnest(v) AS v, generate_subscripts(v, 1) AS pos FROM kept),
o AS (SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST) - 1 AS cluster FROM kept),
c0 AS (SELECT cluster, pos, v FROM o JOIN x USING (id) WHERE cluster < {k}),
{", ".join(near(r) + ", " + move(r) for r in range(rounds))}, {near(rounds)},
i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster),
h AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM i) AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (id) JOIN i USING (cluster) JOIN h USING (cluster)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


OP13_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT r, doc_id, u.i AS i, array_to_string(list_slice(ws, u.i, u.i + 49), ' ') AS s FROM w, unnest(range(1, len(ws) - 48)) AS u(i)),
f AS (SELECT s, min(doc_id) AS m FROM p GROUP BY s),
c AS (SELECT DISTINCT r, i + k.k AS pos FROM p JOIN f USING (s), range(50) AS k(k) WHERE m < doc_id),
v AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
t AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept FROM v ANTI JOIN c USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST((SELECT count(*) FROM c WHERE c.r = w.r) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (r)
"""


QUERIES = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language": op8_language,
    "op9_licences": op9_licences,
    "op10_repeats": op10_repeats,
    "op11_bit_planes": op11_bit_planes,
    "op12_alignment": op12_alignment,
    "op13_passages": op13_passages,
}

SQL = {"op1_topk": OP1_SQL, "op3_embeddings": OP3_SQL, "op9_licences": licences.SQL, "op11_bit_planes": op11_sql(), "op13_passages": OP13_SQL}
