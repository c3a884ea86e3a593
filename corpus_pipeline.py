"""Clean a document corpus in stages and pack it into training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is
written as Parquet before the next one reads it.  All but the last return the columns
of ``docs``, whatever these are; the stages need ``doc_id`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import packing, queries, secrets, simhash, suffixes, toxicity
from opinara.llm.shared import written


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, if there, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 and more go.  A text without telling terms,
    null and empty ones too, is judged by the share of toxic examples among such texts."""
    scorer = queries.toxicity_scorer(docs, queries.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer, out=("__toxic_score", "__toxic_evidence"))
    return scored.where(F.col("__toxic_score") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays, once even if
    its row is repeated.  Rows without an id stay, as no group can be named by them."""
    found = simhash.near_duplicates(docs.where("doc_id IS NOT NULL"), shingle=3, bits=2)
    keep = found.where(F.col("doc_id") == F.col("component")).select("doc_id").distinct()
    one = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id IS NULL"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier in the corpus are cut out; every document stays."""
    return with_length(suffixes.remove_repeats(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return with_length(secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", repeats_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: A trained scorer, fingerprints and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
