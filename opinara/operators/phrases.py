"""Lexicon terms of one or several words, found in annotated sentences by their lemmas.

A term is a sequence of lemmas.  Looking every word of the corpus up under every word of
every term would meet frequent words over and over, so each term is filed under one of
its words only, the longest; where that word stands the whole term is compared.  Of a
sentence only words that some term of several words has are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.session import cut

BROADCAST_ROWS = 200_000


def checked_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; it should be written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def form_lemmas(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """word, lemma: the most frequent lemma (ties: the smallest) that the corpus gives to
    each of ``words`` (lower-case forms)."""
    found = tokens.select(F.lower("text").alias("word"), "lemma").where(F.col("lemma") != "").join(checked_small(words), "word", "left_semi")
    counted = found.groupBy("word", "lemma").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "lemma"))
    return counted.groupBy("word").agg(best.alias("b")).select("word", F.col("b.lemma").alias("lemma"))


def lemma_terms(lexicon: DataFrame, tokens: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """The lexicon with ``lemmas``, the lemma of each word of its ``term``.

    ``lemmas`` (word, lemma) is a dictionary of forms; without one, a form has the lemma
    that the corpus most often gives it.  A form that neither knows is its own lemma,
    lower-case letters and digits only.  Terms without a word are left out.
    """
    lexicon = cut(lexicon)
    words = lexicon.select("term", F.posexplode(tx.word_list(F.lower("term"))).alias("at", "word"))
    known = form_lemmas(tokens, cut(words.select("word").distinct())) if lemmas is None else lemmas.select(F.lower("word").alias("word"), "lemma")
    own = F.regexp_replace("word", r"[^\p{L}\p{N}_]", "")
    each = words.distinct().join(cut(known), "word", "left").select("term", "at", F.coalesce("lemma", own).alias("lemma")).where("lemma <> ''")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "lemma"))), lambda x: x["lemma"])
    return lexicon.join(each.groupBy("term").agg(listed.alias("lemmas")), "term")


def _filed(terms: DataFrame) -> DataFrame:
    """lemma, at, term, lemmas: each term under its longest word (the first of equals)."""
    rank = F.transform("lemmas", lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("at")))
    rows = terms.select("term", "lemmas").distinct().withColumn("at", F.array_min(rank)["at"])
    return cut(rows.select(F.get("lemmas", F.col("at")).alias("lemma"), "at", "term", "lemmas"))


def occurrences(tokens: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, first, last: every place where the lemmas of a term follow one another
    in a sentence; ``first`` and ``last`` are the positions of its outer words.

    ``tokens`` has the keys of a sentence, ``pos`` (0, 1, ...) and ``lemma``; ``terms`` has
    ``term`` and ``lemmas`` (see :func:`lemma_terms`).  Tokens with an empty or null lemma,
    as of punctuation, do not part two words.  Occurrences may overlap, also of one term.
    """
    filed = _filed(terms)
    words = tokens.select(*keys, "pos", F.coalesce("lemma", F.lit("")).alias("lemma"))
    # one pass over all words keeps those of some term, and those without a lemma, which tell what is next to what
    named = cut(filed.select(F.explode("lemmas").alias("lemma")).union(filed.select(F.lit(""))).distinct())
    words = cut(words.join(checked_small(named), "lemma", "left_semi"))
    single = words.join(checked_small(filed.where(F.size("lemmas") == 1)), "lemma").select(
        *keys, "term", F.col("pos").alias("first"), F.col("pos").alias("last"))
    longer = filed.where(F.size("lemmas") > 1)
    # of a sentence only words that some longer term has travel
    known = cut(longer.select(F.explode("lemmas").alias("lemma")).union(longer.select(F.lit(""))).distinct())
    kept = words.join(checked_small(known), "lemma", "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "lemma"))).alias("w"))
    full = F.filter("w", lambda x: x["lemma"] != "")
    empty = F.transform(F.filter("w", lambda x: x["lemma"] == ""), lambda x: x["pos"])
    kept = kept.where(F.size(full) > 1).select(*keys, full.alias("w"), empty.alias("gaps"))
    place = lambda x: x["pos"] - F.size(F.filter("gaps", lambda g: g < x["pos"]))
    kept = kept.withColumn("w", F.transform("w", lambda x: F.struct(x["pos"].alias("pos"), x["lemma"].alias("lemma"), place(x).alias("k"))))
    rows = kept.select(*keys, "w", F.posexplode("w.lemma").alias("i", "lemma")).join(checked_small(longer), "lemma")
    begin, size = F.col("i") - F.col("at"), F.size("lemmas")
    rows = rows.withColumn("begin", begin).where("begin >= 0").withColumn("part", F.slice("w", F.col("begin") + 1, size))
    end = F.get("part", size - 1)
    same = rows.where((F.col("part.lemma") == F.col("lemmas")) & (end["k"] - F.get("part", F.lit(0))["k"] == size - 1))
    return single.unionByName(same.select(*keys, "term", F.get("part", F.lit(0))["pos"].alias("first"), end["pos"].alias("last")))
