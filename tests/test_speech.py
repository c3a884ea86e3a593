"""Sentences and words written once, and the words around a target."""

import re

from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.operators import textflow as tf
from opinara.plans import fixtures as fx

TEXTS = ["", " . ", "a..b", "a . b.c ", "One.\n\nTwo !? three…", " x\t\ty  z ", "dots... end...", "1.5 and\u00a0\u00a02", "-- a -- B's!", "ΟΔΟΣ.Α ΟΔΟΣ", "\u2028a\u2028. b"]


def test_sentences_are_those_of_the_cleanly_spaced_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    by_rule = F.filter(F.transform(F.split(tx.clean_spacing(F.col("t")), r"[.!?…]+"), tx.strip), lambda s: s != "")
    assert all(r.a == r.b for r in df.select(tx.sentence_list(F.col("t")).alias("a"), by_rule.alias("b")).collect())


def test_words_and_lemmas_stand_at_the_same_places(spark):
    said = spark.createDataFrame([(t.strip(),) for t in TEXTS if t.strip()], "t string")
    words, lemmas = fx.spoken_words(F.col("t"))
    for r in said.select("t", words.alias("w"), lemmas.alias("l")).collect():
        assert r.w == re.split(r"\s+", r.t)
        assert [re.sub(r"[\W_]", "", w.lower()) for w in r.w] == r.l


def documents(spark, tmp_path):
    rows = [(1, "Alpha beta. Gamma beta delta.", "en", "web"), (2, "Beta gamma", "en", "web"), (2, "Beta. Beta", "en", "web"), (None, "Gamma gamma", "en", "web"), (3, None, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return fx.Tables(spark, str(tmp_path))


def test_vocabulary_counts_words_and_reviews(spark, tmp_path):
    got = {r.word: (r.df, r.n) for r in documents(spark, tmp_path).vocabulary.collect()}
    assert got == {"alpha": (1, 1), "beta": (2, 5), "gamma": (3, 4), "delta": (1, 1)}


def test_texts_are_split_once_for_the_mentions(spark, tmp_path):
    t = documents(spark, tmp_path)
    for df in (t.spoken_tokens, t.spoken_annotated.rows, t.spoken):
        assert not any("documents.parquet" in f for f in df.inputFiles())
    key = ["id", "spos", "pos", "head", "text", "lemma", "tag", "rel"]
    assert sorted(map(str, t.spoken_tokens.select(key).collect())) == sorted(map(str, t.tokens.select(key).collect()))


def test_words_under_and_over_a_target_that_is_its_own_ancestor(spark):
    rows = [(1, 0, i, h, w, w, tag, "dep") for i, (h, w, tag) in enumerate([(1, "a", "NOUN"), (0, "b", "ADJ"), (0, "c", "VERB"), (2, "d", "ADJ")])]
    tokens = spark.createDataFrame(rows, "id int, spos int, pos int, head int, text string, lemma string, tag string, rel string")
    targets = spark.createDataFrame([(1, 0, 0), (1, 0, 2)], "id int, spos int, target int")
    got = tf.related_words(tokens, targets, ["id", "spos"], F.array().cast("array<string>"))
    # positions 0 and 1 point at each other
    assert sorted((r.target, r.pos) for r in got.collect()) == [(0, 1), (0, 1), (0, 2), (0, 3), (2, 1), (2, 3)]
