"""Terms and phrases of texts that are dealt once and not shuffled again."""

from opinara.operators import models as md
from opinara.operators import textflow as tf
from pyspark.sql import functions as F

SAID = [(1, 0, "alpha beta alpha"), (1, 1, "beta gamma"), (1, 2, "delta"), (2, 0, "alpha delta"), (2, 1, "a"), (None, 0, "alpha beta")]


def sentences(spark):
    return spark.createDataFrame(SAID, "id long, spos int, sentence string")


def shuffles(df, column):
    """Plan lines that deal rows by more than the id."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and column in x.split("hashpartitioning(")[1].split("), ")[0]]


def test_summary_is_that_of_the_nearest_sentences(spark):
    got = {r.id: r.summary for r in md.extractive_summary(sentences(spark), ["id"], "spos", "sentence", 2).collect()}
    assert got == {1: "alpha beta alpha. beta gamma", 2: "alpha delta"}


def test_terms_and_phrases_are_not_shuffled(spark):
    stop = spark.createDataFrame([("gamma",)], "word string")
    assert not shuffles(md.tfidf(sentences(spark), ["id", "spos"], "sentence", within=["id"]), "term")
    found = tf.keyphrases(sentences(spark), stop)
    assert not shuffles(found, "word") and not shuffles(found, "phrase")
    assert {r.id for r in found.collect()} == {1, 2}


def test_texts_per_noun_are_dealt_by_part(spark):
    rows = [(i, f"t{i}", [{"lemma": w, "tag": "NOUN"} for w in ("x", "y")[: 1 + i % 2]]) for i in range(5)]
    found = spark.createDataFrame(rows, "id long, text string, toks array<struct<lemma:string,tag:string>>")
    out = tf.texts_per_noun(found, F.array().cast("array<string>"), "id", "text", 2)
    assert not shuffles(out, "noun")
    got = {(r.noun, r.part): (r.n, r.joined) for r in out.collect()}
    assert got == {("x", 0): (2, "t0. t1"), ("x", 1): (2, "t2. t3"), ("x", 2): (1, "t4"), ("y", 0): (1, "t1"), ("y", 1): (1, "t3")}


def test_corrected_texts_are_put_together_in_their_row(spark):
    rows = [(1, "god phone, Phone!"), (2, "good"), (3, None), (4, "a god"), (4, "xyz phne"), (None, "god"), (5, "phne god god")]
    fixes = spark.createDataFrame([("god", "good"), ("phne", "phone")], "word string, suggestion string")
    out = tf.correct_texts(spark.createDataFrame(rows, "id long, text string"), fixes)
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()
    # the rows of id 4 are one text: their first parts, their second parts, ...
    assert {r.id: r.corrected_text for r in out.collect()} == {1: "good phone, Phone!", 4: "axyz  goodphone", 5: "phone good good"}


def test_rare_words_are_not_sorted(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = spark.createDataFrame([("phone", 50), ("phne", 1), ("phonee", 2), ("phane", 1)], "word string, n long")
        found = tf.corrections(words)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == {(w, "phone") for w in ("phne", "phonee", "phane")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
