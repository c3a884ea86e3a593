"""What the plans must and must not hold."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from opinara.operators import density as dn
from opinara.operators import models as md
from opinara.operators import tables as tb
from opinara.operators import textflow as tf
from opinara.plans import load_registry
from opinara.plans.fixtures import Tables


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 5 as rating", "repeat('x', 50) as text").write.parquet(str(tmp_path / "r"))
    got = plan(spark.read.parquet(str(tmp_path / "r")).where("rating = 4").select("id"))
    assert "PushedFilters: [IsNotNull(rating), EqualTo(rating,4)]" in got and "text" not in got.split("ReadSchema")[1].split("\n")[0]


def test_no_product_joins(spark):
    df = spark.range(50).select(F.lit("g").alias("g"), "id", F.array(F.rand(1), F.rand(2)).alias("vec"))
    assert "CartesianProduct" not in plan(dn.dbscan(df, "g", "id", "vec", 0.1, 3))
    assert "NestedLoop" not in plan(tb.min_max_scaled(spark.range(9).select(F.col("id").alias("x")), ["x"]))


def test_quantiles_and_prefix_sums(spark):
    v = np.random.default_rng(0).normal(size=500).round(2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double").repartition(7)
    got = {r.prob: r.value for r in tb.exact_quantiles(df, ["v"], [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).collect()}
    for p, x in got.items():
        assert abs(np.quantile(v, p) - x) < 1e-9
    sums = {r.id: r.before for r in tb.prefix_sum(df.withColumn("one", F.lit(1)), "id", "one", width=32).collect()}
    assert sums == {i: i for i in range(500)}


def test_split_is_the_same_on_any_layout(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 3)
    a = {r.id for r in md.stratified_split(df.repartition(1), "id", "y")[1].collect()}
    b = {r.id for r in md.stratified_split(df.repartition(17), "id", "y")[1].collect()}
    assert a == b and len(a) == 102


def test_corrections_equal_brute_force(spark):
    words = [("maison", 100), ("maisn", 1), ("maisom", 2), ("maisons", 1), ("chat", 50), ("chap", 1), ("xyz", 1), ("chats", 30)]
    got = {r.word: r.suggestion for r in tf.corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"maisn": "maison", "maisom": "maison", "maisons": "maison", "chap": "chat"}


def test_clause_tree(spark):
    rows = [(1, 0, 1, "Экран", "экран", "NOUN", "nsubj"), (1, 1, 1, "яркий", "яркий", "ADJ", "root"), (1, 2, 1, ",", ",", "PUNCT", "punct"),
            (1, 3, 4, "звук", "звук", "NOUN", "nsubj"), (1, 4, 1, "тихий", "тихий", "ADJ", "conj")]
    tokens = spark.createDataFrame(rows, "id long, pos int, head int, text string, lemma string, tag string, rel string")
    got = {r.clause: r.text for r in tf.clauses(tokens, ["id"]).collect()}
    assert got == {1: "Экран яркий", 4: "звук тихий"}
    black = F.array(F.lit("тихий"))
    assert [r.clause for r in tf.descriptive_clauses(tf.clauses(tokens, ["id"]), black).collect()] == [1]


def repeated_texts(spark, tmp_path):
    """Reviews of which some share an id, have none, or have no text."""
    text = "Good Phone, nice. Bad price and Bad sound! One two three four five six seven, eight nine. Big " + "word " * 20
    rows = [(1, text), (2, "Fine. " + text), (2, "Other words here, again. " + text), (None, text), (None, "No id. Here, at all."), (3, None), (4, " . ")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return Tables(spark, str(tmp_path))


def test_whole_sentences_need_no_shuffled_tokens(spark, tmp_path):
    t = repeated_texts(spark, tmp_path)
    keys = ["id", "spos"]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(tf.clauses(t.annotated, keys), tf.clauses(t.tokens, keys))
    assert same(tf.clauses(t.annotated, keys, fallback=True), tf.clauses(t.tokens, keys, fallback=True))
    targets = t.tokens.where("pos = 1 OR lemma = 'word'").select(*keys, F.col("pos").alias("target"))
    none = F.array().cast("array<string>")
    assert same(tf.related_words(t.annotated, targets, keys, none), tf.related_words(t.tokens, targets, keys, none))
    aggregates = [x for x in plan(load_registry()["t4_clauses"].run(t)).split("\n") if "collect_list" in x]
    assert aggregates and not any("head" in x or "lemma" in x for x in aggregates)


def test_vocabulary_counts_a_repeated_id_once(spark, tmp_path):
    t = repeated_texts(spark, tmp_path)
    want = t.words.groupBy("id", "word").agg(F.count("*").alias("n")).groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    assert sorted(t.vocabulary.select("word", "df", "n").collect()) == sorted(want.collect())
