"""Aspect mentions, their roll-up per product, and what is derived from it.

Lists that grow with a product (example sentences, phrases, characteristics) are
long tables; a summary row only carries bounded top lists and one example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opinara.functions import text as tx
from opinara.operators import phrases as ph
from opinara.operators import textflow as tf
from opinara.operators.tables import first_per
from opinara.session import cut

PRODUCT = ["category", "product"]
ASPECT = ["category", "product", "aspect"]


def agreed_phrase(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def in_categories(reviews: DataFrame, categories: str | list[str] | None) -> DataFrame:
    if not categories:
        return reviews
    return reviews.where(F.col("category").isin([categories] if isinstance(categories, str) else list(categories)))


def mentions(sentences: DataFrame, lexicon: DataFrame, tokens: DataFrame, skip: Column | None = None, lemmas: DataFrame | None = None,
             whole: tf.Annotated | None = None) -> DataFrame:
    """One row per review and term: the example sentence with the most hits, the
    sentiment of the rating, and the characteristics found around the term in its
    first sentence (adjectives and verbs above or below its last word in the tree).

    Terms may have several words and are matched by lemma, so inflected forms count;
    ``lemmas`` (word, lemma) is a dictionary for the words of the terms, otherwise the
    corpus itself tells their lemmas.  Only keys travel with the words; the sentence text
    is looked up for the few hits.  ``whole`` has the same tokens a sentence at a time and
    spares their shuffle."""
    places = ph.occurrences(tokens, ph.lemma_terms(lexicon.select("term").distinct(), tokens, lemmas), ["id", "spos"])
    places = cut(places)  # a row for every hit, used three times
    hits = places.groupBy("id", "spos", "term").agg(F.count("*").alias("hits"))
    per = hits.groupBy("id", "term").agg(
        F.max_by("spos", F.struct("hits", -F.col("spos"))).alias("spos"), F.min("spos").alias("first_spos"))
    per = per.join(sentences.select("id", "spos", "category", "product", "rating", F.col("sentence").alias("example")), ["id", "spos"]).drop("spos")
    firsts = per.select("id", F.col("first_spos").alias("spos"), "term")
    targets = places.select("id", "spos", "term", F.col("last").alias("target")).join(firsts, ["id", "spos", "term"])
    skip = F.array().cast("array<string>") if skip is None else skip
    related = tf.related_words(tokens if whole is None else whole, targets, ["id", "spos"], skip)
    chars = related.join(targets, ["id", "spos", "target"]).groupBy("id", "term").agg(
        F.sort_array(F.collect_set("word")).alias("characteristics"))
    return per.join(lexicon.select("grp", "aspect", "term"), "term").join(chars, ["id", "term"], "left").select(
        "id", "category", "product", "grp", "aspect", "term", "example",
        tx.rating_class(F.col("rating")).alias("sentiment"),
        F.coalesce("characteristics", F.array().cast("array<string>")).alias("characteristics"))


def roll_up(found: DataFrame) -> DataFrame:
    """Aspect counts per product: ``n`` mentions; positive, negative and neutral
    reviews; rating sums of mentions; the number of characteristics."""
    mark = lambda s: F.sum((F.col("sentiment") == s).cast("int"))
    per_review = found.groupBy("id", *ASPECT, "sentiment").agg(
        F.count("*").alias("n"), F.sum(F.size("characteristics")).alias("traits"),
        F.min("grp").alias("grp"), F.min("example").alias("example"))
    rolled = per_review.groupBy(*ASPECT).agg(
        F.min("grp").alias("grp"), F.sum("n").alias("n"),
        mark("positive").alias("positive"), mark("negative").alias("negative"), mark("neutral").alias("neutral"),
        F.sum(F.when(F.col("sentiment") == "positive", F.col("n")).otherwise(0)).alias("rating_positive"),
        F.sum(F.when(F.col("sentiment") == "negative", F.col("n")).otherwise(0)).alias("rating_negative"),
        F.sum("traits").alias("traits"), F.min("example").alias("example"))
    return rolled.withColumn("sentiment", tx.polarity(F.col("positive"), F.col("negative")))


def examples(found: DataFrame) -> DataFrame:
    return found.select(*ASPECT, "example").distinct()


def characteristic_counts(found: DataFrame) -> DataFrame:
    return found.select(*ASPECT, F.explode("characteristics").alias("word")).groupBy(*ASPECT, "word").agg(
        F.count("*").alias("n"))


def phrase_counts(found: DataFrame) -> DataFrame:
    """Agreed phrases (term and characteristic) per aspect with their frequency."""
    rows = found.select(*ASPECT, "term", F.explode("characteristics").alias("word"))
    return rows.groupBy(*ASPECT, agreed_phrase(F.col("term"), F.col("word")).alias("phrase")).agg(
        F.count("*").alias("n"))


def top_list(counts: DataFrame, keys: list[str], item: str, n: int, name: str) -> DataFrame:
    """The ``n`` most frequent items per key joined by commas; ties by item."""
    totals = counts.groupBy(*keys, item).agg(F.sum("n").alias("n"))
    top = first_per(totals, keys, [F.desc("n"), F.asc(item)], n)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rk", item))).alias("x")).select(
        *keys, F.array_join(F.transform("x", lambda t: t[item]), ", ").alias(name))


def analyse(reviews: DataFrame, lexicon: DataFrame, tokens: DataFrame, categories=None, keep: int = 5,
            whole: tf.Annotated | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """Aspect table of all categories in one plan; ``sentences`` are those of the reviews
    where they have been split before."""
    if sentences is None:
        sents = tf.split_sentences(in_categories(reviews, categories).drop("url"), "text", keep_empty=False)
    else:
        sents = in_categories(sentences, categories)
    found = cut(mentions(sents, lexicon, tokens, whole=whole))  # used three times
    traits = top_list(characteristic_counts(found), ASPECT, "word", keep, "characteristics")
    phrases = top_list(phrase_counts(found), ASPECT, "phrase", keep, "agreed_phrases")
    return roll_up(found).join(traits, ASPECT, "left").join(phrases, ASPECT, "left")


def describe_aspects(rolled: DataFrame, traits: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """A descriptive text per aspect from its counts and its trait list column."""
    full = rolled.join(traits, ASPECT, "left")
    listed = F.when(F.col("characteristics").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.col("characteristics")))
    return full.select(*ASPECT, tx.contextual_description(
        F.col("aspect"), listed, F.col("positive"), F.col("negative"), F.col("example"), words).alias("description"))


def summary(rolled: DataFrame, phrases: DataFrame, top: int = 10) -> DataFrame:
    """Sums, ratios and the top phrases per sentiment of every product.

    A sentiment without any phrase lists its aspects instead."""
    sums = rolled.groupBy(*PRODUCT).agg(*[
        F.sum(c).alias(c) for c in ("n", "positive", "negative", "neutral", "rating_positive", "rating_negative")])
    out = sums.withColumns({
        "positive_ratio": F.try_divide("positive", "n"), "negative_ratio": F.try_divide("negative", "n")})
    spoken = phrases.join(rolled.select(*ASPECT, "sentiment"), ASPECT)
    silent = rolled.select(*ASPECT, "sentiment", F.lit(1).alias("n")).join(
        phrases.select(*ASPECT).distinct(), ASPECT, "left_anti")
    for s in ("positive", "negative"):
        here = F.col("sentiment") == s
        said = top_list(spoken.where(here), PRODUCT, "phrase", top, f"{s}_aspects")
        empty = silent.where(here).groupBy(*PRODUCT).agg(
            F.array_join(F.sort_array(F.collect_set("aspect")), ", ").alias("_e"))
        out = out.join(said, PRODUCT, "left").join(empty, PRODUCT, "left")
        out = out.withColumn(f"{s}_empty_aspects", F.when(F.col(f"{s}_aspects").isNull(), F.col("_e"))).drop("_e")
    return out


def recommend(summed: DataFrame) -> DataFrame:
    """Two rows: the most mentioned product, and the best rated product outside the
    popular quarter (at least five) with ten mentions or more, ``N/A`` if none."""
    k = summed.agg(F.greatest(F.lit(5), F.floor(F.count("*") * 0.25)).alias("k"))
    per_n = summed.groupBy("n").agg(F.count("*").alias("c"))
    ahead = F.sum("c").over(W.orderBy(F.desc("n"))) - F.col("c")
    levels = per_n.select("n", "c", ahead.alias("ahead")).withColumn("k", k.scalar())
    placed = summed.join(levels, "n")
    # whole count levels are in or out; only the level on the border is ordered
    border = (F.col("ahead") < F.col("k")) & (F.col("ahead") + F.col("c") > F.col("k"))
    tie = F.row_number().over(W.partitionBy("n").orderBy("category", "product"))
    rest = placed.where(F.col("ahead") >= F.col("k")).unionByName(
        placed.where(border).withColumn("tie", tie).where(F.col("tie") + F.col("ahead") > F.col("k")).drop("tie"))
    row = ["product", "positive_ratio"]
    first = summed.orderBy(F.desc("n"), "category", "product").limit(1).select(F.lit("popular").alias("kind"), *row)
    other = rest.where(F.col("n") >= 10).orderBy(F.desc("positive_ratio"), "category", "product").limit(1).select(
        F.lit("less_popular").alias("kind"), *row)
    kinds = summed.sparkSession.createDataFrame([("popular",), ("less_popular",)], "kind string")
    return kinds.join(first.unionByName(other), "kind", "left").withColumn(
        "product", F.coalesce("product", F.lit("N/A")))


def price_advice(summed: DataFrame) -> DataFrame:
    change = (
        F.when((F.col("positive_ratio") >= 0.8) & (F.col("negative_ratio") < 0.1), 0.05)
        .when(F.col("positive_ratio") < 0.5, -0.05).otherwise(0.0))
    return summed.select(*PRODUCT, tx.percent_text(change).alias("price_change"))


def product_cards(rolled: DataFrame, phrases: DataFrame, traits: DataFrame, intro: str = "Strong points", top: int = 5) -> DataFrame:
    titles = rolled.groupBy(*PRODUCT).agg(F.array_join(F.sort_array(F.collect_set("aspect")), " ").alias("names"))
    good = phrases.join(rolled.where(F.col("sentiment") == "positive").select(*ASPECT), ASPECT)
    best = top_list(good, PRODUCT, "phrase", top, "advantages")
    keys = top_list(traits, PRODUCT, "word", top, "key_features")
    out = titles.join(best, PRODUCT, "left").join(keys, PRODUCT, "left")
    return out.select(
        *PRODUCT, F.concat("product", F.lit(" - "), "names").alias("title"),
        F.concat(F.lit(f"{intro}: "), F.coalesce("advantages", F.lit("")), F.lit(".")).alias("description"),
        F.coalesce("key_features", F.lit("")).alias("key_features"), F.coalesce("advantages", F.lit("")).alias("advantages"))
