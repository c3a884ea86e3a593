"""From texts to sentences, tokens, clauses, phrases and word statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opinara.functions import text as tx
from opinara.functions import vectors as vx
from opinara.operators import tables as tb
from opinara.operators.phrases import checked_small
from opinara.session import cut


def rank_small(df: DataFrame, order: list[Column], name: str = "rk") -> DataFrame:
    """Row numbers over a table already limited to a few rows."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def split_sentences(df: DataFrame, text: str, keep_empty: bool = True) -> DataFrame:
    """One row per sentence with its position ``spos``; a text without any sentence
    keeps one row with nulls unless ``keep_empty`` is false."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, explode(tx.sentence_list(F.col(text))).alias("spos", "sentence"))


def chunk_sentences(df: DataFrame, sentence: str, limit: int = 100, breakers: tuple[str, ...] = ()) -> DataFrame:
    """Sentences longer than ``limit`` in chunks; shorter ones as they are."""
    short = F.array(F.col(sentence))
    parts = F.when(F.length(sentence) < limit, short).otherwise(
        tx.chunk_long(tx.word_list(F.col(sentence)), limit, breakers)
    )
    return df.select(*[c for c in df.columns if c != sentence], F.posexplode(parts).alias("cpos", "chunk"))


def tag_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tag and lemma of each word from a dictionary(word, lemma, tag); a word the
    dictionary lacks keeps its lower-case form and the tag ``X``."""
    return words.join(dictionary, "word", "left").withColumns(
        {"lemma": F.coalesce("lemma", F.lower("word")), "tag": F.coalesce("tag", F.lit("X"))}
    )


def lemmatise(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    return words.join(lemmas, "word", "left").withColumn("lemma", F.coalesce("lemma", F.lower("word")))


# --- clauses ---------------------------------------------------------------------

TOKEN = ["pos", "head", "text", "lemma", "tag", "rel"]


@dataclass(frozen=True)
class Annotated:
    """Sentences whose tokens stand in their own row: ``rows`` has every sentence once, and
    ``tk``, an expression over its columns, gives the tokens in order.  Wherever a token
    table is taken whole sentences at a time this does without a shuffle of the tokens, and
    a join moves what ``rows`` holds, such as the text, not the tokens made from it."""

    rows: DataFrame
    tk: Column


def _sentence_rows(tokens: DataFrame | Annotated, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """One row per sentence with its tokens in order (positions run 0..n-1); with ``wanted``
    (keys and more) only its sentences, with its columns."""
    if isinstance(tokens, Annotated):
        rows = tokens.rows if wanted is None else tokens.rows.join(wanted, keys)
        more = [] if wanted is None else [c for c in wanted.columns if c not in keys]
        return rows.select(*keys, *more, tokens.tk.alias("tk"))
    if wanted is not None:
        tokens = tokens.join(wanted.select(*keys), keys, "left_semi")
    rows = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*TOKEN))).alias("tk"))
    return rows if wanted is None else rows.join(wanted, keys)


def parent_texts(tokens: DataFrame | Annotated, keys: list[str]) -> DataFrame:
    """keys, pos, text, parent: every token below another with the text of that one.  A token finds
    its parent inside its sentence's row; where sentences share their keys, each at that place."""
    rows = _sentence_rows(tokens, keys).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    tk = F.col("tk")
    alone = F.size(tk) == F.element_at(tk, -1)["pos"] + 1
    above = lambda t: F.when(alone, F.array(F.get(tk, t["head"]))).otherwise(F.filter(tk, lambda p: p["pos"] == t["head"]))
    below = F.filter(tk, lambda t: t["head"] != t["pos"])
    found = F.flatten(F.transform(below, lambda t: F.transform(above(t), lambda p: F.struct(t["pos"].alias("pos"), t["text"].alias("text"), p["text"].alias("parent")))))
    return rows.where(F.size(tk) > 0).select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")


def _in_clauses(tokens: DataFrame | Annotated, keys: list[str], stop: Column | None, fallback: bool) -> DataFrame:
    """Sentences with ``x``, their tokens ``t`` that belong to a clause head ``clause``.

    Heads are tokens with the relation ``root`` or ``conj`` and self-headed tokens
    (with ``fallback``: self-headed ones only where a sentence has no other head).
    Every token points to its parent, heads to themselves; squaring the pointer
    array log2(n) times leads each token to its head without any join.  Childless
    tokens holding punctuation fall out.  With ``stop``, stop words and tokens with
    digits or punctuation fall out together with what hangs below them.
    """
    tk = F.col("tk")
    named = lambda t: t["rel"].isin("root", "conj")
    has_named = F.exists(tk, named)

    def is_end(t, any_named):
        own = t["head"] == t["pos"]
        end = (named(t) | (~any_named & own)) if fallback else (named(t) | own)
        if stop is not None:
            end = end | F.array_contains(stop, t["lemma"]) | t["text"].rlike(r"\p{Nd}|" + tx.PUNCT)
        return end

    up = vx.bind(has_named, lambda any_named: F.transform(
        tk, lambda t: F.when(is_end(t, any_named), t["pos"]).otherwise(t["head"])))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("tk") + 1)).cast("int") + 1)
    punct = F.transform(F.filter(tk, lambda t: t["text"].rlike(tx.PUNCT)), lambda t: t["pos"])
    parents = F.transform(F.filter(tk, lambda t: t["head"] != t["pos"]), lambda t: t["head"])
    rows = (
        _sentence_rows(tokens, keys)
        .withColumn("up", up)
        .withColumn("up", F.aggregate(rounds, F.col("up"), lambda acc, _: F.transform(acc, lambda i: F.get(acc, i))))
        .withColumn("kept", F.array_except(F.transform(tk, lambda t: t["pos"]), F.array_except(punct, parents)))
        .withColumn("has_named", has_named)
    )
    # the rows are put together inside the array, so exploding copies no array
    one = F.transform("kept", lambda i: F.struct(
        F.get("up", i).alias("clause"), F.get("tk", i).alias("t"), F.get("tk", F.get("up", i)).alias("h")))

    def head_ok(x):
        own = x["h"]["head"] == x["h"]["pos"]
        return x["h"]["rel"].isin("root", "conj") | ((own & ~F.col("has_named")) if fallback else own)

    return rows.select(*keys, F.filter(one, head_ok).alias("x"))


def clause_tokens(tokens: DataFrame | Annotated, keys: list[str], stop: Column | None = None,
                  fallback: bool = False) -> DataFrame:
    """Tokens with the position of the clause head they belong to (see :func:`_in_clauses`)."""
    rows = _in_clauses(tokens, keys, stop, fallback).select(*keys, F.explode("x").alias("x"))
    return rows.select(*keys, "x.clause", "x.t.*")


def clauses(tokens: DataFrame | Annotated, keys: list[str], stop: Column | None = None, fallback: bool = False) -> DataFrame:
    """One row per clause: its text and its tokens (pos, text, lemma, tag, rel) in order.

    The clauses are cut out of the sentence's own sorted array, so nothing is grouped."""
    part = lambda t: F.struct(*[t[c].alias(c) for c in ("pos", "text", "lemma", "tag", "rel")])
    c = F.col("c")
    starts = F.array_compact(F.transform(c, lambda e, i: F.when((i == 0) | (F.get(c, i - 1)["clause"] != e["clause"]), i)))
    cuts = F.transform("starts", lambda s, j: F.struct(
        F.get(c, s)["clause"].alias("clause"),
        F.transform(F.slice(c, s + 1, F.coalesce(F.get("starts", j + 1), F.size(c)) - s), lambda e: e["part"]).alias("toks")))
    found = (
        _in_clauses(tokens, keys, stop, fallback)
        .select(*keys, F.sort_array(F.transform("x", lambda x: F.struct(x["clause"].alias("clause"), part(x["t"]).alias("part")))).alias("c"))
        .withColumn("starts", starts)
        .select(*keys, F.explode(cuts).alias("x"))
        .select(*keys, "x.clause", "x.toks")
    )
    joined = F.array_join(F.transform("toks", lambda t: t["text"]), " ")
    return found.withColumn("text", tx.tighten_punctuation(joined))


def as_lemma_tags(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.struct(t["lemma"].alias("lemma"), t["tag"].alias("pos")))


def descriptive_clauses(found: DataFrame, black: Column) -> DataFrame:
    """Clauses with a noun and an adjective outside the blacklist."""
    pairs = as_lemma_tags(F.col("toks"))
    return found.where(tx.any_tagged(pairs, "NOUN", black) & tx.any_tagged(pairs, "ADJ", black))


def clause_nouns(found: DataFrame, stop: Column) -> DataFrame:
    """One row per noun of a clause; clauses without a noun fall out."""
    return found.withColumn("noun", F.explode(tx.tagged_lemmas(as_lemma_tags(F.col("toks")), "NOUN", stop)))


def noun_counts(found: DataFrame, stop: Column, at_least: int = 1) -> DataFrame:
    return clause_nouns(found, stop).groupBy("noun").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def texts_per_noun(found: DataFrame, stop: Column, key: str, text: str, part_rows: int) -> DataFrame:
    """noun, part, n, joined: the texts of a noun's clauses in the order of ``key``, in parts
    (see :func:`opinara.operators.tables.ordered_text`).

    Clauses are dealt by part before they are repeated for each of their nouns."""
    part = F.floor(F.col(key) / part_rows).cast("long")
    nouns = tx.tagged_lemmas(as_lemma_tags(F.col("toks")), "NOUN", stop)
    rows = found.select(key, text, nouns.alias("nouns")).where(F.size("nouns") > 0).withColumn("part", part).repartition("part")
    return tb.ordered_text(rows.select(key, text, "part", F.explode("nouns").alias("noun")), ["noun", "part"], key, text, ". ")


def adjectives_per_noun(found: DataFrame, stop: Column, at_least: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """How often an adjective occurs in the clauses of a noun."""
    adj = F.transform(F.filter("toks", lambda t: (t["tag"] == "ADJ") & (F.length(F.lower(t["lemma"])) > 1)), lambda t: F.lower(t["lemma"]))
    nouns = tx.tagged_lemmas(as_lemma_tags(F.col("toks")), "NOUN", stop)
    # pairs are made inside the row: an exploded noun would take the whole clause along
    rows = found.select(*extra, nouns.alias("nouns"), adj.alias("adjs"))
    both = F.flatten(F.transform("nouns", lambda n: F.transform("adjs", lambda a: F.struct(n.alias("noun"), a.alias("adj")))))
    pairs = rows.select(*extra, F.explode(both).alias("x")).select(*extra, "x.*")
    counts = pairs.groupBy(*extra, "noun", "adj").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= at_least)


def key_phrases(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases of a noun or verb and the adjectives and adverbs that follow it.

    Small words (ADP, CCONJ, SCONJ, PART) inside a phrase are passed over; any
    other tag ends it.  Phrases have two words or more."""
    words = tokens.where(~F.col("tag").isin("PUNCT", "SPACE"))
    start = F.col("tag").isin("NOUN", "VERB")
    follow = F.col("tag").isin("ADJ", "ADV")
    breaks = ~(start | follow | F.col("tag").isin("ADP", "CCONJ", "SCONJ", "PART"))
    order = W.partitionBy(*keys).orderBy("pos")
    run = words.withColumn("run", F.sum(start.cast("int")).over(order))
    inside = W.partitionBy(*keys, "run").orderBy("pos")
    kept = run.withColumn("cut", F.sum(breaks.cast("int")).over(inside)).where(
        (F.col("run") > 0) & (F.col("cut") == 0) & (start | follow)
    )
    phrases = kept.groupBy(*keys, "run").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return phrases.where(F.size("p") > 1).select(
        *keys, "run", F.array_join(F.transform("p", lambda t: t["text"]), " ").alias("phrase")
    ).where(F.length(F.trim("phrase")) > 2)


# --- words around an aspect --------------------------------------------------------


def _ancestors(tk: Column) -> Column:
    """For each position of a sentence the positions above it, nearest first in a tree.

    ``up`` holds the nearest 2^r positions above, ``far`` the 2^r-th of them, where the next
    as many begin: log2(n) rounds, each of which appends one list to another."""
    none = F.lit(None).cast("int")
    first = F.transform(tk, lambda t: F.when(t["head"] == t["pos"], F.struct(F.array().cast("array<int>").alias("up"), none.alias("far"))).otherwise(
        F.struct(F.array(t["head"].cast("int")).alias("up"), t["head"].cast("int").alias("far"))))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(tk) + 1)).cast("int") + 1)
    more = lambda acc: F.transform(acc, lambda a: F.when(a["far"].isNull(), a).otherwise(F.struct(
        F.array_distinct(F.concat(a["up"], F.get(acc, a["far"])["up"])).alias("up"), F.get(acc, a["far"])["far"].alias("far"))))
    # a flat tree is done after few rounds
    step = lambda acc: F.when(F.exists(acc, lambda a: a["far"].isNotNull()), more(acc)).otherwise(acc)
    return F.transform(F.aggregate(rounds, first, lambda acc, _: step(acc)), lambda a: a["up"])


def related_words(tokens: DataFrame | Annotated, targets: DataFrame, keys: list[str], skip: Column,
                  negation: str = "не") -> DataFrame:
    """Adjectives and verbs below and above the target tokens of a sentence.

    ``targets`` has the keys and ``target`` (a position).  Words in ``skip`` stay
    out; a word under the negation particle also counts as ``<particle>_<lemma>``.
    """
    wanted = targets.select(*keys, "target").distinct().groupBy(*keys).agg(
        F.sort_array(F.collect_list("target")).alias("targets")
    )
    tk, up = F.col("tk"), F.col("up")
    told = lambda o: o["tag"].isin("ADJ", "ADV", "VERB")

    def link(t, below, o):
        return F.struct(t.alias("target"), F.lit(below).alias("below"), o.alias("o"), F.get(tk, o["head"]).alias("p"))

    # a word looks for targets among the few positions above it, no target goes over all words
    above = lambda o: F.coalesce(F.array_remove(F.array_intersect(F.get(up, o["pos"]), F.col("targets")), o["pos"]), F.array().cast("array<int>"))
    under = F.flatten(F.transform(F.filter(tk, told), lambda o: F.transform(above(o), lambda t: link(t, True, o))))
    over = F.flatten(F.transform("targets", lambda t: F.transform(
        F.filter(F.transform(F.array_remove(F.get(up, t), t), lambda i: F.get(tk, i)), told), lambda o: link(t, False, o))))
    hits = (
        _sentence_rows(tokens, keys, wanted)
        .withColumn("up", _ancestors(tk))
        .select(*keys, F.explode(F.concat(under, over)).alias("x"))
        .select(*keys, "x.*")
    )
    plain = F.when(
        F.col("o.tag").isin("ADJ", "VERB") & ~F.array_contains(skip, F.col("o.lemma"))
        & (F.lower("o.text") != negation), F.col("o.lemma"))
    negated = F.when(
        F.col("below") & (F.lower("p.text") == negation) & (F.col("p.pos") != F.col("target"))
        & F.col("o.tag").isin("ADJ", "ADV", "VERB"), F.concat(F.lit(f"{negation}_"), F.col("o.lemma")))
    return hits.select(
        *keys, "target", F.col("o.pos").alias("pos"), F.explode(F.array_compact(F.array(plain, negated))).alias("word")
    )


# --- keyphrases ---------------------------------------------------------------------


def term_features(sentences: DataFrame, stop: DataFrame, key: str = "id") -> DataFrame:
    """Per text and word the statistics of the published unsupervised keyphrase
    method YAKE: casing, position, frequency, relatedness, dispersion, score."""
    # sentences are dealt by text once, so that neither words nor their statistics are shuffled
    dealt = sentences.select(key, "spos", "sentence").where(F.col(key).isNotNull()).repartition(key)
    w = F.col("w")
    beside = F.arrays_zip(w.alias("raw"), F.concat(F.array(F.lit(None).cast("string")), w).alias("left"),
                          F.slice(w, 2, F.size(w)).alias("right"))
    toks = dealt.select(key, "spos", F.regexp_extract_all("sentence", F.lit(tx.WORD), F.lit(0)).alias("w")).where(
        F.size("w") > 0).select(key, "spos", F.posexplode(beside).alias("i", "x")).where(F.col("x.raw").isNotNull())
    toks = toks.select(key, "spos", "i", "x.raw", F.lower("x.raw").alias("word"), F.lower("x.left").alias("left"),
                       F.lower("x.right").alias("right")).join(checked_small(cut(stop.select("word"))), "word", "left_anti")
    upper = (F.upper("raw") == F.col("raw")) & (F.length("raw") > 1) & F.col("raw").rlike(r"\p{L}")
    capital = F.col("raw").rlike(r"^\p{Lu}") & (F.col("i") > 0) & ~upper
    per = toks.groupBy(key, "word").agg(
        F.count("*").alias("tf"),
        F.sum(upper.cast("int")).alias("ups"), F.sum(capital.cast("int")).alias("caps"),
        F.median("spos").alias("mid"),
        # sets are bounded by one text; distinct counts would triple the rows instead
        F.size(F.collect_set("spos")).cast("long").alias("n_sent"),
        F.count("left").alias("nl"), F.size(F.collect_set("left")).cast("long").alias("dl"),
        F.count("right").alias("nr"), F.size(F.collect_set("right")).cast("long").alias("dr"),
    )
    doc = W.partitionBy(key)
    per = per.withColumns({
        "mean_tf": F.avg("tf").over(doc), "std_tf": F.stddev_pop("tf").over(doc), "max_tf": F.max("tf").over(doc)})
    size = sentences.groupBy(key).agg(F.count("*").alias("sents"))
    rel = 1 + (F.coalesce(F.try_divide("dl", "nl"), F.lit(0.0)) + F.coalesce(F.try_divide("dr", "nr"), F.lit(0.0))) * (
        F.col("tf") / F.col("max_tf"))
    joined = per.join(size, key).withColumns({
        "casing": F.greatest("ups", "caps") / (1 + F.log("tf")),
        "position": F.log(F.log(F.lit(3) + F.col("mid"))),
        "frequency": F.col("tf") / (F.col("mean_tf") + F.col("std_tf")),
        "relatedness": rel,
        "dispersion": F.col("n_sent") / F.col("sents"),
    })
    score = F.col("relatedness") * F.col("position") / (
        F.col("casing") + F.col("frequency") / F.col("relatedness") + F.col("dispersion") / F.col("relatedness"))
    return joined.select(key, "word", "tf", "casing", "position", "frequency", "relatedness", "dispersion",
                         score.alias("score"))


def keyphrases(sentences: DataFrame, stop: DataFrame, key: str = "id", n: int = 3, top: int = 50,
               dedup: float = 0.9) -> DataFrame:
    """The ``top`` phrases of up to ``n`` words per text, best (lowest) score first.
    A phrase too close in edit distance to a better one falls out."""
    feats = term_features(sentences, stop, key)
    # a word meets its score in a window over both, dealt by text: a join on text and word would
    # deal them anew, and the phrases made from them once more
    words = sentences.select(key, "spos", F.posexplode(tx.term_list(F.col("sentence"))).alias("i", "word"), F.lit(None).cast("double").alias("score"))
    blank = F.lit(None).cast("int")
    both = words.unionByName(feats.select(key, blank.alias("spos"), blank.alias("i"), "word", "score")).where(F.col(key).isNotNull()).repartition(key)
    score = F.max("score").over(W.partitionBy(key, "word"))
    scored = both.select(key, "spos", "i", "word", score.alias("score")).where("i IS NOT NULL AND score IS NOT NULL")
    order = W.partitionBy(key, "spos").orderBy("i")
    grams = scored.select(
        key, "i",
        F.collect_list(F.struct("i", "word", "score")).over(order.rowsBetween(0, n - 1)).alias("g"))
    ks = F.sequence(F.lit(1), F.size("g"))
    grams = grams.select(key, "g", F.explode(ks).alias("k")).where(
        F.get("g", F.col("k") - 1)["i"] == F.get("g", F.lit(0))["i"] + F.col("k") - 1)
    part = F.slice("g", 1, F.col("k"))
    phrase = F.array_join(F.transform(part, lambda t: t["word"]), " ")
    stats = grams.groupBy(key, phrase.alias("phrase")).agg(
        F.count("*").alias("tf"),
        F.first(F.aggregate(part, F.lit(1.0), lambda a, t: a * t["score"])).alias("prod"),
        F.first(F.aggregate(part, F.lit(0.0), lambda a, t: a + t["score"])).alias("total"))
    ranked = stats.withColumn("score", F.round(F.col("prod") / (F.col("tf") * (1 + F.col("total"))), 9))
    cand = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("score", "phrase"))).alias("c"))
    longest = lambda a, b: F.greatest(F.length(a["phrase"]), F.length(b["phrase"]))
    near = lambda acc, c: F.exists(
        acc, lambda a: 1 - F.levenshtein(a["phrase"], c["phrase"]) / longest(a, c) > dedup)
    none = F.array().cast("array<struct<score:double,phrase:string>>")
    kept = F.aggregate("c", none, lambda acc, c: F.when(
        (F.size(acc) >= top) | near(acc, c), acc).otherwise(F.array_append(acc, c)))
    return cand.select(key, F.posexplode(kept).alias("rank", "k")).select(
        key, "rank", F.col("k.phrase").alias("phrase"), F.col("k.score").alias("score"))


# --- spelling -------------------------------------------------------------------------


def corrections(vocabulary: DataFrame, rare: int = 2, ratio: int = 10) -> DataFrame:
    """word -> suggestion for rare words with a far more frequent word one edit away.

    Words meet on keys with one letter deleted.  Only words of at most ``rare``
    occurrences ask and only words of at least ``ratio`` answer, and a key keeps only its
    most frequent answer, so no pairs are formed: a substitution shares (position, rest),
    an insertion or deletion makes one word the other's rest.
    """
    v = vocabulary.select("word", "n").where((F.length("word") > 1) & (F.col("n") >= 1))
    asked, answers = v.where(F.col("n") <= rare), v.where(F.col("n") >= ratio)

    def cuts(words):
        each = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
        return each.withColumn("rest", F.concat(F.substr("word", F.lit(1), F.col("at") - 1), F.substr("word", F.col("at") + 1)))

    best = F.max(F.struct("n", "word")).alias("b")
    open_, given = cuts(asked), cuts(answers)
    # frequent words are far fewer than rare ones: hashed, they need no sort of the askers' keys
    changed = open_.join(given.groupBy("at", "rest").agg(best).hint("shuffle_hash"), ["at", "rest"]).select("word", "n", "b")
    longer = asked.join(given.groupBy(F.col("rest").alias("word")).agg(best).hint("shuffle_hash"), "word").select("word", "n", "b")
    shorter = open_.join(answers.select(F.col("word").alias("rest"), F.struct("n", F.col("word")).alias("b")).hint("shuffle_hash"), "rest").select(
        "word", "n", "b")
    found = changed.unionByName(longer).unionByName(shorter).where(F.col("b.n") >= F.col("n") * ratio)
    return found.groupBy("word").agg(F.max("b").alias("b")).select("word", F.col("b.word").alias("suggestion"))


def correct_texts(texts: DataFrame, fixes: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, corrected text for the texts a correction changes; spacing is kept.  A text meets its
    own corrections as one map and is put together where it stands, so its parts are no rows.
    Rows that share a key are one text, their parts in turn."""
    word_or_gap = rf"{tx.WORD}|[^\p{{L}}\p{{N}}_]+"
    said = texts.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text"))
    several = cut(said.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0)), F.lower))
    fix = fixes.groupBy("word").agg(F.max("suggestion").alias("suggestion")).where("suggestion IS NOT NULL")
    # the corrections are the small side: hashed, they need no sort of the words or texts that meet them
    met = said.select(key, F.explode(words).alias("word")).join(fix.hint("shuffle_hash"), "word")
    found = cut(met.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "suggestion"))).alias("fix")))
    corrected = lambda t: F.transform(F.regexp_extract_all(t, F.lit(word_or_gap), F.lit(0)), lambda p: F.coalesce(F.try_element_at("fix", F.lower(p)), p))
    lone = said.join(several, key, "left_anti").join(found.hint("shuffle_hash"), key).select(key, corrected(F.col("text")).alias("p"))
    shared = said.join(several, key, "left_semi").where("text IS NOT NULL").join(found, key).groupBy(key).agg(F.collect_list("text").alias("said"), F.first("fix").alias("fix"))
    placed = F.transform("said", lambda t: F.transform(corrected(t), lambda p, i: F.struct(i.alias("i"), p.alias("p"))))
    shared = shared.select(key, F.transform(F.sort_array(F.flatten(placed)), lambda x: x["p"]).alias("p"))
    return lone.unionByName(shared).select(key, F.array_join("p", "").alias("corrected_text"))
