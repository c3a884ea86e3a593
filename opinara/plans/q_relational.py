"""Projections, filters, joins, aggregates, windows, sorting, set operations."""

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opinara.functions import text as tx
from opinara.operators import aspects as asp
from opinara.operators import phrases as ph
from opinara.operators import tables as tb
from opinara.operators import textflow as tf
from opinara.plans.registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def r6(c):
    return F.round(c, 6)


# --- projections and filters -----------------------------------------------------------


@query("p1_column_subset", "SELECT url, id, rating FROM reviews")
def _(t):
    return t.reviews.select("url", "id", "rating")


@query("p2_drop_columns", "SELECT * EXCLUDE (l_shipdate, l_returnflag, l_linestatus, l_extendedprice) FROM lineitem")
def _(t):
    return tb.drop_matching(t.lineitem.drop("l_extendedprice"), r"^l_(ship|return|linest)")


@query("p3_rename_abbreviated", "SELECT l_orderkey, l_linenumber, l_shipdate IS NOT NULL AS lsh, l_suppkey AS lsu FROM lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").isNotNull().alias("l_sh"), F.col("l_suppkey").alias("l_su"))
    return tb.rename_abbreviated(df, ["l_sh", "l_su"]).withColumnsRenamed({tb.abbreviate("l_sh"): "lsh", tb.abbreviate("l_su"): "lsu"})


@query("p4_numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(t):
    return t.part.select(*tb.numeric_columns(t.part))


@query("p5_category_filter", "SELECT id, category FROM reviews WHERE category IN ('en', 'fr')")
def _(t):
    return asp.in_categories(t.reviews, ["en", "fr"]).select("id", "category")


@query("p6_range_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.04 AND l_tax < 0.02")
def _(t):
    return t.lineitem.where((F.col("l_discount") > 0.04) & (F.col("l_tax") < 0.02)).select("l_orderkey", "l_linenumber")


@query("p7_equality_filter", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 0.7")
def _(t):
    return t.events.where((F.col("event_type") == "purchase") & (F.col("value") > 0.7)).select("event_id", "value")


@query("p8_drop_blank", r"SELECT id FROM reviews WHERE length(trim(regexp_replace(text, '[^\p{L}]', '', 'g'))) > 0")
def _(t):
    return t.reviews.where(F.length(F.trim(F.regexp_replace("text", r"[^\p{L}]", ""))) > 0).select("id")


@query("p9_several_words", r"SELECT id, spos FROM sentences WHERE len(regexp_extract_all(sentence, '[\p{L}\p{N}_]+')) > 1")
def _(t):
    return t.sentences.where(tx.has_several_words(F.col("sentence"))).select("id", "spos")


@query("p10_result_filter", r"""SELECT id, spos FROM sentences WHERE length(sentence) > 5
    AND len(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')) > 10""")
def _(t):
    s = F.col("sentence")
    return t.sentences.where((tx.count_words(s) > 10) & (F.length(s) > 5)).select("id", "spos")


@query("p11_drop_any_null", "SELECT d.doc_id, quality FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").dropna("any").select("doc_id", "quality")


@query("p12_head_slice", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY ALL LIMIT 3000")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return df.orderBy(*df.columns).limit(3000)


@query("p13_zero_one_columns", """SELECT * FROM (SELECT 'quality' AS name, min(quality) lo, max(quality) hi FROM labels UNION ALL
    SELECT 'toxic', min(toxic), max(toxic) FROM labels UNION ALL SELECT 'doc_id', min(doc_id), max(doc_id) FROM labels)
    WHERE lo = 0 AND hi = 1""".replace("SELECT * FROM (", "SELECT name FROM (", 1))
def _(t):
    return tb.zero_one_columns(t.labels, ["quality", "toxic", "doc_id"])


@query("p14_exclude_noise", "SELECT id, product - 1 AS cluster FROM vectors WHERE product - 1 >= 0")
def _(t):
    return t.vectors.select("id", (F.col("product") - 1).alias("cluster")).where("cluster >= 0")


@query("p15_value_replacement", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", "o_orderstatus").replace({"F": "done", "O": "open"}, subset=["o_orderstatus"])


@query("p16_conditional_overwrite", """SELECT d.doc_id, CASE WHEN l.toxic IS NOT NULL THEN 'product' ELSE d.source END AS aspect
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    df = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return df.select("doc_id", F.when(F.col("toxic").isNotNull(), "product").otherwise(F.col("source")).alias("aspect"))


@query("p17_changed_rows", r"SELECT id FROM reviews WHERE text IS DISTINCT FROM trim(regexp_replace(text, '\s+', ' ', 'g'))")
def _(t):
    return t.reviews.where(~F.col("text").eqNullSafe(tx.collapse(F.col("text")))).select("id")


@query("p18_first_non_null", "SELECT d.doc_id, coalesce(l.quality, d.n_chars) AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("long"), "n_chars").alias("v"))


@query("p19_sentiment_rows", """SELECT category, product, count(*) AS n FROM reviews WHERE rating IN (4, 5) GROUP BY ALL""")
def _(t):
    return t.reviews.where(tx.rating_class(F.col("rating")) == "positive").groupBy("category", "product").agg(F.count("*").alias("n"))


@query("p20_null_filter", """SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.quality IS NULL OR l.toxic IS NOT NULL""")
def _(t):
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return df.where(F.col("quality").isNull() | F.col("toxic").isNotNull()).select("doc_id", F.col("quality").isNull().alias("unlabelled"))


# --- joins ---------------------------------------------------------------------------------


@query("j1_left_equi", """SELECT r.id, s.joined FROM reviews r LEFT JOIN (SELECT id, string_agg(sentence, ' ' ORDER BY spos) AS joined
    FROM sentences WHERE length(sentence) > 20 GROUP BY id) s ON r.id = s.id""")
def _(t):
    joined = tb.ordered_text(t.sentences.where(F.length("sentence") > 20), ["id"], "spos", "sentence", " ")
    return t.reviews.select("id").join(joined.select("id", "joined"), "id", "left")


@query("j3_semi", "SELECT id FROM reviews WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    return t.reviews.select("id").join(good, "id", "left_semi")


@query("j4_anti", "SELECT id FROM reviews WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    return t.reviews.select("id").join(good, "id", "left_anti")


@query("j5_keyed_bind", """SELECT r.id, length(r.text) AS n_text, l.toxic FROM reviews r JOIN labels l ON l.doc_id = r.id""")
def _(t):
    sizes = t.reviews.select("id", F.length("text").cast("long").alias("n_text"))
    return sizes.join(t.labels.select(F.col("doc_id").alias("id"), "toxic"), "id")


@query("j6_apply_by_id", """SELECT d.doc_id AS id, coalesce(CASE WHEN l.quality = 0 THEN 'fixed ' || d.source END, d.source) AS text
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    fixes = t.labels.where("quality = 0").join(t.documents.select("doc_id", "source"), "doc_id").select(
        "doc_id", F.concat(F.lit("fixed "), "source").alias("corrected"))
    return t.documents.select("doc_id", "source").join(fixes, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.coalesce("corrected", "source").alias("text"))


@query("j9_parent_token", """SELECT c.id, c.spos, c.pos, c.text, p.text AS parent FROM tokens c JOIN tokens p
    ON p.id = c.id AND p.spos = c.spos AND p.pos = c.head WHERE c.pos <> c.head""")
def _(t):
    return tf.parent_texts(t.annotated, ["id", "spos"])


@query("j10_word_dictionary", """SELECT id, spos, wpos, word FROM words WHERE word NOT IN (SELECT word FROM stop_words)""")
def _(t):
    return t.words.join(t.stop_words, "word", "left_anti").select("id", "spos", "wpos", "word")


@query("j11_sentence_contains", """SELECT DISTINCT w.id, l.term, s.spos FROM words w JOIN lexicon l ON l.term = w.word
    JOIN sentences s ON s.id = w.id AND contains(lower(s.sentence), l.term)""")
def _(t):
    terms = t.words.join(t.lexicon, F.col("word") == F.col("term")).select("id", "term").distinct()
    return terms.join(t.sentences.select("id", "spos", "sentence"), "id").where(
        F.contains(F.lower("sentence"), "term")).select("id", "term", "spos")


@query("j11_sentence_phrases", "SELECT id, spos, term, count(*) AS n FROM occurrence GROUP BY ALL")
def _(t):
    terms = ph.lemma_terms(t.phrase_lexicon.select("term"), t.tokens)
    return ph.occurrences(t.tokens, terms, ["id", "spos"]).groupBy("id", "spos", "term").agg(F.count("*").alias("n"))


# --- aggregates ------------------------------------------------------------------------------


@query("a1_value_counts", "SELECT category, count(*) AS n FROM reviews WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category")
def _(t):
    return tb.value_counts(t.reviews, "category").orderBy(F.desc("n"), "category")


@query("a2_element_counts", "SELECT word AS item, count(*) AS n FROM words GROUP BY word")
def _(t):
    return tb.element_counts(t.sentences, tx.term_list(F.col("sentence")))


@query("a3_group_text", """SELECT product, id // 1000 AS part, count(*) AS n, string_agg(url, ' | ' ORDER BY id) AS joined FROM reviews GROUP BY ALL""")
def _(t):
    return tb.ordered_text(t.reviews, ["product"], "id", "url", " | ", part_rows=1000)


@query("a4_multi_sum", """SELECT category, product, count(*) AS n, CAST(sum(rating) AS BIGINT) AS rating, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM reviews GROUP BY ALL""")
def _(t):
    return t.reviews.groupBy("category", "product").agg(
        F.count("*").alias("n"), F.sum("rating").alias("rating"), F.sum(F.length("text")).alias("chars"))


@query("a5_ratios", """SELECT category, round(p / nullif(n, 0), 6) AS positive_ratio, round(p / nullif(n - p, 0), 6) AS odds FROM (
    SELECT category, count(*) AS n, count(*) FILTER (rating >= 4) AS p FROM reviews GROUP BY ALL)""")
def _(t):
    g = t.reviews.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("rating") >= 4).alias("p"))
    return g.select("category", r6(F.try_divide("p", "n")).alias("positive_ratio"),
                    r6(F.try_divide("p", F.col("n") - F.col("p"))).alias("odds"))


@query("a6_mixed_aggregation", """SELECT r.id, r.rating, r.product, min_by(s.sentence, s.spos) AS first_sentence,
    string_agg(s.sentence, ' / ' ORDER BY s.spos) AS all_sentences, round(avg(length(s.sentence)), 6) AS mean_len
    FROM reviews r JOIN sentences s ON s.id = r.id GROUP BY ALL""")
def _(t):
    g = t.sentences.groupBy("id", "rating", "product").agg(
        F.min_by("sentence", "spos").alias("first_sentence"),
        F.sort_array(F.collect_list(F.struct("spos", "sentence"))).alias("x"), F.avg(F.length("sentence")).alias("m"))
    return g.select("id", "rating", "product", "first_sentence",
                    F.array_join(F.transform("x", lambda s: s["sentence"]), " / ").alias("all_sentences"), r6(F.col("m")).alias("mean_len"))


@query("a8_map_totals", "SELECT event_type AS key, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def _(t):
    per_user = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return tb.map_totals(per_user, F.col("m")).select("key", F.round("total", 3).alias("total"))


@query("a9_distinct", "SELECT category, count(DISTINCT product) AS products FROM reviews GROUP BY category")
def _(t):
    return t.reviews.select("category", "product").distinct().groupBy("category").agg(F.count("*").alias("products"))


@query("a10_drop_duplicates", "SELECT DISTINCT text FROM documents")
def _(t):
    return t.documents.select("text").dropDuplicates()


@query("a11_set_union", """SELECT product, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT product, category FROM reviews)
    GROUP BY product""")
def _(t):
    lists = t.reviews.groupBy("product", "rating").agg(F.collect_set("category").alias("c"))
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("c"))))
    return lists.groupBy("product").agg(F.array_join(union, ",").alias("categories"))


def describe_sql(table, cols):
    return " UNION ALL ".join(f"""SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(CAST(min({c}) AS DOUBLE), 6) AS lo, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q2,
        round(quantile_cont({c}, 0.75), 6) AS q3, round(CAST(max({c}) AS DOUBLE), 6) AS hi FROM {table}""" for c in cols)


def rounded(df):
    return df.select("name", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "lo", "q1", "q2", "q3", "hi")])


@query("a12_describe", describe_sql("lineitem", NUM))
def _(t):
    return rounded(tb.describe(t.lineitem, NUM))


@query("a13_long_texts", """SELECT id, length(text) AS n_chars FROM reviews WHERE length(text) >= (SELECT quantile_cont(length(text), 0.75) FROM reviews)""")
def _(t):
    sized = t.reviews.select("id", F.length("text").cast("long").alias("n_chars"))
    q = tb.exact_quantiles(sized, ["n_chars"], [0.75]).select("value")
    return sized.where(F.col("n_chars") >= q.scalar())


@query("a14_size_deviation", """SELECT round(stddev_pop(n), 6) AS pop, round(stddev_samp(n), 6) AS samp FROM (SELECT product, count(*) AS n FROM vectors GROUP BY 1)""")
def _(t):
    return tb.value_counts(t.vectors, "product").agg(r6(F.stddev_pop("n")).alias("pop"), r6(F.stddev_samp("n")).alias("samp"))


@query("a15_top_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in combinations(NUM, 2)))
def _(t):
    return tb.top_correlations(t.lineitem, NUM, 50).select("a", "b", r6(F.col("r")).alias("r"))


@query("a16_common_feature", """SELECT lemma, feature, value FROM (SELECT lemma, feature, value,
    row_number() OVER (PARTITION BY lemma, feature ORDER BY count(*) DESC, value) AS rk FROM (
        SELECT lemma, 'tag' AS feature, tag AS value FROM tokens UNION ALL SELECT lemma, 'rel', rel FROM tokens)
    GROUP BY lemma, feature, value) WHERE rk = 1""")
def _(t):
    long = t.tokens.unpivot(["lemma"], ["tag", "rel"], "feature", "value")
    counts = long.groupBy("lemma", "feature", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("lemma", "feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


@query("a19_conditional_counts", """SELECT count(l_quantity) AS l_quantity, count(l_discount) AS l_discount, count(l_tax) AS l_tax
    FROM lineitem WHERE l_quantity < 15""")
def _(t):
    return t.lineitem.where("l_quantity < 15").agg(*[F.count(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])


@query("a20_merge_clusters", """SELECT rating AS label, id // 1000 AS part, string_agg(url, ' ' ORDER BY id) AS members, min(id) AS first_id,
    min_by(url, id) AS thought, CAST(sum(length(text)) AS BIGINT) AS size, count(*) AS total FROM reviews GROUP BY ALL""")
def _(t):
    base = t.reviews.groupBy(F.col("rating").alias("label"), F.floor(F.col("id") / 1000).alias("part"), "product").agg(
        F.collect_list(F.struct("id", "url")).alias("x"), F.min("id").alias("i"), F.min_by("url", "id").alias("u"),
        F.sum(F.length("text")).alias("s"))
    merged = base.groupBy("label", "part").agg(
        F.sort_array(F.flatten(F.collect_list("x"))).alias("x"), F.min("i").alias("first_id"),
        F.min_by("u", "i").alias("thought"), F.sum("s").alias("size"))
    return merged.select("label", "part", F.array_join(F.transform("x", lambda e: e["url"]), " ").alias("members"),
                         "first_id", "thought", "size", F.size("x").cast("long").alias("total"))


# --- windows -----------------------------------------------------------------------------------


@query("w1_first_rows", "SELECT product, id FROM (SELECT product, id, row_number() OVER (PARTITION BY product ORDER BY id) AS rk FROM reviews) WHERE rk <= 5")
def _(t):
    return tb.first_per(t.reviews.select("product", "id"), ["product"], [F.asc("id")], 5).select("product", "id")


@query("w2_lag_difference", """SELECT k, round(v, 4) AS v, round(v - lag(v) OVER (ORDER BY k), 4) AS diff FROM (
    SELECT l_linenumber AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)""")
def _(t):
    # one row per line number (a handful), as one row per k in the inertia table
    per_k = t.lineitem.groupBy(F.col("l_linenumber").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return per_k.select("k", F.round("v", 4).alias("v"), F.round(F.col("v") - F.lag("v").over(W.orderBy("k")), 4).alias("diff"))


@query("w3_top_phrases", """SELECT category, sentiment, word, n FROM (SELECT category, sentiment, word, n,
    row_number() OVER (PARTITION BY category, sentiment ORDER BY n DESC, word) AS rk FROM (
        SELECT s.category, CASE WHEN s.rating >= 4 THEN 'positive' ELSE 'negative' END AS sentiment, w.word, count(*) AS n
        FROM words w JOIN sentences s ON s.id = w.id AND s.spos = w.spos GROUP BY ALL)) WHERE rk <= 10""")
def _(t):
    rows = t.sentences.select("category", tx.rating_class(F.col("rating")).alias("sentiment"), F.explode(tx.term_list(F.col("sentence"))).alias("word"))
    counts = rows.groupBy("category", "sentiment", "word").agg(F.count("*").alias("n"))
    return tb.first_per(counts, ["category", "sentiment"], [F.desc("n"), F.asc("word")], 10).drop("rk")


@query("w4_group_best", "SELECT product, max_by(id, (length(text), -id)) AS id FROM reviews GROUP BY product")
def _(t):
    return t.reviews.groupBy("product").agg(F.max_by("id", F.struct(F.length("text"), -F.col("id"))).alias("id"))


@query("w5_size_batches", """SELECT id, CAST(floor((sum(length(text)) OVER (ORDER BY id) - length(text)) / 10000) AS BIGINT) AS batch FROM reviews""")
def _(t):
    return tb.batch_numbers(t.reviews.select("id", "text"), "id", F.length("text"), 10000).select("id", "batch")


@query("w6_appearance_codes", """SELECT source, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS BIGINT) AS code, min(doc_id) AS first_at
    FROM documents GROUP BY source""")
def _(t):
    return tb.appearance_codes(t.documents, "source", "doc_id").select("source", F.col("code").cast("long").alias("code"), "first_at")


# --- order and limits ------------------------------------------------------------------------------


@query("o1_two_key_sort", "SELECT id, product, rating FROM reviews ORDER BY product, rating DESC, id")
def _(t):
    return t.reviews.select("id", "product", "rating").orderBy(F.asc("product"), F.desc("rating"), F.asc("id"))


@query("o2_sort_by_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey")


@query("o3_length_slice", "SELECT id, spos, sentence FROM sentences ORDER BY length(sentence), id, spos OFFSET 2000 LIMIT 100")
def _(t):
    return t.sentences.select("id", "spos", "sentence").orderBy(F.length("sentence"), "id", "spos").offset(2000).limit(100)


@query("o4_n_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o5_top_in_order", """SELECT conv_id, string_agg(role || turn, ' ' ORDER BY turn) AS picked FROM (SELECT *, row_number() OVER
    (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rk FROM conversations) WHERE rk <= 3 GROUP BY conv_id""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.concat("role", "turn").alias("label"), F.length("text").alias("n"))
    top = tb.first_per(rows, ["conv_id"], [F.desc("n"), F.asc("turn")], 3)
    return tb.ordered_text(top.drop("n"), ["conv_id"], "turn", "label", " ", name="picked").select("conv_id", "picked")


@query("o6_sort_scores", "SELECT product, count(*) AS score FROM vectors GROUP BY product ORDER BY score DESC, product")
def _(t):
    return t.vectors.groupBy("product").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "product")


# --- unions -------------------------------------------------------------------------------------------


@query("u1_union_groups", """SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL
    SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""")
def _(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind")))


@query("u2_union_phrases", """SELECT DISTINCT p FROM (SELECT p_type AS p FROM part UNION ALL SELECT p_brand FROM part UNION ALL
    SELECT c_mktsegment FROM customer)""")
def _(t):
    lists = t.part.select(F.col("p_type").alias("p")), t.part.select(F.col("p_brand").alias("p")), t.customer.select(F.col("c_mktsegment").alias("p"))
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).distinct()
