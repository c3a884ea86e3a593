"""Scalar functions on review texts, score maps and rating columns."""

from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.plans.registry import query

WORDS = r"[\p{L}\p{N}_]+"


def r6(c):
    return F.round(c, 6)


# Without lookaround, for texts in which no dot follows another.
@query("f1_clean_spacing", r"""SELECT id, rtrim(trim(regexp_replace(regexp_replace(text, '[\n\r\t]+|\s{2,}', ' ', 'g'), '\s*\.\s*', '. ', 'g')), '.') AS cleaned
    FROM reviews""")
def _(t):
    return t.reviews.select("id", tx.clean_spacing(F.col("text")).alias("cleaned"))


@query("f2_clean_markup", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<.*?>', '', 'g'), '\s+', ' ', 'g'))
    AS cleaned FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.clean_markup(F.col("html")).alias("cleaned"))


@query("f3_clean_breaks", r"SELECT id, trim(regexp_replace(text, '[\n\t\r]', ' ', 'g')) AS cleaned FROM reviews")
def _(t):
    return t.reviews.select("id", tx.clean_breaks(F.col("text")).alias("cleaned"))


@query("f4_remove_digits", r"SELECT o_orderkey AS id, regexp_replace(o_orderpriority, '\d+', '', 'g') AS cleaned FROM orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), tx.remove_emoji_and_digits(F.col("o_orderpriority")).alias("cleaned"))


@query("f5_preprocess_text", r"""SELECT r.id, array_to_string(list_filter(string_split_regex(
        lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')), '\s+'),
        lambda w: w <> '' AND NOT list_contains(s.stop, w)), ' ') AS processed
    FROM reviews r, (SELECT list(word) AS stop FROM stop_words) s""")
def _(t):
    stop = t.stop_words.agg(F.collect_list("word").alias("stop"))
    return t.reviews.withColumn("stop", stop.scalar()).select("id", tx.preprocess(F.col("text"), F.col("stop")).alias("processed"))


@query("f6_preprocess_category", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(url, '/', ' '),
    '\b[a-zA-Z]+\b', '', 'g'), '\s+', ' ', 'g')) AS category FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.preprocess_category(F.col("url")).alias("category"))


@query("f7_count_words", r"""SELECT id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n
    FROM reviews""")
def _(t):
    return t.reviews.select("id", tx.count_words(F.col("text")).alias("n"))


@query("f8_unique_words", r"""SELECT id, CAST(len(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))
    AS INTEGER) AS n FROM reviews""")
def _(t):
    return t.reviews.select("id", tx.count_unique_words(F.col("text")).alias("n"))


@query("f9_rating_class", """SELECT id, rating, CASE WHEN rating IN (4, 5) THEN 'positive' ELSE 'negative' END AS sentiment,
    rating > 3 AS high FROM reviews""")
def _(t):
    return t.reviews.select("id", "rating", tx.rating_class(F.col("rating")).alias("sentiment"), (F.col("rating") > 3).alias("high"))


@query("f10_rating_category", """SELECT category, product, round(s, 6) AS share,
    CASE WHEN s > 0.7 THEN 'positive' WHEN s > 0.5 THEN 'neutral' ELSE 'negative' END AS rating_category
    FROM (SELECT category, product, avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) AS s FROM reviews GROUP BY ALL)""")
def _(t):
    share = F.avg((F.col("rating") >= 4).cast("int"))
    return t.reviews.groupBy("category", "product").agg(share.alias("s")).select(
        "category", "product", r6(F.col("s")).alias("share"), tx.rating_category(F.col("s")).alias("rating_category"))


def scores(t):
    """Per user a map event_type -> summed value."""
    one = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return one.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "v")))).alias("m"))


SCORES = "(SELECT user_id, event_type, round(sum(value), 4) AS v FROM events GROUP BY ALL)"


@query("f11_best_label", f"""SELECT user_id, max_by(event_type, (v, event_type)) AS label,
    CASE WHEN coalesce(max(v) FILTER (event_type = 'purchase'), 0) > coalesce(max(v) FILTER (event_type = 'error'), 0)
        THEN 'positive' ELSE 'negative' END AS polarity FROM {SCORES} GROUP BY user_id""")
def _(t):
    val = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0))
    return scores(t).select("user_id", tx.best_label(F.col("m")).alias("label"),
                            tx.polarity(val("purchase"), val("error")).alias("polarity"))


@query("f12_map_columns", f"""SELECT user_id, round(max(v) FILTER (event_type = 'click'), 2) AS click_score,
    round(max(v) FILTER (event_type = 'view'), 2) AS view_score FROM {SCORES} GROUP BY user_id""")
def _(t):
    return scores(t).select("user_id", *[
        F.bround(F.try_element_at("m", F.lit(k)), 2).alias(f"{k}_score") for k in ("click", "view")])


@query("f13_zip_lists", """SELECT id, spos, string_agg(lemma || '/' || tag || '/' || rel, ' ' ORDER BY pos) AS raw
    FROM tokens GROUP BY id, spos""")
def _(t):
    lists = t.tokens.groupBy("id", "spos").agg(F.sort_array(F.collect_list(F.struct("pos", "lemma", "tag", "rel"))).alias("x"))
    lists = lists.select("id", "spos", *[F.col(f"x.{c}").alias(c) for c in ("lemma", "tag", "rel")])
    raw = F.transform(F.arrays_zip("lemma", "tag", "rel"), lambda z: F.concat_ws("/", z["lemma"], z["tag"], z["rel"]))
    return lists.select("id", "spos", F.array_join(raw, " ").alias("raw"))


def tagged(t):
    """Per sentence an array of (lemma, pos) with the stop words beside it."""
    stop = t.stop_words.agg(F.collect_list("word").alias("stop"))
    rows = t.tokens.groupBy("id", "spos").agg(F.sort_array(F.collect_list(F.struct("pos", "lemma", "tag"))).alias("x"))
    pairs = F.transform("x", lambda s: F.struct(s["lemma"].alias("lemma"), s["tag"].alias("pos")))
    return rows.select("id", "spos", pairs.alias("x")).withColumn("stop", stop.scalar())


@query("f14_any_tagged", """SELECT id, spos, coalesce(bool_or(tag = 'NOUN' AND lemma NOT IN (SELECT word FROM stop_words)), false) AS has_noun
    FROM tokens GROUP BY id, spos""")
def _(t):
    return tagged(t).select("id", "spos", tx.any_tagged(F.col("x"), "NOUN", F.col("stop")).alias("has_noun"))


@query("f15_tagged_lemmas", r"""SELECT id, spos, coalesce(string_agg(lemma, ' ' ORDER BY pos) FILTER (tag = 'NOUN'
        AND lemma NOT IN (SELECT word FROM stop_words) AND NOT regexp_matches(lemma, '\d|[[:punct:]]')), '') AS nouns
    FROM tokens GROUP BY id, spos""")
def _(t):
    return tagged(t).select("id", "spos", F.array_join(tx.tagged_lemmas(F.col("x"), "NOUN", F.col("stop")), " ").alias("nouns"))


@query("f16_list_to_text", r"SELECT id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS terms FROM reviews")
def _(t):
    return t.reviews.select("id", F.array_join(tx.term_list(F.col("text")), " ").alias("terms"))


@query("f17_glue_negation", r"SELECT id, regexp_replace(text, '(?i)(\sla)\s', '\1', 'g') AS glued FROM reviews")
def _(t):
    return t.reviews.select("id", tx.glue_negation(F.col("text"), "la").alias("glued"))


@query("f18_tighten_punctuation", r"""SELECT id, regexp_replace(replace(text, '.', ' .'), '\s([?.!,;:"](?:\s|$))', '\1', 'g') AS tight FROM reviews""")
def _(t):
    return t.reviews.select("id", tx.tighten_punctuation(F.replace("text", F.lit("."), F.lit(" ."))).alias("tight"))


@query("f19_capitalise", "SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS name FROM part")
def _(t):
    return t.part.select("p_partkey", tx.capitalise(F.col("p_name")).alias("name"))


@query("f20_parse_list", "SELECT p_partkey, p_name || '+' || p_brand || '+' || p_type AS items FROM part")
def _(t):
    stored = F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_brand", F.lit('\', "'), "p_type", F.lit('"]'))
    return t.part.select("p_partkey", F.array_join(tx.parse_list(stored), "+").alias("items"))


@query("f21_ordered_unique", r"""SELECT id, string_agg(w, ' ' ORDER BY p) AS uniq FROM (SELECT id, word AS w, min(spos * 1000000::BIGINT + wpos) AS p
    FROM words GROUP BY id, word) GROUP BY id""")
def _(t):
    return t.reviews.select("id", F.array_join(F.array_distinct(tx.term_list(F.col("text"))), " ").alias("uniq")).where("uniq <> ''")


@query("f22_apply_suggestions", """SELECT id, 'XX' || substr(text, 3, 5) || '<' || substr(text, 8, 2) || '>' || substr(text, 10) AS fixed
    FROM reviews WHERE length(text) >= 12""")
def _(t):
    sug = F.array(F.struct(F.lit(0).alias("pos"), F.lit(2).alias("len"), F.lit("XX").alias("text")),
                  F.struct(F.lit(7).alias("pos"), F.lit(2).alias("len"),
                           F.concat(F.lit("<"), F.substring("text", 8, 2), F.lit(">")).alias("text")))
    return t.reviews.where(F.length("text") >= 12).select("id", tx.apply_suggestions(F.col("text"), sug).alias("fixed"))


@query("f23_percent_text", """SELECT o_orderkey, CASE WHEN c = 0 THEN 'No change' ELSE printf('%.2f%%', c * 100) END AS change FROM (
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.05 WHEN 'O' THEN -0.05 ELSE 0.0 END AS c FROM orders)""")
def _(t):
    c = F.when(F.col("o_orderstatus") == "F", 0.05).when(F.col("o_orderstatus") == "O", -0.05).otherwise(0.0)
    return t.orders.select("o_orderkey", tx.percent_text(c).alias("change"))


@query("f24_sentence_template", """SELECT id, 'Aspect ''' || product || ''' is rated by customers '
    || CASE WHEN rating > 3 THEN 'mostly positively' ELSE 'mostly negatively' END || '.'
    || CASE WHEN rating <> 3 THEN ' Customers most often mention these traits: ' || category || ', ' || url || '.' ELSE '' END
    || ' For example: «' || url || '».' AS description FROM reviews""")
def _(t):
    traits = F.when(F.col("rating") != 3, F.array("category", "url")).otherwise(F.array().cast("array<string>"))
    return t.reviews.select("id", tx.contextual_description(
        F.col("product"), traits, F.col("rating"), F.lit(3), F.col("url")).alias("description"))


@query("f25_word_chunks", r"""SELECT id, CAST(c AS INTEGER) AS cpos, array_to_string(w[c * 50 + 1 : c * 50 + 50], ' ') AS chunk FROM (
    SELECT id, w, unnest(range(0, (len(w) + 49) // 50)) AS c FROM (SELECT id, list_filter(string_split_regex(text, '\s+'),
        lambda x: x <> '') AS w FROM reviews))""")
def _(t):
    return t.reviews.select("id", F.posexplode(tx.word_chunks(F.col("text"), 50)).alias("cpos", "chunk"))


@query("f26_drop_repeats", r"""SELECT id, string_agg(s, ' | ' ORDER BY p) AS cleaned FROM (SELECT id, s, min(p) AS p FROM (
    SELECT id, trim(regexp_replace(x[i], '^\s+|\s+$', '', 'g')) AS s, i AS p FROM (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM (
        SELECT id, string_split(replace(text, chr(10), '|'), '|') AS x FROM reviews))) WHERE s <> '' GROUP BY id, s) GROUP BY id""")
def _(t):
    return t.reviews.select("id", tx.drop_repeats(F.translate("text", "\n", "|")).alias("cleaned"))


@query("f27_has_emoji", f"SELECT id, regexp_matches(text, '{tx.EMOJI}') AS plain, true AS marked FROM reviews")
def _(t):
    return t.reviews.select("id", tx.has_emoji(F.col("text")).alias("plain"),
                            tx.has_emoji(F.concat("text", F.lit(" \U0001F600"))).alias("marked"))


@query("f28_quantile_bins", """WITH e AS (SELECT min(l_quantity) AS a, quantile_cont(l_quantity, 0.25) AS b, quantile_cont(l_quantity, 0.5) AS c,
        quantile_cont(l_quantity, 0.75) AS d, max(l_quantity) + 1 AS f FROM lineitem)
    SELECT CAST(CASE WHEN l_quantity <= b THEN 0 WHEN l_quantity <= c THEN 1 WHEN l_quantity <= d THEN 2 ELSE 3 END AS INTEGER) AS bin,
        count(*) AS n FROM lineitem, e GROUP BY 1""")
def _(t):
    from opinara.operators import tables as tb

    q = tb.exact_quantiles(t.lineitem, ["l_quantity"], [0.0, 0.25, 0.5, 0.75, 1.0])
    edges = q.agg(F.sort_array(F.collect_list("value")).alias("e"))  # five numbers
    df = t.lineitem.select("l_quantity").withColumn("e", edges.scalar())
    cuts = [F.get("e", F.lit(i)) for i in range(4)] + [F.get("e", F.lit(4)) + 1]
    return df.groupBy(tb.right_closed_bin(F.col("l_quantity"), cuts).alias("bin")).agg(F.count("*").alias("n"))


@query("f29_largest_distance", """SELECT round(sqrt(5.0), 6) AS far, max(l_linenumber) AS top FROM lineitem""")
def _(t):
    from opinara.operators import features as ft

    return t.lineitem.agg(F.round(ft.largest_distance(5), 6).alias("far"), F.max("l_linenumber").alias("top"))


@query("f30_folder_safe", r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(url,
    '<', '%3C'), '>', '%3E'), ':', '%3A'), '"', '%22'), '\', '%5C'), '|', '%7C'), '?', '%3F'), '*', '%2A') AS folder FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.folder_safe(F.col("url")).alias("folder"))
