"""Aspects, summaries, recommendations and cards; summaries by extraction."""

from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.operators import aspects as asp
from opinara.operators import latent as lt
from opinara.operators import models as md
from opinara.operators import tables as tb
from opinara.plans.q_relational import describe_sql, rounded
from opinara.plans.registry import query

P, A = asp.PRODUCT, asp.ASPECT
ROLLED = ["grp", "n", "positive", "negative", "neutral", "rating_positive", "rating_negative", "traits", "example", "sentiment"]


def top_sql(source, keys, item, n, name):
    return f"""(SELECT {keys}, string_agg({item}, ', ' ORDER BY rk) AS {name} FROM (SELECT {keys}, {item}, row_number() OVER (PARTITION BY {keys}
        ORDER BY sum(n) DESC, {item}) AS rk FROM {source} GROUP BY {keys}, {item}) WHERE rk <= {n} GROUP BY {keys})"""


TRAITS = "(SELECT category, product, aspect, word, count(*) AS n FROM mention m JOIN traits c ON c.id = m.id AND c.term = m.term GROUP BY ALL)"


@query("r1_analyse_reviews", f"""SELECT r.category, r.product, r.aspect, r.n, r.positive, r.negative, r.sentiment, r.traits, c.characteristics, f.agreed_phrases
    FROM rolled r LEFT JOIN {top_sql(TRAITS, 'category, product, aspect', 'word', 5, 'characteristics')} c USING (category, product, aspect)
    LEFT JOIN {top_sql('phrases', 'category, product, aspect', 'phrase', 5, 'agreed_phrases')} f USING (category, product, aspect)""")
def _(t):
    return asp.analyse(t.reviews, t.phrase_lexicon, t.spoken_tokens, whole=t.spoken_annotated, sentences=t.spoken).select(
        *A, "n", "positive", "negative", "sentiment", "traits", "characteristics", "agreed_phrases")


@query("r2_aspect_mentions", """SELECT id, category, product, aspect, term, example, sentiment, n_traits FROM mention""")
def _(t):
    return t.mentions.select("id", *A, "term", "example", "sentiment", F.size("characteristics").cast("long").alias("n_traits"))


@query("r3_aspect_roll_up", f"SELECT category, product, aspect, {', '.join(ROLLED)} FROM rolled")
def _(t):
    return t.aspects.select(*A, *ROLLED)


@query("r4_row_sentiment", f"""SELECT category, product, aspect, sentiment, traits, characteristics FROM rolled LEFT JOIN
    (SELECT category, product, aspect, string_agg(word, ', ' ORDER BY word) AS characteristics FROM {TRAITS} GROUP BY ALL) USING (category, product, aspect)""")
def _(t):
    words = asp.characteristic_counts(t.mentions).groupBy(*A).agg(
        F.array_join(F.sort_array(F.collect_set("word")), ", ").alias("characteristics"))
    return t.aspects.select(*A, "sentiment", "traits").join(words, A, "left")


SPOKEN = "(SELECT p.*, r.sentiment FROM phrases p JOIN rolled r USING (category, product, aspect))"
EMPTY = """(SELECT category, product, sentiment, string_agg(aspect, ', ' ORDER BY aspect) AS e FROM rolled r WHERE NOT EXISTS (SELECT 1 FROM phrases p
    WHERE p.category = r.category AND p.product = r.product AND p.aspect = r.aspect) GROUP BY ALL)"""


@query("r5_category_product_summary", f"""SELECT s.category, s.product, s.n, s.positive, s.negative, round(s.positive_ratio, 6) AS positive_ratio,
    round(s.negative_ratio, 6) AS negative_ratio, tp.x AS positive_aspects, tn.x AS negative_aspects,
    CASE WHEN tp.x IS NULL THEN ep.e END AS positive_empty_aspects, CASE WHEN tn.x IS NULL THEN en.e END AS negative_empty_aspects
    FROM summed s
    LEFT JOIN {top_sql(f"(SELECT * FROM {SPOKEN} WHERE sentiment = 'positive')", 'category, product', 'phrase', 10, 'x')} tp USING (category, product)
    LEFT JOIN {top_sql(f"(SELECT * FROM {SPOKEN} WHERE sentiment = 'negative')", 'category, product', 'phrase', 10, 'x')} tn USING (category, product)
    LEFT JOIN (SELECT * FROM {EMPTY} WHERE sentiment = 'positive') ep USING (category, product)
    LEFT JOIN (SELECT * FROM {EMPTY} WHERE sentiment = 'negative') en USING (category, product)""")
def _(t):
    out = asp.summary(t.aspects, asp.phrase_counts(t.mentions))
    return out.orderBy(F.desc("positive_ratio"), *P).select(
        *P, "n", "positive", "negative", F.round("positive_ratio", 6).alias("positive_ratio"), F.round("negative_ratio", 6).alias("negative_ratio"),
        "positive_aspects", "negative_aspects", "positive_empty_aspects", "negative_empty_aspects")


def sums(t):
    s = t.aspects.groupBy(*P).agg(*[F.sum(c).alias(c) for c in ("n", "positive", "negative")])
    return s.withColumns({f"{k}_ratio": F.try_divide(k, "n") for k in ("positive", "negative")})


@query("r6_recommend", """WITH k AS (SELECT greatest(5, CAST(floor(count(*) * 0.25) AS BIGINT)) AS k FROM summed),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category, product) AS rk FROM summed),
    lp AS (SELECT product, positive_ratio FROM r, k WHERE rk > k AND n >= 10 ORDER BY positive_ratio DESC, category, product LIMIT 1)
    SELECT 'popular' AS kind, product, round(positive_ratio, 6) AS positive_ratio FROM r WHERE rk = 1 UNION ALL
    SELECT 'less_popular', coalesce((SELECT product FROM lp), 'N/A'), round((SELECT positive_ratio FROM lp), 6)""")
def _(t):
    return asp.recommend(sums(t)).select("kind", "product", F.round("positive_ratio", 6).alias("positive_ratio"))


@query("r7_price_advice", """SELECT category, product, CASE WHEN positive_ratio >= 0.8 AND negative_ratio < 0.1 THEN '5.00%'
    WHEN positive_ratio < 0.5 THEN '-5.00%' ELSE 'No change' END AS price_change FROM summed""")
def _(t):
    return asp.price_advice(sums(t))


@query("r8_product_cards", f"""SELECT category, product, product || ' - ' || names AS title, 'Strong points: ' || coalesce(a.x, '') || '.' AS description,
    coalesce(k.x, '') AS key_features, coalesce(a.x, '') AS advantages
    FROM (SELECT category, product, string_agg(aspect, ' ' ORDER BY aspect) AS names FROM rolled GROUP BY ALL)
    LEFT JOIN {top_sql(f"(SELECT * FROM {SPOKEN} WHERE sentiment = 'positive')", 'category, product', 'phrase', 5, 'x')} a USING (category, product)
    LEFT JOIN {top_sql(TRAITS, 'category, product', 'word', 5, 'x')} k USING (category, product)""")
def _(t):
    return asp.product_cards(t.aspects, asp.phrase_counts(t.mentions), asp.characteristic_counts(t.mentions))


@query("r9_aspect_descriptions", f"""SELECT category, product, aspect, 'Aspect ''' || aspect || ''' is rated by customers ' ||
    CASE WHEN positive > negative THEN 'mostly positively' ELSE 'mostly negatively' END || '.' ||
    CASE WHEN c.x IS NOT NULL THEN ' Customers most often mention these traits: ' || c.x || '.' ELSE '' END || ' For example: «' || example || '».' AS description
    FROM rolled LEFT JOIN {top_sql(TRAITS, 'category, product, aspect', 'word', 5, 'x')} c USING (category, product, aspect)""")
def _(t):
    traits = asp.top_list(asp.characteristic_counts(t.mentions), A, "word", 5, "characteristics")
    return asp.describe_aspects(t.aspects, traits)


TFIDF = """tk AS (SELECT {keys}, unnest(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)) AS term FROM {src}),
    tf AS (SELECT {keys}, term, count(*) AS tf FROM tk GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT tf.*, tf * (ln((1 + (SELECT count(*) FROM {src})) / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (term)),
    weights AS (SELECT {keys}, term, x / sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS w FROM raw)"""
CENTRE = """centre AS (SELECT {g}, term, sum(w) AS c FROM weights GROUP BY ALL),
    sims AS (SELECT {g}, {key}, round(sum(w * c) / any_value(len), 9) AS sim FROM weights JOIN centre USING ({g}, term)
        JOIN (SELECT {g}, sqrt(sum(c * c)) AS len FROM centre GROUP BY ALL) USING ({g}) GROUP BY {g}, {key})"""


@query("r10_key_thought", f"""WITH ex AS (SELECT category, product, aspect, id, min(example) AS example FROM mention GROUP BY ALL),
    {TFIDF.format(keys='category, product, aspect, id', text='example', src='ex')}, {CENTRE.format(g='category, product, aspect', key='id')}
    SELECT category, product, aspect, id, example FROM (SELECT category, product, aspect, max_by(id, (sim, -id)) AS id FROM sims GROUP BY ALL)
        JOIN ex USING (category, product, aspect, id)""")
def _(t):
    ex = t.mentions.groupBy(*A, "id").agg(F.min("example").alias("example"))
    return md.key_texts(ex, A, "id", "example").select(*A, "id", "example")


@query("r10_latent_key_thought", r"""WITH ex AS (SELECT category, product, aspect, id, min(example) AS example FROM mention GROUP BY ALL),
    c AS (SELECT category, product, aspect, id, term, count(*) AS n FROM (SELECT category, product, aspect, id, unnest(regexp_extract_all(lower(example), '[\p{L}\p{N}_]+')) AS term FROM ex) GROUP BY ALL),
    k AS (SELECT category, product, aspect, id, sqrt(sum(power(0.4 + 0.6 * n / m, 2))) AS rank FROM (SELECT *, max(n) OVER (PARTITION BY category, product, aspect, id) AS m FROM c) GROUP BY ALL)
    SELECT category, product, aspect, id, example FROM (SELECT category, product, aspect, max_by(id, (round(rank, 9), -id)) AS id FROM k GROUP BY ALL) JOIN ex USING (category, product, aspect, id)""")
def _(t):
    ex = t.mentions.groupBy(*A, "id").agg(F.min("example").alias("example"))
    return lt.key_thoughts(ex, A, "id", "example").select(*A, "id", "example")


@query("r10_latent_three_directions")
def _(t):
    ex = t.mentions.groupBy(*A, "id").agg(F.min("example").alias("example"))
    return lt.key_thoughts(ex, A, "id", "example", dimensions=3).select(*A, "id", "example")


@query("r11_extractive_summary", f"""WITH {TFIDF.format(keys='id, spos', text='sentence', src='sentences')}, {CENTRE.format(g='id', key='spos')}
    SELECT id, string_agg(sentence, '. ' ORDER BY spos) AS summary FROM (SELECT id, spos, row_number() OVER (PARTITION BY id ORDER BY sim DESC, spos) AS rk FROM sims)
    JOIN sentences USING (id, spos) WHERE rk <= 3 GROUP BY id""")
def _(t):
    return md.extractive_summary(t.sentences.select("id", "spos", "sentence"), ["id"], "spos", "sentence", 3)


@query("r12_agreed_phrases", "SELECT category, product, aspect, phrase, n FROM phrases")
def _(t):
    return asp.phrase_counts(t.mentions).select(*A, "phrase", "n")


@query("r15_useful_sentences", r"""WITH good AS (SELECT * FROM sentences WHERE length(sentence) > 20 AND len(regexp_extract_all(sentence, '[\p{L}\p{N}_]+')) > 1),
    combined AS (SELECT id, string_agg(sentence, ' ' ORDER BY spos) AS combined FROM sentences WHERE length(sentence) > 20 GROUP BY id)
    SELECT g.id, g.product, g.category, g.rating, c.combined, count(*) AS n, string_agg(g.sentence, ' | ' ORDER BY spos) AS sentences
    FROM good g LEFT JOIN combined c USING (id) GROUP BY ALL""")
def _(t):
    useful = t.sentences.where(F.length("sentence") > 20)
    combined = tb.ordered_text(useful, ["id"], "spos", "sentence", " ", name="combined").select("id", "combined")
    good = useful.where(tx.has_several_words(F.col("sentence")))
    lists = tb.ordered_text(good, ["id", "product", "category", "rating"], "spos", "sentence", " | ", name="sentences")
    return lists.join(combined, "id", "left").select("id", "product", "category", "rating", "combined", "n", "sentences")


@query("r16_size_summary", describe_sql("(SELECT count(*) AS elem_count, sum(length(text)) AS chars FROM reviews GROUP BY product, category HAVING count(*) > 2)", ["elem_count", "chars"]))
def _(t):
    sizes = t.reviews.groupBy("product", "category").agg(F.count("*").alias("elem_count"), F.sum(F.length("text")).alias("chars"))
    return rounded(tb.describe(sizes.where("elem_count > 2"), ["elem_count", "chars"]))
