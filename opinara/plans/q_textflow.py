"""Sentences, tokens, clauses, phrases, keyphrases and spelling on whole texts."""

from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.operators import tables as tb
from opinara.operators import textflow as tf
from opinara.plans.q_relational import describe_sql, rounded
from opinara.plans.registry import query

KEYS = ["id", "spos"]


def none():
    return F.array().cast("array<string>")


def stop_array(df, t):
    """The stop words (a fixed, small number) as an array column."""
    return df.withColumn("stop", t.stop_words.agg(F.collect_list("word")).scalar())


# Clause of each token by recursion: climb until a head.
CLIMB = """climb AS (
    SELECT id, spos, pos, text, lemma, tag, rel, pos AS cur, head AS up, (rel IN ('root', 'conj') OR head = pos) AS done FROM tokens
    UNION ALL
    SELECT c.id, c.spos, c.pos, c.text, c.lemma, c.tag, c.rel, p.pos, p.head, (p.rel IN ('root', 'conj') OR p.head = p.pos)
    FROM climb c JOIN tokens p ON p.id = c.id AND p.spos = c.spos AND p.pos = c.up WHERE NOT c.done),
parents AS (SELECT DISTINCT id, spos, head AS pos FROM tokens WHERE head <> pos),
members AS (SELECT c.*, cur AS clause FROM climb c LEFT JOIN parents p ON p.id = c.id AND p.spos = c.spos AND p.pos = c.pos
    WHERE done AND NOT (regexp_matches(c.text, '[[:punct:]]') AND p.pos IS NULL))"""
TIGHT = r"""regexp_replace(string_agg(text, ' ' ORDER BY pos), '\s([?.!,;:"](?:\s|$))', '\1', 'g')"""


@query("t1_split_sentences", "SELECT id, spos, sentence FROM sentences")
def _(t):
    return t.sentences.select("id", "spos", "sentence")


@query("t2_chunk_sentences")
def _(t):
    return tf.chunk_sentences(t.sentences.select("id", "spos", "sentence"), "sentence", 100, ("and", "et", "und"))


def dictionary(t):
    return t.vocabulary.where("df >= 3").select(
        "word", F.substring("word", 1, 6).alias("lemma"),
        F.element_at(F.array(F.lit("NOUN"), F.lit("ADJ"), F.lit("VERB")), F.length("word") % 3 + 1).alias("tag"))


DICTIONARY = "(SELECT word, word[:6] AS lemma, (['NOUN', 'ADJ', 'VERB'])[length(word) % 3 + 1] AS tag FROM vocabulary WHERE df >= 3)"


@query("t3_lemmatise", f"""SELECT coalesce(d.lemma, w.word) AS lemma, count(*) AS n, count(DISTINCT w.id) AS reviews
    FROM words w LEFT JOIN {DICTIONARY} d USING (word) GROUP BY 1""")
def _(t):
    lem = tf.lemmatise(t.words, dictionary(t).select("word", "lemma"))
    return lem.groupBy("lemma", "id").agg(F.count("*").alias("n")).groupBy("lemma").agg(
        F.sum("n").alias("n"), F.count("*").alias("reviews"))


@query("t4_clauses", f"""WITH RECURSIVE {CLIMB}
    SELECT id, spos, CAST(clause AS INTEGER) AS clause, {TIGHT} AS text, string_agg(lemma, ' ' ORDER BY pos) AS lemmas FROM members GROUP BY ALL""")
def _(t):
    c = tf.clauses(t.annotated, KEYS)
    return c.select(*KEYS, "clause", "text", F.array_join(F.transform("toks", lambda x: x["lemma"]), " ").alias("lemmas"))


@query("t4_clause_lemmas", r"""WITH RECURSIVE bad AS (SELECT t.*, (rel IN ('root', 'conj') OR head = pos) AS is_head,
        (lemma IN (SELECT word FROM stop_words) OR regexp_matches(text, '[0-9]|[[:punct:]]')) AS skip FROM tokens t),
    climb AS (SELECT id, spos, pos, text, lemma, pos AS cur, head AS up, is_head, (is_head OR skip) AS done FROM bad
    UNION ALL SELECT c.id, c.spos, c.pos, c.text, c.lemma, p.pos, p.head, p.is_head, (p.is_head OR p.skip)
        FROM climb c JOIN bad p ON p.id = c.id AND p.spos = c.spos AND p.pos = c.up WHERE NOT c.done),
    parents AS (SELECT DISTINCT id, spos, head AS pos FROM tokens WHERE head <> pos)
    SELECT c.id, c.spos, CAST(c.cur AS INTEGER) AS clause, string_agg(c.lemma, ' ' ORDER BY c.pos) AS lemmas FROM climb c
        LEFT JOIN parents p ON p.id = c.id AND p.spos = c.spos AND p.pos = c.pos
    WHERE c.done AND c.is_head AND NOT (regexp_matches(c.text, '[[:punct:]]') AND p.pos IS NULL) GROUP BY ALL""")
def _(t):
    stop = [r[0] for r in t.stop_words.collect()]
    c = tf.clauses(t.annotated, KEYS, stop=F.array(*map(F.lit, stop)))
    return c.select(*KEYS, "clause", F.array_join(F.transform("toks", lambda x: x["lemma"]), " ").alias("lemmas"))


@query("t5_clause_fallback", f"""WITH RECURSIVE named AS (SELECT id, spos FROM tokens WHERE rel = 'conj' GROUP BY ALL),
    marked AS (SELECT t.*, CASE WHEN n.id IS NOT NULL THEN rel = 'conj' ELSE head = pos END AS is_head FROM tokens t LEFT JOIN named n USING (id, spos)),
    climb AS (SELECT id, spos, pos, text, pos AS cur, head AS up, is_head FROM marked UNION ALL
        SELECT c.id, c.spos, c.pos, c.text, p.pos, p.head, p.is_head FROM climb c JOIN marked p
            ON p.id = c.id AND p.spos = c.spos AND p.pos = c.up WHERE NOT c.is_head AND c.cur <> c.up),
    parents AS (SELECT DISTINCT id, spos, head AS pos FROM tokens WHERE head <> pos),
    found AS (SELECT c.id, c.spos, c.cur AS clause, {TIGHT.replace('text, ', 'c.text, ', 1).replace('ORDER BY pos', 'ORDER BY c.pos')} AS text
        FROM climb c LEFT JOIN parents p ON p.id = c.id AND p.spos = c.spos AND p.pos = c.pos
        WHERE c.is_head AND NOT (regexp_matches(c.text, '[[:punct:]]') AND p.pos IS NULL) GROUP BY ALL)
    SELECT id, spos, CAST(clause AS INTEGER) AS clause, CASE WHEN text[1] = 'ß' THEN 'SS' ELSE upper(text[1]) END || text[2:] AS text FROM found WHERE length(text) >= 2""")
def _(t):
    as_dep = lambda x: x.withField("rel", F.when(x["rel"] == "root", "dep").otherwise(x["rel"]))
    unrooted = tf.Annotated(t.annotated.rows, F.transform(t.annotated.tk, as_dep))
    found = tf.clauses(unrooted, KEYS, fallback=True).where((F.length("text") >= 2) & (F.size("toks") > 0))
    return found.select(*KEYS, "clause", tx.capitalise(F.col("text")).alias("text"))


@query("t6_descriptive_clauses", f"""WITH RECURSIVE {CLIMB} SELECT id, spos, CAST(clause AS INTEGER) AS clause FROM members GROUP BY ALL
    HAVING bool_or(tag = 'NOUN' AND lemma NOT IN (SELECT word FROM stop_words)) AND bool_or(tag = 'ADJ' AND lemma NOT IN (SELECT word FROM stop_words))""")
def _(t):
    return tf.descriptive_clauses(stop_array(tf.clauses(t.annotated, KEYS), t), F.col("stop")).select(*KEYS, "clause")


@query("t7_tagged_tokens", f"""SELECT w.id, w.spos, w.wpos, w.word, coalesce(d.lemma, w.word) AS lemma, coalesce(d.tag, 'X') AS tag
    FROM words w LEFT JOIN {DICTIONARY} d USING (word)""")
def _(t):
    return tf.tag_words(t.words, dictionary(t)).select("id", "spos", "wpos", "word", "lemma", "tag")


NOUNS = r"""nouns AS (SELECT id, spos, clause, lemma AS noun FROM members WHERE tag = 'NOUN' AND lemma NOT IN (SELECT word FROM stop_words)
    AND NOT regexp_matches(lemma, '\d|[[:punct:]]'))"""


@query("t8_noun_counts", f"WITH RECURSIVE {CLIMB}, {NOUNS} SELECT noun, count(*) AS n FROM nouns GROUP BY noun HAVING n > 5")
def _(t):
    return tf.noun_counts(stop_array(tf.clauses(t.annotated, KEYS), t), F.col("stop"), at_least=6)


@query("t9_texts_per_noun", f"""WITH RECURSIVE {CLIMB}, {NOUNS},
    texts AS (SELECT id, spos, clause, {TIGHT} AS text FROM members GROUP BY ALL)
    SELECT noun, id // 1000 AS part, count(*) AS n, string_agg(text, '. ' ORDER BY id, text) AS joined, CAST(length(string_agg(text, '. ')) AS BIGINT) AS len
    FROM nouns JOIN texts USING (id, spos, clause) GROUP BY noun, part""")
def _(t):
    joined = tf.texts_per_noun(stop_array(tf.clauses(t.annotated, KEYS), t), F.col("stop"), "id", "text", 1000)
    return joined.withColumn("len", F.length("joined").cast("long")).orderBy(F.desc("len"), "noun", "part")


@query("t10_adjectives_per_noun", f"""WITH RECURSIVE {CLIMB}, {NOUNS} SELECT noun, adj, count(*) AS n FROM nouns JOIN (
    SELECT id, spos, clause, lemma AS adj FROM members WHERE tag = 'ADJ' AND length(lemma) > 1) USING (id, spos, clause)
    GROUP BY noun, adj HAVING n > 1""")
def _(t):
    return tf.adjectives_per_noun(stop_array(tf.clauses(t.annotated, KEYS), t), F.col("stop"), at_least=2)


@query("t11_key_phrases", """SELECT phrase, count(*) AS n FROM (SELECT id, spos, run, string_agg(text, ' ' ORDER BY pos) AS phrase FROM (
    SELECT *, sum(CASE WHEN tag IN ('NOUN', 'VERB') THEN 1 ELSE 0 END) OVER (PARTITION BY id, spos ORDER BY pos) AS run FROM tokens)
    WHERE run > 0 GROUP BY id, spos, run HAVING count(*) > 1) WHERE length(trim(phrase)) > 2 GROUP BY phrase""")
def _(t):
    return tf.key_phrases(t.tokens, KEYS).groupBy("phrase").agg(F.count("*").alias("n"))


@query("t12_term_features", r"""WITH tk AS (SELECT id, spos, i - 1 AS i, w[i] AS raw, lower(w[i]) AS word,
        CASE WHEN i > 1 THEN lower(w[i - 1]) END AS l, lower(w[i + 1]) AS r FROM (
        SELECT id, spos, w, unnest(range(1, len(w) + 1)) AS i FROM (
            SELECT id, spos, regexp_extract_all(sentence, '[\p{L}\p{N}_]+') AS w FROM sentences))),
    flags AS (SELECT *, upper(raw) = raw AND length(raw) > 1 AND regexp_matches(raw, '\p{L}') AS up FROM tk WHERE word NOT IN (SELECT word FROM stop_words)),
    per AS (SELECT id, word, count(*) AS tf, count(*) FILTER (up) AS ups, count(*) FILTER (regexp_matches(raw, '^\p{Lu}') AND i > 0 AND NOT up) AS caps,
        median(spos) AS mid, count(DISTINCT spos) AS ns, count(l) AS nl, count(DISTINCT l) AS dl, count(r) AS nr, count(DISTINCT r) AS dr FROM flags GROUP BY id, word),
    doc AS (SELECT id, avg(tf) AS mean_tf, stddev_pop(tf) AS std_tf, max(tf) AS max_tf FROM per GROUP BY id),
    size AS (SELECT id, count(*) AS sents FROM sentences GROUP BY id),
    f AS (SELECT id, word, tf, greatest(ups, caps) / (1 + ln(tf)) AS casing, ln(ln(3 + mid)) AS position, tf / (mean_tf + std_tf) AS frequency,
        1 + (coalesce(dl / nullif(nl, 0), 0) + coalesce(dr / nullif(nr, 0), 0)) * (tf / max_tf) AS relatedness, ns / sents AS dispersion
        FROM per JOIN doc USING (id) JOIN size USING (id))
    SELECT id, word, tf, round(relatedness, 5) AS relatedness, round(dispersion, 5) AS dispersion,
        round(relatedness * position / (casing + frequency / relatedness + dispersion / relatedness), 5) AS score FROM f""")
def _(t):
    f = tf.term_features(t.sentences, t.stop_words)
    return f.select("id", "word", "tf", *[F.round(c, 5).alias(c) for c in ("relatedness", "dispersion", "score")])


@query("t12_keyphrases")
def _(t):
    return tf.keyphrases(t.sentences, t.stop_words)


@query("t13_related_words", """WITH RECURSIVE up AS (SELECT id, spos, pos, head AS anc FROM tokens WHERE head <> pos UNION ALL
        SELECT u.id, u.spos, u.pos, t.head FROM up u JOIN tokens t ON t.id = u.id AND t.spos = u.spos AND t.pos = u.anc WHERE t.head <> t.pos),
    target AS (SELECT id, spos, pos FROM tokens WHERE lemma IN (SELECT term FROM lexicon)),
    links AS (SELECT u.id, u.spos, u.anc AS target, u.pos AS other FROM up u JOIN target a ON a.id = u.id AND a.spos = u.spos AND a.pos = u.anc
        UNION ALL SELECT u.id, u.spos, u.pos, u.anc FROM up u JOIN target a ON a.id = u.id AND a.spos = u.spos AND a.pos = u.pos)
    SELECT l.id, l.spos, CAST(l.target AS INTEGER) AS target, t.pos, t.lemma AS word FROM links l JOIN tokens t ON t.id = l.id AND t.spos = l.spos AND t.pos = l.other
    WHERE t.tag IN ('ADJ', 'VERB') AND t.lemma NOT IN (SELECT word FROM stop_words)""")
def _(t):
    stop = F.array(*[F.lit(r[0]) for r in t.stop_words.collect()])
    targets = t.tokens.join(t.lexicon.select(F.col("term").alias("lemma")), "lemma", "left_semi").select(
        *KEYS, F.col("pos").alias("target"))
    return tf.related_words(t.annotated, targets, KEYS, stop)


@query("t14_length_summary", describe_sql("(SELECT length(text) AS n_chars FROM reviews)", ["n_chars"]))
def _(t):
    return rounded(tb.describe(t.reviews.select(F.length("text").alias("n_chars")), ["n_chars"]))


# DuckDB's levenshtein counts bytes, so accented letters become one-byte capitals.
FIXES = """enc AS (SELECT word, n, translate(word, 'éèêöüóçíßñä', 'ABCDEFGHIJK') AS e FROM vocabulary WHERE length(word) > 1),
fixes AS (SELECT a.word, max_by(b.word, (b.n, b.word)) AS suggestion FROM enc a JOIN enc b
    ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND b.n >= a.n * 10 AND a.n <= 2 AND b.n >= 10
    WHERE levenshtein(a.e, b.e) = 1 GROUP BY a.word)"""


@query("t15_corrections", f"WITH {FIXES} SELECT word, suggestion FROM fixes")
def _(t):
    return tf.corrections(t.vocabulary)


CORRECTED = rf"""WITH {FIXES}, parts AS (SELECT id, i, p[i] AS part FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM (
        SELECT id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM reviews)))
    SELECT id, string_agg(coalesce(suggestion, part), '' ORDER BY i) AS corrected_text FROM parts LEFT JOIN fixes ON word = lower(part)
    GROUP BY id HAVING count(suggestion) > 0"""


@query("t15_corrected_texts", CORRECTED)
def _(t):
    return tf.correct_texts(t.reviews, tf.corrections(t.vocabulary))
