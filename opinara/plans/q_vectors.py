"""Masks, centroids, key sentences and distances on the vector table."""

from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.functions import vectors as vx
from opinara.operators import masks as mk
from opinara.operators import neighbours as nb
from opinara.operators import textflow as tf
from opinara.plans.q_clusters import dbscan_sql
from opinara.operators import wordvectors as wvm
from opinara.plans.registry import query

def digest(word, digits):
    """The first hexadecimal digits of a word's MD5 as a number, in both engines."""
    return F.conv(F.substring(F.md5(word), 1, digits), 16, 10).cast("long")


def picked_vectors(t):
    """(word, id; id, vec): every word of the corpus takes the vector that its digest picks."""
    n = t.embeddings.agg(F.count("*")).scalar()
    return t.vocabulary.select("word", (digest(F.col("word"), 6) % n).alias("id")), t.vectors.select("id", "vec")


def word_vectors(t):
    """word, vec of :func:`picked_vectors`."""
    words, vectors = picked_vectors(t)
    return words.join(vectors, "id").select("word", "vec")


WORD_VECTORS = """wv AS (SELECT word, vec FROM (SELECT word, CAST('0x' || md5(word)[:6] AS BIGINT) % (SELECT count(*) FROM embeddings) AS id FROM vocabulary)
    JOIN vectors USING (id))"""


@query("j7_best_match", "SELECT id, mask_id, mask, round(s, 6) AS s FROM mask_best")
def _(t):
    return mk.best_mask(t.vectors, "vec", t.masks).select(
        "id", F.col("best.mask_id").alias("mask_id"), F.col("best.mask").alias("mask"), F.round("best.s", 6).alias("s"))


def doubled(t):
    """The vectors, and a copy of every seventh one in the same product."""
    return t.vectors.unionByName(t.vectors.where("id % 7 = 0").withColumn("id", F.col("id") + 10_000_000))


DOUBLED = "twice AS (SELECT id, product, vec FROM vectors UNION ALL SELECT id + 10000000, product, vec FROM vectors WHERE id % 7 = 0)"


@query("j8_close_pairs", f"""WITH {DOUBLED} SELECT CAST(a.product AS VARCHAR) AS g, a.id AS a, b.id AS b, abs(round(1 - list_cosine_similarity(a.vec, b.vec), 6)) AS dist
    FROM twice a JOIN twice b ON a.product = b.product AND a.id < b.id WHERE 1 - list_cosine_similarity(a.vec, b.vec) <= 0.75""")
def _(t):
    return nb.with_copies(*nb.close_pairs(doubled(t), "product", "id", "vec", 0.75)).select("g", "a", "b", F.abs(F.round("dist", 6)).alias("dist"))


@query("a17_mean_pair_distance", """SELECT a.product, round(avg(1 - list_cosine_similarity(a.vec, b.vec)), 6) AS mean_distance
    FROM vectors a JOIN vectors b ON a.product = b.product AND a.id < b.id GROUP BY 1""")
def _(t):
    return mk.mean_pair_distance(t.vectors, ["product"]).select("product", F.round("mean_distance", 6).alias("mean_distance"))


@query("a17_mean_full_matrix", """SELECT a.product, round(sum(CASE WHEN a.id = b.id THEN 0 ELSE 1 - list_cosine_similarity(a.vec, b.vec) END) / count(*), 6) AS mean_distance
    FROM vectors a JOIN vectors b ON a.product = b.product GROUP BY 1""")
def _(t):
    full = mk.mean_pair_distance(t.vectors, ["product"], whole_matrix=True)
    return full.select("product", F.round("mean_distance", 6).alias("mean_distance"))


@query("a18_centroids", "SELECT product, CAST(k - 1 AS INTEGER) AS k, round(avg(x), 6) AS x FROM dims GROUP BY product, k")
def _(t):
    mean = t.vectors.groupBy("product").agg(vx.mean_vector(F.col("vec")).alias("m"))
    return mean.select("product", F.posexplode("m").alias("k", "x")).select("product", "k", F.round("x", 6).alias("x"))


@query("e2_vector_functions", """SELECT v.id, round(list_inner_product(v.vec, m.vec), 6) AS d, round(list_cosine_similarity(v.vec, m.vec), 6) AS c,
    round(sqrt(list_inner_product(v.vec, v.vec)), 6) AS n, round(list_distance(v.vec, m.vec), 6) AS e FROM vectors v JOIN masks m ON m.mask_id = v.product""")
def _(t):
    df = t.vectors.join(t.masks.select(F.col("mask_id").alias("product"), F.col("vec").alias("m")), "product")
    v, m = F.col("vec"), F.col("m")
    return df.select("id", F.round(vx.dot(v, m), 6).alias("d"), F.round(vx.cosine(v, m), 6).alias("c"),
                     F.round(vx.norm(v), 6).alias("n"), F.round(vx.euclidean(v, m), 6).alias("e"))


def sentence_vectors(t):
    """id, spos, sentence, vec: every sentence with the mean of its words' vectors."""
    said = t.sentences.select("id", "spos", "sentence")
    return wvm.mean_vectors(said, ["id", "spos"], "sentence", *picked_vectors(t)).where(F.col("vec").isNotNull()).drop("n_known")


def unembedded_sentences(t):
    """(means; id, spos, sentence, vec): the sentences, with a vector only where several share their
    id and place; :func:`embedded` gives the others theirs."""
    means, keys = wvm.WordMeans(*picked_vectors(t)), ["id", "spos"]
    said = t.sentences.select(*keys, "sentence").where("id IS NOT NULL")
    lone, shared = means.parted(said, keys)
    told = means.together(shared if means.held else said, keys, "sentence").where("vec IS NOT NULL").select(*keys, "sentence", "vec")
    return means, lone.withColumn("vec", F.lit(None).cast("array<double>")).unionByName(told) if means.held else told


def embedded(means, rows):
    """id, spos, sentence, vec of the sentences that have a vector."""
    if not means.held:
        return rows
    found = means.alone(rows.withColumnRenamed("vec", "told"), "sentence", F.col("told").isNull())
    return found.withColumn("vec", F.coalesce("told", "vec")).where("vec IS NOT NULL").select("id", "spos", "sentence", "vec")


SENTENCE_LABELS = r"""picked AS (SELECT word, CAST('0x' || md5(word)[:6] AS BIGINT) % (SELECT count(*) FROM embeddings) AS vid FROM vocabulary),
    sdims AS (SELECT w.id, w.spos, d.k, avg(d.x) AS x FROM words w JOIN picked p ON p.word = w.word JOIN dims d ON d.id = p.vid GROUP BY ALL),
    mdims AS (SELECT product AS mask_id, k, avg(x) AS x FROM dims GROUP BY ALL), msize AS (SELECT mask_id, sqrt(sum(x * x)) AS n FROM mdims GROUP BY ALL),
    ssize AS (SELECT id, spos, sqrt(sum(x * x)) AS n FROM sdims GROUP BY ALL),
    near AS (SELECT id, spos, max(s) AS s FROM (SELECT a.id, a.spos, b.mask_id, sum(a.x * b.x) / any_value(z.n * m.n) AS s FROM sdims a JOIN mdims b ON b.k = a.k
        JOIN msize m ON m.mask_id = b.mask_id JOIN ssize z ON z.id = a.id AND z.spos = a.spos GROUP BY ALL) GROUP BY ALL),
    labelled_sentences AS (SELECT id, spos, CASE WHEN s > 0.4 THEN 0 WHEN len(w) IN (1, 3, 4) AND list_has_any(w, stop) THEN 2 WHEN 0.4 - s < 0.1 THEN -1 ELSE 1 END AS label, round(s, 6) AS max_similarity
        FROM near JOIN (SELECT id, spos, list_filter(string_split_regex(sentence, '\s+'), lambda x: x <> '') AS w FROM sentences) USING (id, spos), (SELECT list(word) AS stop FROM stop_words))"""


@query("e3_mask_labels", f"WITH {SENTENCE_LABELS} SELECT id, spos, label, max_similarity FROM labelled_sentences")
def _(t):
    words = [r[0] for r in t.stop_words.collect()]
    return mk.label_sentences(sentence_vectors(t), t.masks, words, threshold=0.4).select(
        "id", "spos", "label", F.round("max_similarity", 6).alias("max_similarity"))


@query("e5_key_sentences", """SELECT product, max_by(id, (round(s, 12), -id)) AS id, round(max(s), 6) AS sim FROM (
    SELECT v.product, v.id, list_cosine_similarity(v.vec, m.vec) AS s FROM vectors v JOIN masks m ON m.mask_id = v.product) GROUP BY product""")
def _(t):
    return mk.key_rows(t.vectors, ["product"], "id", "vec").select("product", "id", F.round("sim", 6).alias("sim"))


def rated(t):
    return t.vectors.select("product", "id", "vec", F.floor(F.col("id") / 2).alias("review"), (1 + F.col("id") % 5).alias("rating"))


@query("e6_key_thoughts", """WITH r AS (SELECT product, id, id // 2 AS review, CASE WHEN 1 + id % 5 > 3 THEN 'positive' ELSE 'negative' END AS sign, vec FROM vectors),
    d AS (SELECT product, sign, review, id, unnest(range(1, len(vec) + 1)) AS k, unnest(vec) AS x FROM r),
    centre AS (SELECT product, sign, list(x ORDER BY k) AS c FROM (SELECT product, sign, k, avg(x) AS x FROM d GROUP BY ALL) GROUP BY ALL),
    means AS (SELECT product, sign, review, list(x ORDER BY k) AS m FROM (SELECT product, sign, review, k, avg(x) AS x FROM d GROUP BY ALL) GROUP BY ALL),
    firsts AS (SELECT product, sign, review, min(id) AS first_id, min_by(vec, id) AS v FROM r GROUP BY ALL),
    s AS (SELECT product, sign, first_id, 'sentence' AS kind, list_cosine_similarity(v, c) AS sim FROM firsts JOIN centre USING (product, sign) UNION ALL
        SELECT product, sign, first_id, 'review', list_cosine_similarity(m, c) FROM firsts JOIN means USING (product, sign, review) JOIN centre USING (product, sign))
    SELECT product, sign, kind, first_id, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY product, sign, kind ORDER BY round(sim, 12) DESC, first_id) AS rk FROM s)
    WHERE rk <= 2""")
def _(t):
    return mk.key_thoughts(rated(t), ["product"]).select("product", "sign", "kind", "first_id", "rk")


@query("e7_mask_flags", """SELECT id, coalesce(string_agg(mask, ',' ORDER BY mask) FILTER (s > 0.3), '') AS flags FROM (
    SELECT v.id, m.mask, max(list_cosine_similarity(v.vec, m.vec)) AS s FROM vectors v, masks m GROUP BY ALL) GROUP BY id""")
def _(t):
    return mk.mask_flags(t.vectors, "vec", t.masks, 0.3).select("id", F.array_join("flags", ",").alias("flags"))


@query("e8_short_thoughts", f"""WITH {WORD_VECTORS}, ex AS (SELECT vec FROM wv JOIN stop_words USING (word)),
    near AS (SELECT DISTINCT word FROM wv, ex WHERE list_cosine_similarity(wv.vec, ex.vec) > 0.9),
    th AS (SELECT id * 100000 + spos AS key, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+') AS w FROM sentences)
    SELECT key FROM th WHERE len(w) = 1 OR (len(w) = 2 AND w[2] IN (SELECT word FROM stop_words))
        OR (len(w) IN (2, 3) AND (w[1] IN (SELECT word FROM near) OR w[2] IN (SELECT word FROM near) OR w[3] IN (SELECT word FROM near)))""")
def _(t):
    rows = t.sentences.select((F.col("id") * 100000 + F.col("spos")).alias("key"), "sentence")
    wv = word_vectors(t)
    ex = wv.join(t.stop_words, "word", "left_semi").select(F.xxhash64("word").alias("mask_id"), F.col("word").alias("mask"), "vec")
    return mk.short_thoughts(rows, "key", "sentence", t.stop_words, wv, ex)


@query("e9_aspect_groups", """WITH g AS (SELECT mask, list(x ORDER BY k) AS vec FROM (SELECT 'm' || (product % 4) AS mask, k, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY mask),
    b AS (SELECT m.mask_id AS category, max_by(g.mask, list_cosine_similarity(m.vec, g.vec)) AS grp, max(list_cosine_similarity(m.vec, g.vec)) AS s FROM masks m, g GROUP BY 1)
    SELECT category, 'm0' AS grp FROM b UNION ALL SELECT category, grp FROM b WHERE s >= 0.4 AND grp <> 'm0'""")
def _(t):
    cats = t.masks.select(F.col("mask_id").alias("category"), "vec")
    groups = t.vectors.groupBy((F.col("product") % 4).cast("long").alias("mask_id")).agg(vx.mean_vector(F.col("vec")).alias("vec"))
    return mk.aspect_groups(cats, groups.withColumn("mask", F.concat(F.lit("m"), "mask_id")), "m0", 0.4)


@query("e10_aspect_names", f"""WITH {WORD_VECTORS}, terms AS (SELECT word, aspect, vec, CAST('0x' || md5(word)[:12] AS BIGINT) AS mid FROM wv JOIN lexicon ON term = word),
    b AS (SELECT p.word AS phrase, max_by(t.aspect, (round(list_cosine_similarity(p.vec, t.vec), 12), -t.mid)) AS near, max(list_cosine_similarity(p.vec, t.vec)) AS s FROM wv p, terms t GROUP BY 1)
    SELECT phrase, coalesce(l.aspect, CASE WHEN s >= 0.3 THEN near END, phrase) AS aspect FROM b LEFT JOIN lexicon l ON l.term = phrase""")
def _(t):
    wv = word_vectors(t)
    terms = t.lexicon.join(wv, F.col("term") == F.col("word")).select(digest(F.col("term"), 12).alias("mask_id"), F.col("aspect").alias("mask"), "vec")
    return mk.aspect_names(wv.withColumnRenamed("word", "phrase"), t.lexicon, terms, 0.3)


@query("e11_review_vectors", """SELECT review, CAST(k - 1 AS INTEGER) AS k, round(avg(x), 6) AS x FROM (SELECT id // 2 AS review, k, x FROM dims) GROUP BY review, k""")
def _(t):
    mean = rated(t).groupBy("review").agg(vx.mean_vector(F.col("vec")).alias("m"))
    return mean.select("review", F.posexplode("m").alias("k", "x")).select("review", "k", F.round("x", 6).alias("x"))


@query("e12_mask_split", """SELECT id, CASE WHEN s > 0.3 THEN mask END AS mask FROM mask_best""")
def _(t):
    return mk.assign_masks(t.vectors, "vec", t.masks, 0.3).select("id", "mask")


@query("e12_cluster_unassigned", dbscan_sql("pts AS (SELECT CAST(v.product AS VARCHAR) AS g, v.id, vec FROM vectors v JOIN mask_best b ON b.id = v.id WHERE s <= 0.3)",
       "SELECT a.g, a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.g = b.g AND 1 - list_cosine_similarity(a.vec, b.vec) <= 0.75 + 1e-9", "pts", 3)
       + " WHERE coalesce(l.label, b.label, -1) >= 0")
def _(t):
    from opinara.operators import density

    _yes, no = mk.split_by_mask(t.vectors, "vec", t.masks, 0.3)
    return density.dbscan(no, "product", "id", "vec", eps=0.75, min_pts=3).where("label >= 0")
