"""Splits, text features, classifiers and reports."""

from pyspark.sql import functions as F

from opinara.functions import vectors as vx
from opinara.operators import groups as gr
from opinara.operators import models as md
from opinara.operators import tables as tb
from opinara.operators import wordvectors as wv
from opinara.plans.registry import query
from opinara.session import cut
from opinara.sources import files


def labelled(t):
    lab = t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    return t.reviews.select("id", "text").join(lab, "id")


@query("m1_hash_split")
def _(t):
    train, test = md.hash_split(t.reviews.select("id"), "id", 0.7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count("*").alias("n"))


@query("m2_stratified_split", """SELECT quality, count(*) AS n, CAST(ceil(count(*) * 0.1) AS BIGINT) AS held FROM labels GROUP BY quality""")
def _(t):
    train, held = md.stratified_split(t.labels, "doc_id", "quality", 0.1)
    both = train.withColumn("h", F.lit(0)).unionByName(held.withColumn("h", F.lit(1)))
    return both.groupBy("quality").agg(F.count("*").alias("n"), F.sum("h").alias("held"))


@query("m3_clean_labels", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN id % 4 - 1 = 2 THEN 0 ELSE id % 4 - 1 END AS label FROM reviews) WHERE label >= 0 GROUP BY label")
def _(t):
    rows = t.reviews.select((F.col("id") % 4 - 1).alias("label"))
    return tb.value_counts(md.clean_labels(rows), "label")


@query("m4_tfidf", r"""WITH tk AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1)) AS term FROM reviews),
    tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM reviews)) / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (term))
    SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM raw""")
def _(t):
    return md.tfidf(t.reviews.select("id", "text"), ["id"], "text").select("id", "term", F.round("weight", 6).alias("weight"))


@query("m5_boosted_trees")
def _(t):
    train, test = md.hash_split(labelled(t), "id")
    model = md.boosted_trees(train, "text", "quality", trees=10, depth=4, features=256)
    return md.classification_report(model.transform(test), "quality", "prediction")


@query("m6_grid_search")
def _(t):
    cv = md.grid_search(labelled(t), "text", "quality", trees=(5, 10), depths=(4,), features=256)
    return t.spark.createDataFrame([(i, float(a)) for i, a in enumerate(cv.avgMetrics)], "setting int, accuracy double")


@query("m7_ranked_predictions")
def _(t):
    train, test = md.hash_split(labelled(t), "id")
    return md.ranked_predictions(md.usefulness_model(train, "text", "quality"), test, "id")


@query("m8_useful_sentences")
def _(t):
    model = md.usefulness_model(labelled(t), "text", "quality")
    rows = t.sentences.select("id", "spos", F.col("sentence").alias("text"))
    return md.predict_useful(model, rows, "text").select("id", "spos", "probability_1", "prediction")


@query("m9_sentiment_scores")
def _(t):
    train = t.reviews.select("text", F.concat(F.lit("r"), "rating").alias("label"))
    scored = md.sentiment_scores(md.sentiment_model(train, "text", "label"), t.reviews.select("id", "text"), "text")
    return scored.select("id", *[F.bround(F.element_at("scores", f"r{i}"), 2).alias(f"r{i}_text") for i in range(1, 6)])


@query("m10_report", """WITH c AS (SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY ALL),
    l AS (SELECT y AS label FROM c UNION SELECT p FROM c),
    s AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE y = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS called,
        coalesce((SELECT sum(n) FROM c WHERE y = label AND p = label), 0) AS hit FROM l),
    r AS (SELECT label, coalesce(hit / nullif(called, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support FROM s)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support,
        round((SELECT sum(n) FILTER (y = p) / sum(n) FROM c), 6) AS accuracy FROM r""")
def _(t):
    rep = md.classification_report(t.labels, "quality", "toxic")
    return rep.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", F.round("accuracy", 6).alias("accuracy"))


SWEEP = """th AS (SELECT (10 + 5 * i) / 100 AS threshold FROM range(16) r(i)),
    d AS (SELECT event_type = 'purchase' AS y, value / (value + 10) AS s FROM events),
    m AS (SELECT threshold, count(*) FILTER (y AND s > threshold) AS tp, count(*) FILTER (s > threshold) AS called, count(*) FILTER (y) AS pos,
        count(*) FILTER ((s > threshold) = y) AS ok, count(*) AS n FROM d, th GROUP BY threshold),
    pr AS (SELECT *, coalesce(tp / nullif(called, 0), 0) AS p, coalesce(tp / nullif(pos, 0), 0) AS r FROM m),
    f AS (SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(ok / n, 6) AS accuracy FROM pr)"""


def sweep(t):
    df = t.events.select((F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("value") / (F.col("value") + 10)).alias("s"))
    return md.threshold_sweep(df, "y", "s").select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("m11_threshold_sweep", f"WITH {SWEEP} SELECT * FROM f")
def _(t):
    return sweep(t)


@query("m11_best_threshold", f"WITH {SWEEP} SELECT * FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def _(t):
    return md.best_threshold(sweep(t))


@query("m12_saved_model")
def _(t):
    path = files.scratch(t.spark, "model")
    md.save_model(md.usefulness_model(labelled(t), "text", "quality"), path)
    return md.ranked_predictions(md.load_model(path), labelled(t), "id")


INFORMATION = r"""counts AS (SELECT a, b, count(*) AS n FROM (SELECT x.word AS a, y.word AS b FROM words x JOIN words y ON x.id = y.id AND x.spos = y.spos
        AND abs(x.wpos - y.wpos) BETWEEN 1 AND 5) WHERE a IN (SELECT word FROM vocabulary WHERE n >= 20) AND b IN (SELECT word FROM vocabulary WHERE n >= 20) GROUP BY a, b),
    sides AS (SELECT a, sum(n) AS s FROM counts GROUP BY a)"""


@query("e1_word_information", f"""WITH {INFORMATION} SELECT a, b, round(x, 9) AS x FROM (SELECT c.a, c.b, ln(n * (SELECT sum(n) FROM counts) / (l.s * r.s)) AS x
    FROM counts c JOIN sides l ON l.a = c.a JOIN sides r ON r.a = c.b) WHERE x > 0""")
def _(t):
    words = cut(wv.frequent_words(t.sentences, "sentence", least=20))
    return wv.positive_information(cut(wv.cooccurrences(t.sentences, "sentence", words))).select("a", "b", F.round("x", 9).alias("x"))


@query("e1_embed", f"""WITH {INFORMATION}, known AS (SELECT DISTINCT c.a AS word FROM counts c JOIN sides l ON l.a = c.a JOIN sides r ON r.a = c.b
        WHERE n * (SELECT sum(n) FROM counts) > l.s * r.s)
    SELECT s.id, s.spos, count(k.word) AS n_known, CASE WHEN count(k.word) > 0 THEN CAST(1 AS DOUBLE) END AS length FROM sentences s
    LEFT JOIN words w ON w.id = s.id AND w.spos = s.spos LEFT JOIN known k ON k.word = w.word GROUP BY s.id, s.spos""")
def _(t):
    """Sentence vectors of learned word vectors: which words have one, and their unit length."""
    said = t.sentences.select("id", "spos", "sentence")
    learned = wv.word_vectors(said, "sentence", size=32, least=20)
    return wv.mean_vectors(said, ["id", "spos"], "sentence", learned).select("id", "spos", "n_known", F.round(vx.norm(F.col("vec")), 9).alias("length"))


@query("x1_batched_map", "SELECT id, length(text) AS n FROM reviews")
def _(t):
    def measure(batches):
        for pdf in batches:
            yield pdf.assign(n=pdf["text"].str.len())[["id", "n"]]

    return t.reviews.select("id", "text").mapInPandas(measure, "id long, n long")


@query("x2_group_function", """SELECT user_id, count(*) AS n, round(max(value) - min(value), 4) AS spread, round(var_samp(value), 4) AS variance,
    list_reverse_sort(list(value))[:3] AS largest FROM events GROUP BY user_id""")
def _(t):
    """Spread, running variance and largest values of a user, by a function of one's own."""
    import numpy as np
    import pandas as pd

    def update(s, rows):
        x = rows["value"].to_numpy(float)
        return merge(s, (len(x), x.mean(), ((x - x.mean()) ** 2).sum(), x.min(), x.max(), sorted(x.tolist(), reverse=True)[:3]))

    def merge(a, b):
        if not a[0]:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return (n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4]), sorted(a[5] + b[5], reverse=True)[:3])

    def finish(s):
        variance = s[2] / (s[0] - 1) if s[0] > 1 else np.nan
        return pd.DataFrame({"n": [s[0]], "spread": [s[4] - s[3]], "variance": [variance], "largest": [s[5]]})

    fold = gr.Fold(lambda: (0, 0.0, 0.0, np.inf, -np.inf, []), update, merge, finish)
    out = gr.fold_groups(t.events.select("user_id", "value").where("value IS NOT NULL"), ["user_id"], fold, "n long, spread double, variance double, largest array<double>")
    return out.select("user_id", "n", F.round("spread", 4).alias("spread"), F.round(F.nanvl("variance", F.lit(None)), 4).alias("variance"), "largest")


@query("x3_class_scorer", """SELECT round(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 6) AS precision FROM labels""")
def _(t):
    return md.classification_report(t.labels, "quality", "toxic").where("label = 1").select(F.round("precision", 6).alias("precision"))
