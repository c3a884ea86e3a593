"""Text features, splits, classifiers and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opinara.functions import text as tx
from opinara.operators.phrases import checked_small
from opinara.session import cut


def long_terms(c: Column) -> Column:
    """Lower-case terms of two characters and more."""
    return F.filter(tx.term_list(c), lambda w: F.length(w) > 1)


def tfidf(docs: DataFrame, keys: list[str], text: str, within: list[str] | None = None) -> DataFrame:
    """keys, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), unit length per document.

    The texts are dealt by ``within`` (some of the keys, all by default) once; their terms,
    many times larger, are counted and weighted where they are and stay dealt so.  Documents
    with a null key count for ``df`` only."""
    dealt = docs.select(*keys, text).repartition(*(within or keys))
    counts = dealt.select(*keys, F.explode(long_terms(F.col(text))).alias("term")).groupBy(*keys, "term").agg(
        F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    idf = df.withColumn("n", total.scalar()).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(checked_small(cut(idf)), "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("x")).na.drop(subset=keys)
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("x") / size).alias("weight"))


def centroid_scores(weights: DataFrame, groups: list[str], key: list[str]) -> DataFrame:
    """Cosine of every sparse document to the centroid of its group."""
    centre = weights.groupBy(*groups, "term").agg(F.sum("weight").alias("c"))
    size = centre.groupBy(*groups).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("len"))
    dots = weights.join(centre, [*groups, "term"]).groupBy(*groups, *key).agg(F.sum(F.col("weight") * F.col("c")).alias("d"))
    return dots.join(size, groups).select(*groups, *key, F.round(F.col("d") / F.col("len"), 9).alias("sim"))


def extractive_summary(sentences: DataFrame, keys: list[str], order: str, text: str, top: int = 3) -> DataFrame:
    """The ``top`` sentences nearest to the centroid of their text, in text order.

    A centroid belongs to one text, so sums over it need no further shuffle; its square is
    the sum of its products with the text's own sentences."""
    weights = tfidf(sentences, [*keys, order], text, within=keys)
    centre = F.sum("weight").over(W.partitionBy(*keys, "term"))
    dots = weights.withColumn("c", centre).groupBy(*keys, order).agg(F.sum(F.col("weight") * F.col("c")).alias("d"))
    size = F.sqrt(F.sum("d").over(W.partitionBy(*keys)))
    sims = dots.select(*keys, order, F.round(F.col("d") / size, 9).alias("sim"))
    rk = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sim"), order))
    picked = sims.withColumn("rk", rk).where(F.col("rk") <= top).join(sentences.select(*keys, order, text), [*keys, order])
    return picked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("s")).select(
        *keys, F.array_join(F.transform("s", lambda x: x[text]), ". ").alias("summary"))


def key_texts(texts: DataFrame, groups: list[str], key: str, text: str) -> DataFrame:
    """The text nearest to the centroid of its group; ties to the smaller key."""
    sims = centroid_scores(tfidf(texts, [*groups, key], text), groups, [key])
    best = sims.groupBy(*groups).agg(F.max(F.struct("sim", (-F.col(key)).alias("i"))).alias("b"))
    return best.select(*groups, (-F.col("b.i")).alias(key)).join(texts.select(*groups, key, text), [*groups, key])


# --- splits -------------------------------------------------------------------------------


def hash_split(df: DataFrame, key: str, share: float = 0.7, seed: int = 110) -> tuple[DataFrame, DataFrame]:
    """The same rows on every run and layout: the key's hash decides."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    cut = F.lit(int(share * 10_000))
    return df.where(at < cut), df.where(at >= cut)


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, held out) with ceil(share * n) rows of every label held out.

    The rows of a label fall into 1,000 hash buckets; whole buckets are taken up to
    the wanted number and only the last bucket is ordered, so no label is sorted."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod(h, F.lit(1000)))
    per = rows.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    run = W.partitionBy(label).orderBy("_b")
    per = per.withColumn("_end", F.sum("_c").over(run)).withColumn(
        "_want", F.ceil(F.sum("_c").over(W.partitionBy(label)) * share))
    rows = rows.join(per, [label, "_b"])
    before = F.col("_end") - F.col("_c")
    border = (before < F.col("_want")) & (F.col("_want") < F.col("_end"))
    inside = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key))
    held = rows.where(~border).withColumn("_held", F.col("_end") <= F.col("_want")).unionByName(
        rows.where(border).withColumn("_held", before + inside <= F.col("_want")))
    drop = ["_h", "_b", "_c", "_end", "_want", "_held"]
    return held.where(~F.col("_held")).drop(*drop), held.where("_held").drop(*drop)


def clean_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Label 2 counts as 0, negative labels fall out."""
    return df.withColumn(label, F.when(F.col(label) == 2, 0).otherwise(F.col(label))).where(F.col(label) >= 0)


# --- classifiers ---------------------------------------------------------------------------


def text_stages(text: str, features: int = 1 << 14) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_w", gaps=False, pattern=r"[\p{L}\p{N}_]{2,}"),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features"),
    ]


def embed(df: DataFrame, text: str, features: int = 256, model: PipelineModel | None = None, name: str = "vec") -> DataFrame:
    """Unit TF-IDF vector per text; a null or blank text gets the zero vector.

    Any fitted pipeline with a ``features`` output can stand in as ``model``."""
    filled = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    model = model or Pipeline(stages=text_stages("_t", features)).fit(filled)
    return model.transform(filled).withColumn(name, vector_to_array("features", "float32")).select(*df.columns, name)


def usefulness_model(train: DataFrame, text: str, label: str) -> PipelineModel:
    return Pipeline(stages=[*text_stages(text), LogisticRegression(labelCol=label, maxIter=20, regParam=0.01)]).fit(train)


def predict_useful(model: PipelineModel, df: DataFrame, text: str, threshold: float = 0.7) -> DataFrame:
    """``probability_1`` and ``prediction`` on the row; a blank text is never useful."""
    safe = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    scored = model.transform(safe).withColumn("probability_1", F.get(vector_to_array("probability"), F.lit(1)))
    useful = (F.col("probability_1") > threshold) & (F.length(F.trim(text)) > 0)
    return scored.withColumn("useful", useful.cast("int")).select(*df.columns, "probability_1", F.col("useful").alias("prediction"))


def sentiment_model(train: DataFrame, text: str, label: str) -> PipelineModel:
    """Multinomial model over text labels; the scores come out as a map."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, *text_stages(text), LogisticRegression(labelCol="_y", maxIter=20, regParam=0.01)]).fit(train)


def sentiment_scores(model: PipelineModel, phrases: DataFrame, text: str) -> DataFrame:
    """Each distinct phrase scored once and joined back: map label -> probability."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    once = PipelineModel(model.stages[1:]).transform(phrases.select(text).where(F.col(text).isNotNull()).distinct())
    scored = once.select(text, F.map_from_arrays(labels, vector_to_array("probability")).alias("scores"))
    return phrases.join(scored, text, "left")


def boosted_trees(train: DataFrame, text: str, label: str, trees: int = 60, depth: int = 9, classes: int = 2,
                  features: int = 1 << 10) -> PipelineModel:
    """Gradient boosted trees on text; more than two classes as one against the rest."""
    gbt = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=110)
    last = gbt if classes == 2 else OneVsRest(classifier=gbt, labelCol=label)
    return Pipeline(stages=[*text_stages(text, features), last]).fit(train)


def grid_search(train: DataFrame, text: str, label: str, trees: tuple[int, ...] = (10, 20), depths: tuple[int, ...] = (5,),
                folds: int = 5, features: int = 1 << 10):
    forest = RandomForestClassifier(labelCol=label, seed=110)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    score = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return CrossValidator(estimator=Pipeline(stages=[*text_stages(text, features), forest]), estimatorParamMaps=grid,
                          evaluator=score, numFolds=folds, parallelism=4, seed=110).fit(train)


def with_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``prediction`` and ``probabilities`` (an array, one for each class).  One-against-rest
    models give each class the share that its own model's probability has in their sum."""
    last = model.stages[-1]
    if not isinstance(last, OneVsRestModel):
        return model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    out = last.transform(PipelineModel(model.stages[:-1]).transform(df))
    for i, one in enumerate(last.models):
        one = one.copy().setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
        out = one.transform(out).withColumn(f"_p{i}", F.get(vector_to_array(f"_p{i}"), F.lit(1))).drop(f"_r{i}", f"_y{i}")
    each = [F.col(f"_p{i}") for i in range(len(last.models))]
    total = sum(each[1:], each[0])
    return out.withColumn("probabilities", F.array(*[F.try_divide(p, total) for p in each])).drop(*[f"_p{i}" for i in range(len(each))])


def ranked_predictions(model: PipelineModel, df: DataFrame, key: str, cls: int = 1) -> DataFrame:
    out = with_probabilities(model, df).withColumn("p", F.get("probabilities", F.lit(cls)))
    return out.select(key, F.col("prediction").cast("int").alias("prediction"), "p").orderBy(F.desc("p"), key)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- evaluation ------------------------------------------------------------------------------


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, precision, recall, f1, support per class, and the overall accuracy."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hit")])
    all_ = cells.agg(F.try_divide(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)), F.sum("n")).alias("a"))
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hit", "called"), zero), F.coalesce(F.try_divide("hit", "support"), zero)
    return per.select("label", p.alias("precision"), r.alias("recall"),
                      F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"), "support").withColumn("accuracy", all_.scalar())


def threshold_sweep(df: DataFrame, label: str, score: str, start: int = 10, stop: int = 85, step: int = 5) -> DataFrame:
    """threshold, precision, recall, f1, accuracy for each threshold, in one pass.

    Rows are counted by the number of thresholds they pass (a few dozen groups);
    the sweep is over those counts."""
    cuts = [i / 100 for i in range(start, stop + 1, step)]
    passed = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(score) > c))
    bins = df.groupBy(passed.alias("k")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("threshold")) for i, c in enumerate(cuts)]))
    wide = bins.select("k", "pos", "n", every.alias("t")).select("k", "pos", "n", "t.*")
    above = F.col("k") > F.col("i")
    sums = wide.groupBy("threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("n")).otherwise(0)).alias("called"),
        F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("tp", "called"), zero), F.coalesce(F.try_divide("tp", "pos"), zero)
    right = F.col("n") - F.col("called") - F.col("pos") + 2 * F.col("tp")
    return sums.select("threshold", p.alias("precision"), r.alias("recall"),
                       F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"), F.try_divide(right, F.col("n")).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the best f1; the lowest threshold wins a tie."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)
