"""Clustering on the vector and part tables."""

from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.operators import density as dn
from opinara.operators import forest as fo
from opinara.operators import hierarchy as hy
from opinara.operators import masks as mk
from opinara.operators import partition as pt
from opinara.operators import reviews as rv
from opinara.operators import textflow as tf
from opinara.operators import wordvectors as wv
from opinara.plans.q_textflow import CLIMB, NOUNS, stop_array
from opinara.plans.registry import query
from opinara.session import cut, spread


def part_points(t):
    from opinara.operators import tables as tb

    scaled = tb.min_max_scaled(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return scaled.select(F.lit("all").alias("g"), F.col("p_partkey").alias("id"), F.array("p_size", "p_retailprice").alias("vec"))


SCALED = """scaled AS (SELECT p_partkey AS id, (p_size - s0) / (s1 - s0) AS x, (p_retailprice - r0) / (r1 - r0) AS y FROM part,
    (SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS r0, max(p_retailprice) AS r1 FROM part))"""


def dbscan_sql(points, near, key, min_pts):
    """DBSCAN by recursion over the full edge list."""
    return f"""WITH RECURSIVE {points}, near AS ({near}), core AS (SELECT g, a AS id FROM near GROUP BY ALL HAVING count(*) >= {min_pts}),
    ce AS (SELECT n.g, n.a, n.b FROM near n JOIN core x ON x.g = n.g AND x.id = n.a JOIN core y ON y.g = n.g AND y.id = n.b),
    reach(g, id, root) USING KEY (g, id) AS (SELECT g, id, id FROM core UNION
        SELECT e.g, e.a, min(r.root) FROM reach r JOIN ce e ON e.g = r.g AND e.b = r.id JOIN recurring.reach c ON c.g = e.g AND c.id = e.a
        WHERE r.root < c.root GROUP BY ALL),
    lab AS (SELECT g, id, root AS label FROM reach),
    border AS (SELECT n.g, n.a AS id, min(l.label) AS label FROM near n JOIN lab l ON l.g = n.g AND l.id = n.b
        WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.g = n.g AND c.id = n.a) GROUP BY n.g, n.a)
    SELECT p.g, p.id, coalesce(l.label, b.label, -1) AS label FROM {key} p LEFT JOIN lab l ON l.g = p.g AND l.id = p.id
        LEFT JOIN border b ON b.g = p.g AND b.id = p.id"""


@query("c4_dbscan", dbscan_sql(SCALED + ", pts AS (SELECT 'all' AS g, id, x, y FROM scaled)",
       "SELECT a.g, a.id AS a, b.id AS b FROM pts a JOIN pts b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02 + 1e-9", "pts", 4))
def _(t):
    return dn.dbscan(part_points(t), "g", "id", "vec", 0.02, 4, "euclidean")


@query("c5_dbscan_cosine", dbscan_sql("pts AS (SELECT CAST(product AS VARCHAR) AS g, id, vec FROM vectors)",
       "SELECT a.g, a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.g = b.g AND 1 - list_cosine_similarity(a.vec, b.vec) <= 0.75 + 1e-9", "pts", 3))
def _(t):
    return dn.dbscan(t.vectors, "product", "id", "vec", 0.75, 3)


@query("c8_hdbscan")
def _(t):
    return dn.hdbscan(t.vectors, "product", "id", "vec", 3, 3)


# The grid's size, 15 radii and the minimum sizes 3 to 49; the radii suit two features in [0, 1].
GRID_EPS, GRID_MIN = [0.005 * i for i in range(1, 16)], list(range(3, 50))


def grid(t):
    return dn.sizes_report(dn.grid_sizes(part_points(t), "g", "id", "vec", GRID_EPS, GRID_MIN, "euclidean"))


@query("c6_dbscan_grid")
def _(t):
    return grid(t)


@query("c7_usable_cells")
def _(t):
    return dn.usable_cells(grid(t))


#: Five falling distances, spaced as the operator's own, where these vectors have neighbours.
STEPS = (0.8, 0.75, 0.7, 0.65, 0.6)


def clustered(t):
    """g, id, vec, n_words, cluster: one starting cluster per product."""
    words = t.reviews.select("id", tx.count_words(F.col("text")).alias("n_words"))
    rows = t.vectors.join(words, "id")
    return rows.select(F.col("product").cast("string").alias("g"), "id", "vec", "n_words", F.lit("0").alias("cluster"))


def split_sql(steps) -> str:
    """The falling distances one after another: DBSCAN inside every cluster above its product's threshold."""
    parts = [r"""r0 AS (SELECT CAST(v.product AS VARCHAR) AS g, v.id, v.vec, '0' AS cluster, len(list_filter(string_split_regex(r.text, '\s+'), lambda x: x <> '')) AS n
        FROM vectors v JOIN reviews r ON r.id = v.id)""", """most AS (SELECT g, CASE WHEN w > 20 THEN w / 2 ELSE w END AS most FROM (SELECT g, sum(n) + count(*) - 1 AS w FROM r0 GROUP BY g))"""]
    for i, e in enumerate(steps):
        parts.append(f"""in{i} AS (SELECT g || chr(1) || cluster AS gk, id, vec FROM r{i} WHERE (g, cluster) IN (
            SELECT (g, cluster) FROM (SELECT g, cluster, sum(n) + count(*) - 1 AS w FROM r{i} GROUP BY ALL) JOIN most USING (g) WHERE w > most)),
        near{i} AS (SELECT a.gk, a.id AS a, b.id AS b FROM in{i} a JOIN in{i} b ON a.gk = b.gk AND 1 - list_cosine_similarity(a.vec, b.vec) <= {e} + 1e-9),
        core{i} AS (SELECT gk, a AS id FROM near{i} GROUP BY ALL HAVING count(*) >= 3),
        ce{i} AS (SELECT n.* FROM near{i} n JOIN core{i} x ON x.gk = n.gk AND x.id = n.a JOIN core{i} y ON y.gk = n.gk AND y.id = n.b),
        reach{i}(gk, id, root) USING KEY (gk, id) AS (SELECT gk, id, id FROM core{i} UNION SELECT e.gk, e.a, min(r.root) FROM reach{i} r JOIN ce{i} e ON e.gk = r.gk AND e.b = r.id
            JOIN recurring.reach{i} c ON c.gk = e.gk AND c.id = e.a WHERE r.root < c.root GROUP BY ALL),
        lab{i} AS (SELECT gk, id, root AS label FROM reach{i} UNION ALL SELECT n.gk, n.a, min(l.root) FROM near{i} n JOIN reach{i} l ON l.gk = n.gk AND l.id = n.b
            WHERE (n.gk, n.a) NOT IN (SELECT (gk, id) FROM core{i}) GROUP BY n.gk, n.a),
        many{i} AS (SELECT gk FROM lab{i} GROUP BY gk HAVING count(DISTINCT label) > 1),
        r{i + 1} AS (SELECT g, id, vec, cluster, n FROM r{i} WHERE g || chr(1) || cluster NOT IN (SELECT gk FROM many{i}) UNION ALL
            SELECT r.g, r.id, r.vec, r.cluster || chr(1) || l.label, r.n FROM r{i} r JOIN lab{i} l ON l.gk = r.g || chr(1) || r.cluster AND l.id = r.id WHERE l.gk IN (SELECT gk FROM many{i}))""")
    return f"WITH RECURSIVE {', '.join(parts)}, done AS (SELECT g, id, cluster FROM r{len(steps)})"


@query("c9_recursive_split", f"{split_sql(STEPS)} SELECT g, id, cluster FROM done")
def _(t):
    rows = clustered(t)
    limit = rv.word_threshold(rv.cluster_words(rows))
    return rv.split_large(rows, limit, steps=STEPS).select("g", "id", "cluster")


@query("c10_word_threshold", r"""WITH w AS (SELECT product AS g, rating AS cluster, CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) + count(*) - 1 AS BIGINT) AS words
    FROM reviews GROUP BY ALL) SELECT g, CASE WHEN count(*) = 1 THEN CASE WHEN max(words) > 20 THEN max(words) / 2 ELSE max(words) END ELSE least(avg(words) * 1.5, 250) END AS threshold FROM w GROUP BY g""")
def _(t):
    rows = t.reviews.select(F.col("product").alias("g"), F.col("rating").alias("cluster"), tx.count_words(F.col("text")).alias("n_words"))
    return rv.word_threshold(rv.cluster_words(rows))


@query("c11_at_least_three", f"{split_sql(STEPS)} SELECT g, cluster, count(*) AS n FROM done GROUP BY ALL")
def _(t):
    rows = clustered(t)
    few = rows.select("g", "cluster").distinct().groupBy("g").agg(F.count("*").alias("k")).where("k < 3").select("g")
    out = rv.split_large(rows, rv.word_threshold(rv.cluster_words(rows)), only=few, steps=STEPS)
    return out.groupBy("g", "cluster").agg(F.count("*").alias("n"))


@query("c12_ward_per_product")
def _(t):
    return hy.ward_by_distance(t.vectors, "product", "id", "vec", max_distance=3.2, unit=True)


def kmeans_sql(k: int, rounds: int, rows: str = "dims") -> str:
    """Farthest-first starts and ``rounds`` Lloyd steps over the components of all products."""
    near = lambda r: (
        f"d{r} AS (SELECT x.g, x.id, m.c, sum((x.v - m.v) * (x.v - m.v)) AS d FROM x JOIN {{0}} m ON m.g = x.g AND m.pos = x.pos GROUP BY ALL), "
        f"a{r} AS (SELECT g, id, min(d) AS d, min_by(c, (d, c)) AS c FROM d{r} GROUP BY g, id)")
    start = lambda j: near(f"s{j}").format(f"m{j}") + (
        f", f{j} AS (SELECT g, max_by(id, (d, -id)) AS id FROM as{j} GROUP BY g HAVING max(d) > 0), "
        f"m{j + 1} AS (SELECT g, c, pos, v FROM m{j} UNION ALL SELECT x.g, {j + 1}, pos, v FROM x JOIN f{j} USING (g, id))")
    step = lambda r: near(r).format(f"c{r}") + (
        f", c{r + 1} AS (SELECT m.g, m.c, m.pos, coalesce(u.v, m.v) AS v FROM c{r} m LEFT JOIN (SELECT x.g, a.c, x.pos, avg(x.v) AS v "
        f"FROM x JOIN a{r} a ON a.g = x.g AND a.id = x.id GROUP BY ALL) u ON u.g = m.g AND u.c = m.c AND u.pos = m.pos)")
    return f"""WITH x AS (SELECT CAST(product AS VARCHAR) AS g, id, k AS pos, x AS v FROM {rows}),
    m0 AS (SELECT g, 0 AS c, pos, v FROM x WHERE (g, id) IN (SELECT g, min(id) FROM x GROUP BY g)),
    {", ".join(start(j) for j in range(k - 1))}, c0 AS (SELECT * FROM m{k - 1}), {", ".join(step(r) for r in range(rounds))}, {near(rounds).format(f"c{rounds}")}
    SELECT g, id, CAST(c AS INTEGER) AS cluster, round(d, 6) AS d2 FROM a{rounds}"""


@query("c13_kmeans_per_product", kmeans_sql(5, 30))
def _(t):
    out = pt.kmeans_groups(t.vectors, "product", "id", "vec", k=5)
    return out.select("g", "id", "cluster", F.round("d2", 6).alias("d2"))


@query("c19_ward_rows")
def _(t):
    return hy.ward_by_count(part_points(t), "g", "id", "vec", clusters=4)


@query("c19_ward_distance")
def _(t):
    import opinara.operators.tables as tb

    scaled = tb.standard_scaled(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    rows = scaled.select(F.lit("all").alias("g"), F.col("p_partkey").alias("id"), F.array("p_size", "p_retailprice").alias("vec"))
    return hy.ward_by_distance(rows, "g", "id", "vec", max_distance=25.0)


@query("c21_self_organising_map")
def _(t):
    import opinara.operators.tables as tb

    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scaled = tb.min_max_scaled(t.lineitem.select("l_orderkey", "l_linenumber", *cols), cols)
    rows = spread(scaled.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(*cols).alias("vec")))
    codebook, _errors = pt.train_map(rows, "id", "vec", width=20, height=20, epochs=6)
    units = pt.project(rows, "id", "vec", codebook).groupBy("unit").agg(F.count("*").alias("n"), F.avg("error").alias("error"))
    book = pt.codebook_frame(t.spark, codebook)
    groups = pt.kmeans_groups(book.withColumn("g", F.lit("map")), "g", "unit", "weights", k=3).select(F.col("id").cast("int").alias("unit"), F.col("cluster"))
    return book.join(groups, "unit").join(units, "unit", "left").select(
        "unit", "cluster", "n", "error", F.get("weights", F.lit(0)).alias("feature_0")).orderBy(F.desc("feature_0"))


@query("c22_adjectives_per_cluster", f"""WITH RECURSIVE {CLIMB}, {NOUNS} SELECT cluster, noun, adj, count(*) AS n FROM nouns JOIN (
    SELECT id, spos, clause, lemma AS adj FROM members WHERE tag = 'ADJ' AND length(lemma) > 1) USING (id, spos, clause)
    JOIN (SELECT id, rating AS cluster FROM reviews) USING (id) WHERE cluster IN (1, 3, 5) GROUP BY cluster, noun, adj HAVING n > 2""")
def _(t):
    found = tf.clauses(t.annotated, ["id", "spos"]).join(t.reviews.select("id", F.col("rating").alias("cluster")), "id")
    chosen = stop_array(found.where(F.col("cluster").isin(1, 3, 5)), t)
    return tf.adjectives_per_noun(chosen, F.col("stop"), at_least=3, extra=("cluster",))


def nearest(t):
    """The ten nearest rows to every tenth row."""
    return fo.nearest_rows(t.vectors, "id", "vec", t.vectors.where("id % 10 = 0").select(F.col("id").alias("qid"), "vec"), k=10)


@query("e4_nearest_neighbours")
def _(t):
    return nearest(t).rows.select("qid", "id", F.round("sim", 9).alias("sim"), "rk")


@query("e4_recall", """WITH q AS (SELECT id AS qid, vec FROM vectors WHERE id % 10 = 0) SELECT qid, CAST(10 AS BIGINT) AS found, true AS first_is_itself FROM q""")
def _(t):
    found = nearest(t)
    if found.recall < 0.9:
        raise RuntimeError(f"recall {found.recall}")
    return found.rows.groupBy("qid").agg(F.count("*").alias("found"), F.max((F.col("rk") == 1) & (F.col("sim") > 0.999999)).alias("first_is_itself"))


def sentence_table(t, least: int = 5):
    """Every sentence of every text that has a learned vector, named by its text and its place there."""
    said = t.sentences.select("id", "spos", "sentence", "rating", "category").join(t.vectors.select("id", F.concat(F.lit("p"), "product").alias("product")), "id")
    said = cut(said)
    rows = wv.mean_vectors(said, ["id", "spos"], "sentence", wv.word_vectors(said, "sentence", size=32, least=least)).where(F.col("vec").isNotNull())
    key = F.shiftleft("id", 24) + F.col("spos")
    return rows.select(key.alias("id"), F.lit("all").alias("category"), "product", "rating", "sentence", "vec", F.lit(1).alias("prediction"))


@query("r13_review_clusters")
def _(t):
    return rv.cluster_reviews(sentence_table(t), "dbscan", min_words=3, eps=0.22, min_pts=3)


def product_rows(t):
    words = t.reviews.select("id", "category", "url", "rating", tx.count_words(F.col("text")).alias("n_words"))
    return t.vectors.join(words, "id")


def product_clusters_sql(labels: str) -> str:
    """The summary of clusters that ``labels`` (WITH ... SELECT g, id, cluster) gives."""
    at = labels.rindex("SELECT g, id,")
    return rf"""{labels[:at].rstrip()}, lab AS ({labels[at:]}),
    rowset AS (SELECT l.g, CAST(l.cluster AS VARCHAR) AS cluster, l.id, v.vec, r.category, r.url, r.rating, len(list_filter(string_split_regex(r.text, '\s+'), lambda x: x <> '')) AS words
        FROM lab l JOIN vectors v ON v.id = l.id JOIN reviews r ON r.id = l.id),
    apart AS (SELECT a.g, a.cluster, avg(1 - list_cosine_similarity(a.vec, b.vec)) AS d FROM rowset a JOIN rowset b ON a.g = b.g AND a.cluster = b.cluster AND a.id < b.id GROUP BY ALL)
    SELECT g, cluster, min_by(category, id) AS category, min_by(url, id) AS url, round(avg(rating), 6) AS rating_mean, count(*) AS elem_count, CAST(sum(words) AS BIGINT) AS word_count,
        round(coalesce(any_value(d), 0), 6) AS mean_distance FROM rowset LEFT JOIN apart USING (g, cluster) GROUP BY g, cluster"""


@query("r14_product_clusters_kmeans", product_clusters_sql(kmeans_sql(5, 30, "dims WHERE id IN (SELECT id FROM reviews)")))
def _(t):
    out = rv.cluster_product_reviews(product_rows(t), "kmeans", k=5)
    return out.withColumns({c: F.round(c, 6) for c in ("rating_mean", "mean_distance")})


@query("r14_product_clusters_hdbscan")
def _(t):
    return rv.cluster_product_reviews(product_rows(t), "hdbscan")


@query("r14_product_clusters_hierarchical")
def _(t):
    return rv.cluster_product_reviews(product_rows(t), "hierarchical", max_distance=3.2)


@query("a7_cluster_summary", r"""SELECT CAST(v.product AS VARCHAR) AS g, CAST(r.rating AS VARCHAR) AS cluster, min_by(r.category, v.id) AS category, min_by(r.url, v.id) AS url,
    round(avg(r.rating), 6) AS rating_mean, count(*) AS elem_count, CAST(sum(len(list_filter(string_split_regex(r.text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS word_count
    FROM vectors v JOIN reviews r ON r.id = v.id GROUP BY ALL""")
def _(t):
    rows = product_rows(t).withColumns({"g": F.col("product").cast("string"), "cluster": F.col("rating").cast("string")})
    return rv.summarise_clusters(rows).select(
        "g", "cluster", "category", "url", F.round("rating_mean", 6).alias("rating_mean"), "elem_count", "word_count")
