"""Sources and sinks: round trips through files, pages, links, menus."""

from pyspark.sql import functions as F

from opinara.operators import tables as tb
from opinara.plans.q_textflow import CORRECTED
from opinara.plans.q_vectors import SENTENCE_LABELS, embedded, unembedded_sentences
from opinara.plans.registry import query
from opinara.sources import files, pages
from opinara.streaming import jobs as st

REVIEWS = "SELECT id, text, product, category, rating, url FROM reviews"


@query("s1_load_reviews", REVIEWS)
def _(t):
    path = files.scratch(t.spark, "csv")
    files.write_csv(t.reviews, path)
    return files.load_reviews(t.spark, path)


@query("s2_recursive_union", "SELECT id, product, rating FROM reviews")
def _(t):
    path = files.scratch(t.spark, "tree")
    for part in ("a", "b"):
        files.write_csv(t.reviews.where((F.col("rating") > 3) == (part == "a")), f"{path}/{part}/files")
    return files.load_reviews(t.spark, path, recursive=True).select("id", "product", "rating")


@query("s3_gzip_row_range", REVIEWS + " WHERE id >= 100")
def _(t):
    path = files.scratch(t.spark, "gz")
    files.write_csv(t.reviews, path, compression="gzip")
    return files.row_range(files.load_reviews(t.spark, path), "id", 100)


@query("s4_json_records", REVIEWS)
def _(t):
    path = files.scratch(t.spark, "json")
    files.write_json(t.reviews, path)
    return files.read_json(t.spark, path)


@query("s5_csv_overwrite", "SELECT id, product, category, rating, url FROM reviews WHERE rating > 2")
def _(t):
    path = files.scratch(t.spark, "over")
    files.write_csv(t.reviews, path)
    files.write_csv(t.reviews.where("rating > 2"), path)
    return files.load_reviews(t.spark, path).drop("text")


@query("s6_csv_append", "SELECT id, product, category, rating, url FROM reviews")
def _(t):
    path = files.scratch(t.spark, "app")
    files.append_csv(t.reviews.where("rating <= 2"), path)
    files.append_csv(t.reviews.where("rating > 2"), path)
    return files.load_reviews(t.spark, path).drop("text")


@query("s7_empty_categories", """SELECT DISTINCT p_brand AS category FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)""")
def _(t):
    parts = t.part.select(F.col("p_brand").alias("category"), "p_size", "p_partkey")
    path = files.scratch(t.spark, "bycat")
    files.write_by_category(parts.where("p_size > 48"), path)
    return files.empty_categories(parts.select("category").distinct(), t.spark.read.parquet(path))


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"""


@query("s9_page_blocks", rf"""WITH x AS (SELECT page_id, string_split_regex({CLEAN}, '(?i)<p(?:\s[^>]*)?>')[2:] AS parts FROM pages),
    b AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM x),
    c AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(string_split_regex(part, '(?i)</p\s*>')[1],
        '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM b)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, block FROM c WHERE block <> ''""")
def _(t):
    return pages.extract_blocks(t.pages.select("page_id", "html"), "html")


@query("s10_product_links", r"""SELECT lang, url, product_id, feedback_url FROM (SELECT lang, url, product_id, 'https://shop/' || product_id || '/feedbacks' AS feedback_url,
    row_number() OVER (PARTITION BY lang ORDER BY CAST(product_id AS BIGINT), url) AS rk FROM (
        SELECT regexp_extract(url, '/([a-z][a-z])/', 1) AS lang, url, regexp_extract(url, '/[a-z][a-z]/(\d+)', 1) AS product_id FROM pages) WHERE product_id <> '') WHERE rk <= 15""")
def _(t):
    df = t.pages.select(F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("lang"), "url")
    return pages.product_links(df, "url", "lang", "https://shop/", r"/[a-z][a-z]/(\d+)", 15)


@query("s11_breadcrumbs", "SELECT p_partkey, p_type || ' / ' || p_name AS category FROM part")
def _(t):
    return t.part.select("p_partkey", pages.breadcrumb(F.array("p_brand", "p_type", "p_name")).alias("category"))


@query("s12_menu_paths", """WITH RECURSIVE tree AS (SELECT p_partkey AS id, p_name AS path FROM part WHERE p_partkey = 0 UNION ALL
    SELECT p.p_partkey, t.path || '/' || p.p_name FROM part p JOIN tree t ON p.p_partkey // 2 = t.id WHERE p.p_partkey > 0) SELECT id, path FROM tree""")
def _(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).alias("parent"), F.col("p_name").alias("name"))
    return tb.tree_paths(nodes)


@query("s13_absolute_urls", rf"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN contains(h, 'http') THEN h ELSE 'https://shop' || h END AS href FROM (
    SELECT page_id, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h FROM (SELECT page_id, regexp_extract_all({CLEAN}, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS hs FROM pages))""")
def _(t):
    found = pages.links(t.pages.select("page_id", "html"), "html")
    return found.select("page_id", "pos", pages.absolute(F.col("href"), "https://shop").alias("href"))


@query("s14_token_table", "SELECT id, spos, pos, head, lemma, tag, rel FROM tokens")
def _(t):
    path = files.scratch(t.spark, "tokens")
    t.tokens.write.parquet(path)
    return files.read_tokens(t.spark, path).select("id", "spos", "pos", "head", "lemma", "tag", "rel")


# --- incremental ---------------------------------------------------------------------------


@query("i1_stream_labels", f"WITH {SENTENCE_LABELS} SELECT id, spos, label FROM labelled_sentences")
def _(t):
    means, rows = unembedded_sentences(t)
    source, sink = files.scratch(t.spark, "in"), files.scratch(t.spark, "out")
    rows.write.parquet(source)
    words = [r[0] for r in t.stop_words.collect()]
    # four batches, of however many files the sentences were written in
    several = max(1, -(-len(t.spark.read.schema(rows.schema).parquet(source).inputFiles()) // 4))
    st.label_stream(t.spark, source, rows.schema, sink, t.masks, words, threshold=0.4, files_per_batch=several, embed=lambda df: embedded(means, df))
    return t.spark.read.parquet(sink).select("id", "spos", "label")


@query("i2_resume", "SELECT id FROM reviews WHERE rating > 3")
def _(t):
    done = t.reviews.where("rating <= 3").select("id")
    return st.not_yet_written(t.reviews.select("id"), done)


@query("i3_incremental_corrections", CORRECTED)
def _(t):
    source, state = files.scratch(t.spark, "in"), files.scratch(t.spark, "out")
    rows = t.reviews.select("id", "text")
    rows.repartition(3).write.parquet(source)
    st.learning_correction_stream(t.spark, source, rows.schema, state)
    return st.learned_corrections(t.spark, state)


@query("s9_review_rows", r"""SELECT id, pos, trim(regexp_replace(translate(text, '<>&', '   '), '\s+', ' ', 'g')) AS review_full_text, rating AS review_rating
    FROM reviews, (VALUES (0), (2)) x(pos) WHERE trim(regexp_replace(translate(text, '<>&', '   '), '\s+', ' ', 'g')) <> ''""")
def _(t):
    """A page of three review items a review: its text, no text, and its text around a child element."""
    plain = F.translate("text", "<>&", "   ")
    stars = F.concat(F.lit('<span class="feedback__rating stars-line stars-line--'), "rating", F.lit('"></span>'))
    item = lambda inner: F.concat(F.lit('<li class="comments__item feedback">'), stars, *inner, F.lit("</li>"))
    text = lambda inner: [F.lit('<p class="feedback__text">'), *inner, F.lit("</p>")]
    html = F.concat(F.lit("<ul>"), item(text([plain])), item([]), item(text([F.lit("<b>bold</b>"), plain])), F.lit("</ul>"))
    return pages.review_rows(t.reviews.select("id", html.alias("html")), "html")


@query("s12_nested_menu", """SELECT r_regionkey AS id, r_name AS name, '/' || r_regionkey AS url, CAST(NULL AS BIGINT) AS parent_id, '/' || r_name AS category FROM region
    UNION ALL SELECT 100 + n_nationkey, n_name, '/' || n_nationkey, n_regionkey, '/' || r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 1000 + s_suppkey, s_name, '/' || s_suppkey, 100 + n_nationkey, '/' || r_name || '/' || n_name || '/' || s_name
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    node = lambda n, key, name, *more: F.struct((F.lit(n) + F.col(key)).cast("long").alias("id"), F.col(name).alias("name"),
                                                F.concat(F.lit("/"), key).alias("url"), *more)
    kids = lambda df, by, child: df.groupBy(by).agg(F.collect_list(child).alias("childs"))
    nations = t.nation.join(kids(t.supplier, "s_nationkey", node(1000, "s_suppkey", "s_name")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    regions = t.region.join(kids(nations, "n_regionkey", node(100, "n_nationkey", "n_name", "childs")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return pages.flatten_menu(regions.select(node(0, "r_regionkey", "r_name", "childs").alias("m")).select("m.*"))
