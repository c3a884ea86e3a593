"""Review rows, links and menus out of page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.operators.tables import first_per

# The markup of a review item, its text and its star rating.
ITEM = r"""(?is)<li\b[^>]*class\s*=\s*"[^"]*\bcomments__item\b[^"]*"[^>]*>"""
TEXT = r"""(?is)<p\b[^>]*class\s*=\s*"[^"]*\bfeedback__text\b[^"]*"[^>]*>(.*?)(?:</p>|$)"""
STARS = r"""(?is)<span\b[^>]*class\s*=\s*"(feedback__rating stars-line[^"]*)\""""
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def visible(html: Column) -> Column:
    """Markup without scripts, styles and comments."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, pattern, "")
    return html


def inner_text(html: Column, own: bool = False) -> Column:
    """Text of a fragment; ``own`` leaves the text of child elements out."""
    if own:
        html = F.regexp_replace(html, r"(?is)<(\w+)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return tx.collapse(out)


def extract_blocks(pages: DataFrame, html: str, tag: str = "p", own: bool = False) -> DataFrame:
    """One row per non-blank element ``tag``: pos, block.  A block ends at its end tag
    or where the next one starts, so unclosed elements are kept."""
    parts = F.split(visible(F.col(html)), rf"(?i)<{tag}(?:\s[^>]*)?>")
    inner = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.get(F.split(p, rf"(?i)</{tag}\s*>"), F.lit(0)))
    texts = F.filter(F.transform(inner, lambda b: inner_text(b, own)), lambda b: b != "")
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(texts).alias("pos", "block"))


def review_rows(pages: DataFrame, html: str) -> DataFrame:
    """Text and rating of every review item; items without a text fall out.

    The rating is the last character of the last class of the star element."""
    parts = F.split(visible(F.col(html)), ITEM)
    items = pages.select(*[c for c in pages.columns if c != html],
                         F.posexplode(F.slice(parts, 2, F.size(parts))).alias("pos", "item"))
    text = inner_text(F.regexp_extract("item", TEXT, 1), own=True)
    rating = F.right(F.trim(F.regexp_extract("item", STARS, 1)), F.lit(1))
    return items.select(*[c for c in items.columns if c != "item"], text.alias("review_full_text"),
                        F.try_to_number(rating, F.lit("9")).cast("int").alias("review_rating")).where("review_full_text <> ''")


def product_links(df: DataFrame, url: str, category: str, base: str, pattern: str = r"catalog/(\d+)", first: int | None = None) -> DataFrame:
    """Product id and feedback address out of ``url``; the first n per category."""
    code = F.regexp_extract(url, pattern, 1)
    rows = df.select(category, url, code.alias("product_id")).where("product_id <> ''").withColumn(
        "feedback_url", F.concat(F.lit(base), "product_id", F.lit("/feedbacks")))
    return rows if first is None else first_per(rows, [category], [F.col("product_id").cast("long").asc(), F.asc(url)], first).drop("rk")


def breadcrumb(names: Column, sep: str = " / ") -> Column:
    """Names after the first joined to a path."""
    return F.array_join(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), sep)


def absolute(url: Column, base: str) -> Column:
    return F.when(F.contains(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def links(pages: DataFrame, html: str) -> DataFrame:
    href = F.regexp_extract_all(visible(F.col(html)), F.lit(r"""(?i)<a\s[^>]*href="([^"]*)\""""), F.lit(1))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(href).alias("pos", "href"))


def flatten_menu(menu: DataFrame) -> DataFrame:
    """Rows id, name, url, parent_id, category out of nested ``childs`` arrays.

    ``menu`` has id, name, url, childs; the declared schema bounds the depth."""
    level = menu.withColumn("parent_id", F.lit(None).cast("long")).withColumn("category", F.concat(F.lit("/"), "name"))
    out = None
    while True:
        rows = level.select("id", "name", "url", "parent_id", "category")
        out = rows if out is None else out.unionByName(rows)
        if "childs" not in level.columns:
            return out
        kids = level.select(F.col("id").alias("parent_id"), F.col("category").alias("up"), F.explode("childs").alias("c")).select("parent_id", "up", "c.*")
        level = kids.withColumn("category", F.concat("up", F.lit("/"), "name")).drop("up")
