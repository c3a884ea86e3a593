"""Text expressions: every function maps columns to a column, inside the JVM.

Java's ``\\w``, ``\\s`` and ``\\b`` only know ASCII, so patterns carry ``(?U)`` or
spell the classes out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
PUNCT = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
EMOJI = (
    r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}"
    r"\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{200D}\x{FE0F}\x{20E3}\x{E0020}-\x{E007F}]"
)
# Characters a folder name may not hold, with their percent codes.
FORBIDDEN = {
    "<": "%3C", ">": "%3E", ":": "%3A", '"': "%22", "/": "/",
    "\\": "%5C", "|": "%7C", "?": "%3F", "*": "%2A",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_spacing(c: Column) -> Column:
    """One space between words, ``. `` after single dots, no dots at the end."""
    c = F.regexp_replace(c, r"(?U)[\n\r\t]+|\s{2,}", " ")
    c = F.regexp_replace(c, r"(?U)(?<!\.)\s*\.\s*|\s*\.\s*(?!\.)", ". ")
    return F.regexp_replace(strip(c), r"\.+$", "")


def clean_markup(c: Column) -> Column:
    """No emoji, no tags, single spaces."""
    return collapse(F.regexp_replace(remove_emoji(c), r"(?d)<.*?>", ""))


def clean_breaks(c: Column) -> Column:
    return strip(F.translate(c, "\n\t\r", "   "))


def remove_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def remove_emoji_and_digits(c: Column) -> Column:
    return F.regexp_replace(remove_emoji(c), r"\p{Nd}+", "")


def has_emoji(c: Column) -> Column:
    return c.rlike(EMOJI)


def word_list(c: Column) -> Column:
    """Whitespace tokens, empty ones dropped."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def term_list(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def count_words(c: Column) -> Column:
    return F.size(word_list(c))


def count_unique_words(c: Column) -> Column:
    return F.size(F.array_distinct(word_list(c)))


def has_several_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))) > 1


def drop_words(words: Column, stop: Column) -> Column:
    """Words not in ``stop``; repeats stay."""
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def preprocess(c: Column, stop: Column) -> Column:
    """No punctuation, lower case, stop words dropped, joined by spaces."""
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""))
    return F.array_join(drop_words(word_list(bare), stop), " ")


def preprocess_category(c: Column) -> Column:
    return collapse(F.regexp_replace(F.replace(c, F.lit("/"), F.lit(" ")), r"(?U)\b[a-zA-Z]+\b", ""))


def sentence_list(c: Column) -> Column:
    """Sentences of a text: runs between terminal marks, trimmed, never blank.

    These are the runs of the text with clean spacing; what that does around dots falls to
    the marks, which take the white space beside them along."""
    spaced = strip(F.regexp_replace(c, r"(?U)[\n\r\t]+|\s{2,}", " "))
    return F.filter(F.split(spaced, r"(?U)\s*[.!?…][.!?…\s]*"), lambda s: s != "")


def rating_class(c: Column) -> Column:
    """4 and 5 are positive, other ratings negative, an unknown rating neutral."""
    return F.when(c.isNull(), "neutral").when(c.isin(4, 5), "positive").otherwise("negative")


def rating_category(share: Column) -> Column:
    return F.when(share > 0.7, "positive").when(share > 0.5, "neutral").otherwise("negative")


def best_label(scores: Column) -> Column:
    """Label with the highest score of a map; equal scores go to the larger label."""
    pairs = F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))
    return F.array_max(pairs)["k"]


def polarity(positive: Column, negative: Column) -> Column:
    return F.when(positive > negative, "positive").otherwise("negative")


def any_tagged(tokens: Column, tag: str, black: Column) -> Column:
    """Some (lemma, pos) element has the tag and a lemma outside ``black``."""
    return F.exists(tokens, lambda t: (t["pos"] == tag) & ~F.array_contains(black, t["lemma"]))


def tagged_lemmas(tokens: Column, tag: str, stop: Column) -> Column:
    keep = F.filter(
        tokens,
        lambda t: (t["pos"] == tag)
        & ~F.array_contains(stop, t["lemma"])
        & ~t["lemma"].rlike(r"\p{Nd}|" + PUNCT),
    )
    return F.transform(keep, lambda t: t["lemma"])


def glue_negation(c: Column, particle: str = "не") -> Column:
    return F.regexp_replace(c, rf"(?iU)(\s{particle})\s", "$1")


def tighten_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"""(?U)\s([?.!,;:"](?:\s|$))""", "$1")


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def parse_list(c: Column) -> Column:
    """``['a', 'b']`` written as text back to an array of strings."""
    inner = F.regexp_extract_all(c, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    bare = F.transform(inner, lambda s: F.substr(s, F.lit(2), F.length(s) - 2))
    return F.transform(bare, lambda s: F.regexp_replace(s, r"\\(['\"\\])", "$1"))


def apply_suggestions(c: Column, suggestions: Column) -> Column:
    """Replace (pos, len, text) spans, zero-based, from right to left."""
    right_first = F.reverse(F.sort_array(suggestions))
    return F.aggregate(
        right_first,
        c,
        lambda acc, s: F.concat(
            F.substr(acc, F.lit(1), s["pos"]), s["text"], F.substr(acc, s["pos"] + s["len"] + 1)
        ),
    )


def percent_text(change: Column) -> Column:
    return F.when(change == 0, "No change").otherwise(F.format_string("%.2f%%", change * 100))


def word_chunks(c: Column, size: int) -> Column:
    words = word_list(c)
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(size)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))


def drop_repeats(c: Column, sep: str = "|") -> Column:
    """Segments between ``sep``, trimmed, first occurrences only."""
    parts = F.transform(F.split(c, F.lit("\\" + sep)), strip)
    return F.array_join(F.array_distinct(F.filter(parts, lambda s: s != "")), f" {sep} ")


def folder_safe(c: Column) -> Column:
    for char, code in FORBIDDEN.items():
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def contextual_description(aspect: Column, characteristics: Column, positive: Column,
                           negative: Column, example: Column, words: dict[str, str] | None = None) -> Column:
    """One descriptive sentence per aspect; ``words`` holds the template pieces."""
    w = {
        "aspect": "Aspect", "rated": "is rated by customers", "pos": "mostly positively",
        "neg": "mostly negatively", "traits": "Customers most often mention these traits",
        "example": "For example",
    } | (words or {})
    tone = F.when(positive > negative, w["pos"]).otherwise(w["neg"])
    head = F.concat(F.lit(f"{w['aspect']} '"), aspect, F.lit(f"' {w['rated']} "), tone, F.lit("."))
    traits = F.when(
        F.size(characteristics) > 0,
        F.concat(F.lit(f" {w['traits']}: "), F.array_join(characteristics, ", "), F.lit(".")),
    ).otherwise("")
    shown = F.when(example.isNotNull(), F.concat(F.lit(f" {w['example']}: «"), example, F.lit("»."))).otherwise("")
    return F.concat(head, traits, shown)


def chunk_long(words: Column, limit: int = 100, breakers: tuple[str, ...] = ()) -> Column:
    """Split a word list into chunks: at punctuation, at a breaker word, or when
    the chunk would pass ``limit`` characters.  The words and their order stay."""
    stop = F.array(*[F.lit(b) for b in breakers]) if breakers else F.array().cast("array<string>")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, w):
        joined = F.when(acc["cur"] == "", w).otherwise(F.concat(acc["cur"], F.lit(" "), w))
        over = (F.length(joined) > limit) & (acc["cur"] != "")
        ends = w.rlike(r"[\p{P}]$") | F.array_contains(stop, F.lower(w))
        full = F.when(over, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])
        cur = F.when(over, w).otherwise(joined)
        return F.struct(
            F.when(~over & ends, F.array_append(full, cur)).otherwise(full).alias("done"),
            F.when(~over & ends, F.lit("")).otherwise(cur).alias("cur"),
        )

    return F.aggregate(
        words, zero, step,
        lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])),
    )
