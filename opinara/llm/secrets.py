"""Secret scan: fixed patterns plus dictionary-primed compression novelty.

A candidate is a token run in a sensitive context.  Its novelty is the number of bytes
by which the compressed surroundings, without other copies of the candidate, grow when
it is put back, with a compressor primed on a dictionary of ordinary identifiers.  A
word that the surroundings or the dictionary explain costs a few bytes; a key costs its
length, however often it is repeated.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
KINDS = ("assign", "access", "hex", "novel")

# Words that make a context sensitive, and everyday identifiers.
SENSITIVE = "pass pwd secret token key auth bearer credential private signature salt session"
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 -----BEGIN -----END "
    "application authorization authentication background baseline builder callback certificate character checkbox "
    "collection component configuration connection constructor container content controller credentials database "
    "datetime default definition dependency description development directory document element environment exception "
    "execution extension factory filename foundation function generator getElementById handler hashlib identifier "
    "implementation import information initialize instance integer interface internal iterator javascript keyboard "
    "length library listener localhost location management manager message metadata method module namespace network "
    "number object operation option organization package parameter password permission platform position previous "
    "private process production property protected protocol provider public publicKey privateKey python query random "
    "reference register repository request resource response return schema secret security selector serialize server "
    "service session signature source standard static storage string structure subscription subprocess suffix "
    "template threshold timeout timestamp token transaction transform undefined update username utility validate "
    "value variable version visibility window workspace accessToken secretAccessKey clientSecret apiKey Bearer Basic "
    "Authorization: Content-Type: https://www. http:// .com/ .org/ /usr/local/bin /home/user/ src/main/resources "
)
SCHEMA = "array<struct<kind:string,start:int,end:int,novelty:double>>"


@lru_cache(maxsize=1)
def _tools():
    """Compiled patterns, keyword filters and the primed compressor of this process."""
    quick = re.compile(r"password|passwd|secret|token|api_?key")
    assign, access, runs = (re.compile(p, (re.I | re.A) if k == "assign" else 0) for k, p, _, _ in PATTERNS[:2] + (
        ("hex", PATTERNS[2][1].replace("+", "{%d,}" % PATTERNS[2][3]), 0, 0),))
    sensitive = re.compile("|".join(SENSITIVE.split()), re.I | re.A)
    words = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return quick, assign, access, runs, sensitive, words, zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False)


def novelty(text: str, start: int, end: int, around: int = 256) -> float:
    """Marginal compressed bytes of ``text[start:end]`` per byte of it."""
    size = lambda s: len(_tools()[-1].compress(s.encode("utf-8", "replace")))
    own, n = text[start:end], end - start
    before = text[max(0, start - around - n):start].replace(own, " " * n)[-around:]
    after = text[end:end + around + n].replace(own, " " * n)[:around]
    return (size(before + after + own) - size(before + after)) / n


def base_spans(text: str) -> list[tuple[str, int, int]]:
    quick, assign, access, runs = _tools()[:4]
    found = []
    if quick.search(text.lower()):
        found += [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= PATTERNS[0][3]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in access.finditer(text) if len(m[0]) >= PATTERNS[1][3]]
    return found + [("hex", *m.span()) for m in runs.finditer(text)]


HEADING = re.compile(r"^[ \t]*(?:(#{1,6})[ \t][^\n]*|\[[^\]\n]+\]|[^\n]{1,80}:)[ \t\r]*$", re.M)


class Context:
    """Whether a place of a text is sensitive: a sensitive word within ``near`` characters
    or in the same line, on either side, or in a heading above it, of its section (``#``,
    ``[name]`` or a line that ends in a colon) or of its table's column line."""

    def __init__(self, text: str, near: int):
        self.text, self.near, self.word = text, near, _tools()[4]
        found = [m.span() for m in self.word.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self.headings: list[tuple[int, bool]] | None = None
        # looked up for every candidate, so found once for the whole text
        self.breaks = [m.start() for m in re.finditer("\n", text)] if found else []
        self.gaps = [a + 2 for a, b in zip(self.breaks, self.breaks[1:]) if b == a + 1]
        self.tables: dict[int, bool] = {}

    def within(self, lo: int, hi: int) -> bool:
        i = bisect_left(self.starts, lo)
        return i < len(self.ends) and self.ends[i] <= hi

    def sensitive(self, s: int, e: int) -> bool:
        if not self.starts:
            return False
        i, j = bisect_left(self.breaks, s), bisect_left(self.breaks, e)
        line = self.breaks[i - 1] + 1 if i else 0
        stop = self.breaks[j] if j < len(self.breaks) else len(self.text)
        if self.within(min(line, max(0, s - self.near)), s) or self.within(e, max(stop, e + self.near)) or self.under_heading(line):
            return True
        if line not in self.tables:
            self.tables[line] = self.in_table(line, stop)
        return self.tables[line]

    def under_heading(self, line: int) -> bool:
        if self.headings is None:
            above, self.headings = [], []
            for m in HEADING.finditer(self.text):
                level = len(m[1]) if m[1] else 7
                while above and above[-1][0] >= level:
                    above.pop()
                above.append((level, self.within(*m.span())))
                self.headings.append((m.start(), any(x for _, x in above)))
        i = bisect_left(self.headings, (line,)) - 1
        return i >= 0 and self.headings[i][1]

    def in_table(self, line: int, stop: int) -> bool:
        i = bisect_right(self.gaps, line)
        top = self.gaps[i - 1] if i else 0
        end = self.text.find("\n", top)
        if top >= line or not self.within(top, end):
            return False
        return any(0 < self.text.count(c, line, stop) == self.text.count(c, top, end) for c in "|\t,;")


def keylike(run: str) -> bool:
    """Letters and digits, in a run under 20 characters with at least two changes between
    them or both cases; without a digit, 20 and more letters that change to upper case at
    every sixth place or more often, as no compound name does."""
    kinds = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", run)))
    if len(run) < 8 or not re.search("[A-Za-z]", run):
        return False
    if "0" not in kinds:
        return len(run) >= 20 and 6 * kinds.count("aA") >= len(run)
    return len(run) >= 20 or ("a" in kinds and "A" in kinds) or len(re.findall("(?=[Aa]0|0[Aa])", kinds)) >= 2


def spans(text: str | None, least: float = 0.8, context: int = 48) -> list[dict]:
    """Spans of one text, by start and then by kind; null and empty texts have none."""
    if not text:
        return []
    base, words = base_spans(text), _tools()[5]
    found = [(k, s, e, novelty(text, s, e)) for k, s, e in base]
    place = Context(text, context)
    starts = sorted(s for _, s, _ in base)
    reach = list(accumulate((e for _, _, e in sorted(base, key=lambda x: x[1])), max))  # the furthest end so far

    def covered(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return i > 0 and reach[i - 1] > s

    def add(s: int, e: int) -> bool:
        if covered(s, e) or not keylike(text[s:e]) or not place.sensitive(s, e):
            return False
        n = novelty(text, s, e)
        if n >= least:
            found.append(("novel", s, e, n))
        return n >= least

    for m in words.finditer(text) if place.starts else ():
        s, e = m.span()
        if e - s >= 8 and not add(s, e) and "." in m[0]:
            # a dotted name may hold a key in one of its parts
            for part in m[0].split("."):
                add(s, s + len(part))
                s += len(part) + 1
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [{"kind": k, "start": s, "end": e, "novelty": n} for k, s, e, n in found]


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", least: float = 0.8) -> DataFrame:
    """``docs`` with ``out``: all secret spans (kind, start, end in code points, novelty).

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns, whatever their
    novelty; ``novel`` are runs of 8 and more characters, dotted ones as one, that look like
    keys (``keylike``), stand by a sensitive word or under a heading with one (``Context``)
    and cost at least ``least`` bytes a byte.  A null or empty text has an empty list.  Nothing is shuffled.
    """

    @F.pandas_udf(SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: spans(t, least), na_action=None)

    return docs.withColumn(out, scan(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", least: float = 0.8) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans
    become one mark.  Null stays null; no row is dropped."""

    def clean(t):
        if not t:
            return t
        out, at = [], 0
        for s in spans(t, least):
            if s["start"] >= at:
                out += [t[at:s["start"]], mark]
            at = max(at, s["end"])
        return "".join(out) + t[at:]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(clean, na_action="ignore")

    return docs.withColumn(text, run(F.col(text)))


def listed(found: Column, base_only: bool) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    keep = F.filter(found, lambda s: s["kind"] != "novel") if base_only else found
    return F.concat_ws(",", F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
