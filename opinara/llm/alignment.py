"""Alignment of two tokenizers over a corpus, with corpus-wide pair counts.

Texts are grouped by their full content, and each distinct one is tokenised and aligned
once.  Token A and token B are linked where their byte ranges end together; the offsets
at which both end cut a text into groups.  A text is cut into words at blanks that no
token of either tokenizer crosses, so a word's tokens, groups and links are worked out
once a batch.  Batches report their distinct pairs, each weighted by the number of
documents that hold the text; the summed counts return to the batches, and a text's
measures go to its documents by the digest of the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import written

BATCH_CHARS = 2 << 20
KNOWN_WORDS = 300_000  # words that a worker remembers from batch to batch
SALTS = 64
#: A word begins at a blank behind a character that is no white space, and holds the
#: white space that ends the text.
WORD = re.compile(r" \s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+\Z")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters are themselves, all other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are parallel already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        chars = byte_of_char()
        special = set(self.a.get_added_tokens_decoder())
        self.bytes_a = {i: bytes(chars[c] for c in t) for t, i in self.a.get_vocab().items() if i not in special}
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces) if not self.b.is_control(i)}
        self.size_a, self.size_b = (np.array([len(t.get(i, b"")) for i in range(max(t) + 1)], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.vocabulary = max(len(self.size_a), len(self.size_b))
        self.written = [f"{i}{mark}".encode() for mark in ",|;" for i in range(self.vocabulary)]
        #: A word's ``Aligned`` as one run of bytes: four numbers, its links, its groups.
        self.known: dict[str, bytes] = {}
        #: No piece holds a blank behind other characters, so none crosses a word's beginning.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)

    def words(self, text: str) -> list[str]:
        """blank + ``text`` in pieces that tokenise apart as they do together."""
        if not self.apart:
            return [" " + text]
        found = WORD.findall(" " + text)
        if len(found) > 1 and found[-1] == " ":  # B gives nothing for an empty text
            found[-2:] = [found[-2] + " "]
        return found

    def align(self, words: list[str]) -> Aligned:
        """The tokens, groups and links of distinct words that begin with a blank."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 8192):
            made = self.align_new(new[at:at + 8192])
            numbers = np.stack([made.ok, made.n_a, made.n_b, made.n_links], 1).astype(np.int64).tobytes()
            raw = made.links.tobytes()
            ends = (8 * np.cumsum(made.n_links)).tolist()
            cells = [numbers[32 * i:32 * i + 32] + raw[a:b] + g for i, (a, b, g) in enumerate(zip([0, *ends], ends, made.groups))]
            self.known.update(zip(new[at:at + 8192], cells))
        cells = list(map(self.known.__getitem__, words))
        ok, n_a, n_b, n_links = np.frombuffer(b"".join(c[:32] for c in cells), np.int64).reshape(-1, 4).T
        tails = (32 + 8 * n_links).tolist()
        links = np.frombuffer(b"".join(c[32:t] for c, t in zip(cells, tails)), np.int64)
        return Aligned(ok.astype(bool), n_a, n_b, n_links, [c[t:] for c, t in zip(cells, tails)], links)

    def align_new(self, words: list[str]) -> Aligned:
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        ids_a = [e.ids for e in encode(words, add_special_tokens=False)]
        ids_b = self.b.encode([w[1:] for w in words], num_threads=1)
        raw = [w.encode("utf-8", "replace") for w in words]
        parts = [(a, b, r) for a, b, r in zip(ids_a, ids_b, raw)]
        ok = np.array([self.given_back(*p) for p in parts], bool)
        return self.linked([p if k else ([], [], b"") for p, k in zip(parts, ok)], ok)

    def given_back(self, a: list[int], b: list[int], raw: bytes) -> bool:
        try:
            return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
        except KeyError:  # a special token
            return False

    def linked(self, parts: list[tuple[list[int], list[int], bytes]], ok: np.ndarray) -> Aligned:
        """All words at once: laid end to end, A and B give the same bytes, so their tokens
        end together where running sums of token lengths meet."""
        n_a, n_b = (np.fromiter((len(p[k]) for p in parts), np.int64, len(parts)) for k in (0, 1))
        a, b = (np.fromiter((x for p in parts for x in p[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)  # every token holds a byte
        word_ends = np.cumsum([len(p[2]) for p in parts])
        # a token is written with what follows it: a comma, a bar behind a group's last A id, a semicolon behind its last B id
        group_a = np.searchsorted(at_a, np.arange(len(a)))
        group_b = np.searchsorted(at_b, np.arange(len(b)))
        code_a, code_b = a.copy(), b.copy()
        code_a[at_a] += self.vocabulary
        code_b[at_b] += 2 * self.vocabulary
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = list(map(self.written.__getitem__, np.concatenate([code_a, code_b])[order].tolist()))
        per_word = np.cumsum(n_a + n_b).tolist()
        groups = [b"".join(written[lo:hi]) for lo, hi in zip([0, *per_word[:-1]], per_word)]
        n_links = np.diff(np.searchsorted(end_a[at_a], np.concatenate([[0], word_ends]), "right"))
        return Aligned(ok, n_a, n_b, n_links, groups, a[at_a] << 32 | b[at_b])


@dataclass(frozen=True)
class Aligned:
    """Of each word: whether both tokenizers give it back, its tokens, links and groups (each
    group ends in a semicolon); and all links, A id << 32 | B id, word by word."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    links: np.ndarray


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = f"batch long, text_sha binary, {MEASURES}, words binary, a binary, b binary, n binary, word_ends binary, word_pairs binary"


def align_batch(pair: Pair, batch: int, shas: list[bytes], texts: list[str], copies: list[int]) -> pd.DataFrame:
    """A row for every text, with its words as numbers, and one for the batch: its
    distinct pairs with their links over all documents, and each word's pairs."""
    number: dict[str, int] = {}
    split = [np.array([number.setdefault(w, len(number)) for w in pair.words(t)], np.int64) for t in texts]
    distinct = list(number)
    del number
    made = pair.align(distinct)
    ok, size_a, size_b, n_links, groups = made.ok, made.n_a, made.n_b, made.n_links, made.groups
    weight, rows = np.zeros(len(distinct), np.int64), []
    for sha, own, n in zip(shas, split, copies):
        if not ok[own].all():
            rows.append((batch, sha, 0, 0, 0, 0, "", b""))
            continue
        np.add.at(weight, own, n)
        total = int(n_links[own].sum())
        digest = sha256(b"".join(map(groups.__getitem__, own.tolist()))[:-1]).hexdigest()
        rows.append((batch, sha, int(size_a[own].sum()), int(size_b[own].sum()), total, total, digest, own.astype("<u4").tobytes()))
    pairs, flat = np.unique(made.links, return_inverse=True)
    count = np.zeros(len(pairs), np.int64)
    np.add.at(count, flat, np.repeat(weight, n_links))
    rows = [(*r, None, None, None, None, None) for r in rows]
    rows.append((batch, None, 0, 0, 0, 0, "", None, (pairs >> 32).astype("<u4").tobytes(), (pairs & 0xFFFFFFFF).astype("<u4").tobytes(),
                 count.astype("<i8").tobytes(), np.cumsum(n_links).astype("<u4").tobytes(), flat.astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])


def aligned(texts: DataFrame, path_a: str, path_b: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """The rows of :func:`align_batch` over ``texts`` (text_sha, text, copies), in batches
    of about ``batch_chars`` characters within a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pair, held, size = _pair(path_a, path_b), [], 0
        batch = TaskContext.get().partitionId() << 32
        for f in frames:
            for row in zip(f["text_sha"], f["text"], f["copies"]):
                held.append(row)
                size += len(row[1])
                if size >= batch_chars:
                    yield align_batch(pair, batch, *map(list, zip(*held)))
                    held, size, batch = [], 0, batch + 1
        if held:
            yield align_batch(pair, batch, *map(list, zip(*held)))

    return texts.mapInPandas(run, ALIGNED)


def _unpacked(name: str, kind: str):
    """A packed column as an array, JVM types on the way back."""

    @F.pandas_udf(f"array<{'long' if kind == '<i8' else 'int'}>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.frombuffer(v, kind).astype(np.int64 if kind == "<i8" else np.int32))

    return run(F.col(name))


def pair_counts(lists: DataFrame) -> DataFrame:
    """(batch, at, a, b, n) of every batch's distinct pairs."""
    arrays = lists.select("batch", F.arrays_zip(_unpacked("a", "<u4").alias("a"), _unpacked("b", "<u4").alias("b"), _unpacked("n", "<i8").alias("n")).alias("p"))
    return arrays.select("batch", F.posexplode("p").alias("at", "p")).select("batch", "at", "p.a", "p.b", "p.n")


def scored(table: DataFrame) -> DataFrame:
    """(text_sha, measures, n_best, count_sum) of every distinct text.  Counts are summed
    by pair and the highest taken by B id; a batch's pairs get both back as one row."""
    lists = table.where("text_sha IS NULL")
    pairs = pair_counts(lists)
    count = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")
    best = count.groupBy("b").agg(F.max("n").alias("top"))
    known = written(count.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")))
    back = pairs.select("batch", "at", "a", "b").join(known, ["a", "b"]).groupBy("batch").agg(F.collect_list(F.struct("at", "n", "best")).alias("known"))
    back = back.select("batch", *[F.col("known")[c].alias(f"known_{c}") for c in ("at", "n", "best")])
    held = lists.select("batch", "word_ends", "word_pairs").join(back, "batch", "left").withColumnRenamed("batch", "of")
    texts = table.where("text_sha IS NOT NULL").drop("a", "b", "n", "word_ends", "word_pairs")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ends, flat = (np.frombuffer(right[c].iloc[0], "<u4").astype(np.int64) for c in ("word_ends", "word_pairs"))
        at, known_n, known_best = (right[f"known_{c}"].iloc[0] for c in ("at", "n", "best"))
        n_pairs = int(flat.max()) + 1 if len(flat) else 0
        n, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
        if at is not None:
            n[at], best[at] = known_n, known_best
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[flat])])[np.concatenate([[0], ends])])
        word_n, word_best = summed(n), summed(best)
        own = [np.frombuffer(w, "<u4") for w in left["words"]]
        out = left.drop(columns=["batch", "words"])
        out["n_best"] = [int(word_best[w].sum()) for w in own]
        out["count_sum"] = [int(word_n[w].sum()) for w in own]
        return out

    return texts.groupBy("batch").cogroup(held.groupBy("of")).applyInPandas(run, f"text_sha binary, {MEASURES}, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``path_a`` is a byte-level vocabulary, ``path_b`` a piece model that adds a blank in
    front; both name files on every executor.  A reads blank + text and B the text, without
    special tokens.  Texts that are null, empty, or not given back byte for byte by either
    have no tokens: zeros and an empty digest.  Repeated rows and null keys keep their rows;
    every row counts as a document.
    """
    sha = F.unhex(F.sha2(F.col(text), 256))
    texts = docs.where(F.col(text) != "").groupBy(F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("text_sha"), "text", "copies")
    found = scored(written(aligned(texts, path_a, path_b, batch_chars)))
    # a text of very many documents: its measures are dealt to as many salts as hold it
    slim = docs.select(F.col(key).alias(key), F.when(F.col(text) != "", sha).alias("text_sha")).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    some, none = slim.where("text_sha IS NOT NULL"), slim.where("text_sha IS NULL")
    dealt = some.select("text_sha", "salt").distinct().join(found, "text_sha")
    whole = some.join(dealt, ["text_sha", "salt"]).unionByName(none, allowMissingColumns=True)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return whole.select(key, *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
