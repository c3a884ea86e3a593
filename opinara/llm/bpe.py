"""Byte-level BPE by replaying the merges over a block's distinct words.

The corpus is taken block by block, each a bounded amount of whole documents.  The
distinct words of a block lie one after another in one array; an inverted index
holds, for each merge, the positions of the pairs that it joins.  Merges are applied
in rank order, each to all its positions at once, and only the pairs beside a joined
position are looked up again.  Words do not touch one another, so the block in which
a word is met makes no difference to its ids.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8 << 20
CACHE_WORDS = 400_000

# Letters and numbers of Latin-1, and the texts that hold only its characters.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
LATIN = re.compile(r"[\x09-\x0d\x20-\x7e\x85\xa0-\xff]*")


class Merges:
    """Ranks of a byte-level vocabulary and the pairs that each token is joined from."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.width = max(self.tokens) + 1
        pairs = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.width + b, rank))
        pairs.sort()
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of joining ``a`` and ``b``, -1 where they do not join."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word as little-endian 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(words) else 0
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(left: np.ndarray) -> None:
            """File the pairs that begin at ``left`` under the ranks of their merges."""
            rank = self.lookup(sym[left], sym[after[left]])
            left, rank = left[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            for part, r in zip(np.split(left, np.flatnonzero(np.diff(rank)) + 1), rank[np.r_[0, np.flatnonzero(np.diff(rank)) + 1]] if len(rank) else ()):
                if (filed := index.get(int(r))) is None:
                    index[int(r)] = [part]
                    heapq.heappush(queue, int(r))
                else:
                    filed.append(part)

        add(np.flatnonzero(after >= 0))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(index.pop(rank)))
            at = at[alive[at] & (after[at] >= 0)]
            at = at[self.lookup(sym[at], sym[after[at]]) == rank]  # what an earlier merge changed is stale
            if len(at) > 1:  # of pairs that share a symbol, every second one from the left
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            sym[at], alive[gone] = rank, False
            after[at] = after[gone]
            inner = at[after[at] >= 0]
            before[after[inner]] = inner
            left = before[at]
            touched = np.unique(np.concatenate([left[left >= 0], inner]))
            if len(touched):
                add(touched)
        ids = sym[alive].astype("<u4")
        counts = np.add.reduceat(alive, (ends - sizes)[sizes > 0]) if n else np.zeros(0, np.int64)
        sizes[sizes > 0] = counts
        cuts, raw = np.concatenate([[0], np.cumsum(sizes)]) * 4, ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=4)
def _splitters(pattern: str):
    """The vocabulary's own pattern, and the same one over Latin-1 for the faster engine."""
    plain = pattern.replace(r"^\s\p{L}\p{N}", rf"^\s{LETTERS}{NUMBERS}").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    return regex.compile(pattern), (re.compile(plain) if r"\p" not in plain else None)


def split_words(text: str, pattern: str) -> list[str]:
    full, plain = _splitters(pattern)
    return (plain if plain is not None and LATIN.fullmatch(text) else full).findall(text)


class Coder:
    """Encodes texts block by block and remembers the words of the last blocks."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern, self.known = _merges(path), pattern, {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
                size += len(texts[end])
                end += 1
            split = [split_words(t, self.pattern) for t in texts[at:end]]
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            new = list({w for words in split for w in words if w not in self.known})
            self.known.update(zip(new, self.merges.encode_words([w.encode("utf-8", "replace") for w in new])))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))
            at = end

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One coder a worker process, so that later tasks find its words."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out`` (binary): the ids of ``text``, little-endian unsigned 32-bit.

    ``path`` names a rank file on every executor and ``pattern`` the pattern that splits
    text into words.  A null or empty text has no ids.  Nothing is shuffled.
    """

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(path, pattern)
        for batch in batches:
            yield pd.Series(list(c.encode([t or "" for t in batch])), dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out`` (binary): the bytes that ``ids`` stand for; null stays null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(path, pattern)
        for batch in batches:
            yield pd.Series([None if b is None else c.decode(b) for b in batch], dtype=object)

    return docs.withColumn(out, run(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of a round trip,
    in one pass that sends no ids back to the JVM."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for batch in batches:
            rows = [(len(ids) // 4, sha256(ids).hexdigest(), sha256(c.decode(ids)).hexdigest())
                    for ids in c.encode([t or "" for t in batch])]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    got = docs.withColumn("_bpe", run(F.col(text)))
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    return got.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[f"_bpe.{c}" for c in new])
