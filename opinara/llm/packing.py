"""Packing of tokenised examples into sequences of bounded size.

An example has a demand in each of three measures: tokens, segments (one for each
piece) and loss-bearing tokens.  A sequence is filled by the dot-product heuristic of
vector bin packing: of the examples that fit, the one goes in whose demand agrees best
with what the sequence has left.  Where none fits, one is cut.  Every task packs the
rows of its own partition, pool by pool; what the last sequence of a pool holds goes
over to the next one.  What is left at the end of a partition, and a sequence that the
other two limits close before its tokens do, becomes sequences whose lengths are powers
of two, so nothing is padded.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

POOL = 2048
CACHE_WORDS = 400_000

# The split and the normalisation that the fast path below is written for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
LATIN = re.compile(r"[\x09-\x0d\x20-\x7e\x85\xa0-\xff]*")
LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens:
    """Token ids by a tokenizer file, with a memory of words.

    Texts of Latin-1 characters are cut at white space and each word is looked up; the
    vocabulary's model is asked for new words only.  Other texts go to the tokenizer whole, as
    do those that hold the name of a special token, which the tokenizer reads as that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        with open(path) as f:
            spec = json.load(f)
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = normal == NORMALIZERS and split == [SPLIT, None]
        self.letters, self.known = byte_letters(), {}

    def _new(self, word: str) -> bytes:
        spell = self.letters
        ids = [t.id for part in LATIN_SPLIT.findall(word.lower())
               for t in self.whole.model.tokenize("".join([spell[b] for b in part.encode()]))]
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; none for null and empty texts."""
        if not text:
            return b""
        low = text.lower()
        if not self.by_word or not LATIN.fullmatch(text) or any(t in low for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, found = self.known, []
        for w in text.split():
            b = known.get(w)
            if b is None:
                b = known[w] = self._new(w)
            found.append(b)
        return b"".join(found)


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One tokenizer a worker process, so that later tasks find its words."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass
class Example:
    """A run of an example that is still to be placed; its last ``loss`` ids bear loss."""

    key: object
    ids: bytes
    loss: int
    start: int
    length: int

    def bearing(self, length: int) -> int:
        """Loss-bearing ids among the first ``length`` of the run."""
        return max(0, self.start + length - max(len(self.ids) // 4 - self.loss, self.start))

    def room(self, tokens_left: int, loss_left: int) -> int:
        """The longest beginning that fits."""
        free = max(0, len(self.ids) // 4 - self.loss - self.start)
        return min(self.length, tokens_left, free + loss_left)

    def cut(self, length: int) -> Example:
        """Take the first ``length`` ids off."""
        first = Example(self.key, self.ids, self.loss, self.start, length)
        self.start, self.length = self.start + length, self.length - length
        return first


def pack(items: list[Example], limits: Limits) -> tuple[list[list[Example]], list[Example]]:
    """Sequences of examples, and those of the last one if it is not full."""
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    need = np.array([(x.length, 1, x.bearing(x.length)) for x in items], float).reshape(-1, 3) / most
    open_ = np.ones(len(items), bool)
    full, left = [], len(items)
    while left:
        rest, bin_ = np.ones(3), []
        while left:
            fits = open_ & (need <= rest + 1e-9).all(axis=1)
            if fits.any():
                best = int(np.where(fits, need @ rest, -1).argmax())
                bin_.append(items[best])
                rest -= need[best]
                open_[best], left = False, left - 1
                continue
            best = int(np.where(open_, need @ rest, -1).argmax())
            x = items[best]
            size = x.room(round(rest[0] * limits.tokens), round(rest[2] * limits.loss_tokens)) if rest[1] * limits.segments > 0.5 else 0
            if size <= 0:
                break
            bin_.append(x.cut(size))
            rest -= np.array([size, 1, bin_[-1].bearing(size)]) / most
            need[best] = np.array([x.length, 1, x.bearing(x.length)]) / most
        if not left and sum(x.length for x in bin_) < limits.tokens:
            return full, bin_
        full += [bin_] if sum(x.length for x in bin_) == limits.tokens else powers(bin_)
    return full, []


def powers(items: list[Example]) -> list[list[Example]]:
    """Examples as sequences whose lengths are powers of two, longest first."""
    total, out = sum(x.length for x in items), []
    for bit in range(total.bit_length() - 1, -1, -1):
        want, bin_ = total & (1 << bit), []
        while want:
            x = items[0]
            bin_.append(x.cut(min(want, x.length)))
            want -= bin_[-1].length
            if not x.length:
                items = items[1:]
        if bin_:
            out.append(bin_)
    return out


def sequences(examples: Iterator[tuple[object, bytes, int]], limits: Limits) -> Iterator[list[Example]]:
    """All sequences of a stream of (key, ids, loss-bearing ids at the end)."""
    pool: list[Example] = []
    for key, ids, loss in examples:
        x = Example(key, ids, min(loss, len(ids) // 4), 0, len(ids) // 4)
        while x.length and (size := x.room(limits.tokens, limits.loss_tokens)) < x.length or x.length == limits.tokens:
            piece = x.cut(min(size, x.length))
            if piece.length == limits.tokens:
                yield [piece]
            else:
                pool.append(piece)
        if x.length:
            pool.append(x)
        if len(pool) >= POOL:
            full, pool = pack(pool, limits)
            yield from full
    full, pool = pack(pool, limits)
    yield from full
    yield from powers(pool)


PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = 2, limits: Limits = Limits(),
                   with_ids: bool = True, loss: Callable[[int], int] | None = None) -> DataFrame:
    """Pieces of all documents: ``key``, ``start`` (its ids before the piece), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the closing id ``end``), ``sequence_id``,
    ``offset`` in the sequence, ``loss_tokens`` and, unless left out, ``ids``.

    ``loss(n)`` says how many of a document's last ids bear loss (all, by default).  A
    null or empty text is the closing id alone.  A null key stays null.  Sequence ids are
    unique, with gaps between partitions."""
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
    closing = b"" if end is None else np.array([end], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokens(path)

        def stream():
            for f in frames:
                for k, t in zip(f[key].astype(object).where(f[key].notna(), None), f[text]):
                    ids = tok.ids(t) + closing
                    yield k, ids, len(ids) // 4 if loss is None else loss(len(ids) // 4)

        at, rows = TaskContext.get().partitionId() << 36, []
        for at, bin_ in enumerate(sequences(stream(), limits), at):
            offset = 0
            for x in bin_:
                raw = x.ids[4 * x.start:4 * (x.start + x.length)]
                rows.append((x.key, x.start, x.length, zlib.crc32(raw), len(x.ids) // 4, at, offset, x.bearing(x.length),
                             raw if with_ids else None))
                offset += x.length
            if len(rows) >= 4096:
                yield pd.DataFrame(rows, columns=[key, *columns])
                rows = []
        yield pd.DataFrame(rows, columns=[key, *columns])

    got = docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, {PIECES}")
    return got if with_ids else got.drop("ids")
