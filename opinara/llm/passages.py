"""Removal of repeated passages of 50 words by fixed-block anchors.

Every document's words are laid in reference blocks of 25, side by side from its first
word on; a passage of 50 words holds a whole block wherever it begins.  The blocks are
indexed by hash, and every rolling window of 25 words of every document is probed
against them.  A window that some other document has too is a hit.  Hits are extended:
each 50-word passage around a hit is named by its content, and all documents but those
with the smallest id that has it lose its words, so that what goes are the maximal runs
of exact repeats.

Documents are dealt into batches and hashes into buckets of bounded bytes.  Batch and
bucket talk in blobs of sorted, distinct hashes, and answers are one bit a hash, in the
order asked; so copies inside a batch, and whatever everyone has, arrive once a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import written
from opinara.llm.suffixes import BYTES, mixed

WINDOW = 50
BLOCK = WINDOW // 2  # a window of 2b words holds a whole one of blocks of b words
BATCH_BYTES = 8 << 20
CHUNK = 1 << 20
LAST = (1 << 63) - 1

# The byte values that separate words.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def _base(seed: int) -> tuple[int, int]:
    """An odd 64-bit base and its inverse modulo 2**64."""
    b = (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) | 5
    return b, pow(b, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


BYTE_BASE, WORD_BASES = _base(1), (_base(2), _base(3))
_tables: dict[int, np.ndarray] = {}


def _chunk_powers(base: int) -> np.ndarray:
    if base not in _tables:
        _tables[base] = _powers(base, CHUNK + 1)
    return _tables[base]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word of ``raw``, which must end in a separator.

    The bytes are read in chunks that may cut words: a word's hash is the difference of
    two running sums of byte values times powers of a base, freed of the base's power at
    its start.
    """
    data = np.frombuffer(raw, np.uint8)
    base, inverse = BYTE_BASE
    power, back = _chunk_powers(base), _chunk_powers(inverse)
    total, lift, drop = 0, 1, 1  # the sum so far, base ** at and its inverse
    starts, firsts, sums, before = [], [], [], True
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK]
        gap = SEPARATORS[part]
        was = np.concatenate([[before], gap[:-1]])
        before = bool(gap[-1])
        run = np.cumsum(BYTES[0][part] * power[:len(part)] * np.uint64(lift), dtype=np.uint64)
        run = np.concatenate([[np.uint64(0)], run]) + np.uint64(total)
        begin, end = np.flatnonzero(was & ~gap), np.flatnonzero(~was & gap)
        starts.append(begin + at)
        firsts.append((run[begin], back[begin] * np.uint64(drop)))
        sums.append(run[end])
        total, n = int(run[-1]), len(part)
        lift, drop = lift * int(power[n]) % (1 << 64), drop * int(back[n]) % (1 << 64)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, shift = (np.concatenate([f[i] for f in firsts]) for i in (0, 1))
    return np.concatenate(starts), mixed((np.concatenate(sums) - first) * shift)


def window_names(words: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Names of the windows of ``width`` words that begin at each word but the last ones."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, inverse = WORD_BASES[family]
    run = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(base, len(words)), dtype=np.uint64)])
    return mixed((run[width:] - run[:n]) * _powers(inverse, n))


def packed(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, which compresses what they have in common."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class Batch:
    """The documents of a batch that have 50 words, in order of their ids, as one row of words."""

    def __init__(self, table: pa.Table):
        order = table.sort_by([("__passage_key", "ascending"), ("__passage_hash", "ascending")])
        self.keys, self.hashes = order.column("__passage_key").to_numpy(), order.column("__passage_hash").to_numpy()
        texts = [zlib.decompress(t.as_py()) for t in order.column("__passage_bytes")]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts, words = word_hashes(b"".join(t + b"\n" for t in texts))
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.doc_words = np.diff(cuts)
        long = self.doc_words >= WINDOW
        self.words = words[np.repeat(long, self.doc_words)]
        self.docs = np.flatnonzero(long)
        self.doc = np.repeat(self.docs, self.doc_words[long])  # of every word
        size = self.doc_words[long]
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(size) - size, size)
        self.left = np.repeat(size, size) - self.place  # words from here to the document's end
        self.order = order

    def key_ranks(self) -> np.ndarray:
        """Documents with one id are one document."""
        return np.cumsum(np.concatenate([[0], self.keys[1:] != self.keys[:-1]])) if len(self.keys) else np.zeros(0, np.int64)

    def probes(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, number of every probe's key, blocks, shared): the distinct rolling windows
        as bucket and 32 bits of their hash, which of them begin a reference block, and
        which more than one document of the batch has."""
        name = window_names(self.words, BLOCK)
        at = np.flatnonzero(self.left[:len(name)] >= BLOCK)
        name = name[at]
        slot = (name >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | name & np.uint64(0xFFFFFFFF)
        order = np.argsort(slot, kind="stable")
        s, rank = slot[order], self.key_ranks()[self.doc[at]][order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        number = np.empty(len(s), np.int64)
        number[order] = np.cumsum(new) - 1
        if not len(s):
            return s, number, np.zeros(0, bool), np.zeros(0, bool)
        block = np.logical_or.reduceat((self.place[at] % BLOCK == 0)[order], begin)
        ends = np.concatenate([begin[1:], [len(s)]]) - 1
        self.at = at
        return s[begin], number, block, rank[begin] != rank[ends]

    def passages(self, open_: np.ndarray, buckets: int):
        """Distinct 50-word passages with an open probe, by bucket and name: (bucket, name,
        check, first id), and of every such passage its place and number."""
        hit = np.zeros(len(self.words) + WINDOW, np.int64)
        hit[self.at[open_]] = 1
        run = np.concatenate([[0], np.cumsum(hit)])
        n = max(0, len(self.words) - WINDOW + 1)
        near = run[BLOCK + 1:BLOCK + 1 + n] - run[:n] > 0  # a probe at one of the first 26 words lies inside
        at = np.flatnonzero(near & (self.left[:n] >= WINDOW))
        name, check = (window_names(self.words, WINDOW, f)[at] for f in (0, 1))
        check = (check >> np.uint64(32)).astype(np.uint32)
        bucket = ((name >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at, check, name, bucket))  # of equal ones the smallest id first
        name, check, bucket = name[order], check[order], bucket[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (check[1:] != check[:-1])]) if len(name) else np.zeros(0, bool)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        first = self.keys[self.doc[at[order]]][new]
        return bucket[new], name[new], check[new], first, at, number


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    ends = [0, *cuts.tolist(), len(bucket)]
    for a, b in zip(ends[:-1], ends[1:]):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _group(column) -> list:
    return column.to_pylist()


PROBE = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("size", pa.int32()), ("names", pa.binary()), ("blocks", pa.binary()), ("shared", pa.binary())])
PASSAGE = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("size", pa.int32()), ("names", pa.binary()), ("checks", pa.binary()), ("firsts", pa.binary()),
                     ("at", pa.binary()), ("number", pa.binary()),
                     ("doc", pa.int32()), ("key", pa.int64()), ("words", pa.int64()), ("sha", pa.string()), ("raw", pa.binary())])
ANSWER = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("size", pa.int32()), ("yes", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _answers(table: pa.Table, yes: np.ndarray, sizes: list[int]) -> pa.Table:
    """One row of bits for every blob of a bucket, in their order."""
    cuts = np.cumsum([0, *sizes])
    return _table([(b, k, n, np.packbits(yes[lo:hi]).tobytes()) for b, k, n, lo, hi in
                   zip(_group(table.column("batch")), _group(table.column("bucket")), sizes, cuts[:-1], cuts[1:])], ANSWER)


def settle_probes(table: pa.Table) -> pa.Table:
    """In a bucket: a probe is open if it begins some document's block and more than one
    document has it."""
    sizes = _group(table.column("size"))
    name = np.concatenate([np.cumsum(unpacked(x, "<u4"), dtype=np.uint32) for x in _group(table.column("names"))])
    block, shared = (np.concatenate([bits(x, n) for x, n in zip(_group(table.column(c)), sizes)]) for c in ("blocks", "shared"))
    order = np.argsort(name, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0]))
    count = np.diff(np.concatenate([begin, [len(name)]]))
    open_ = np.logical_or.reduceat(block[order], begin) & (np.logical_or.reduceat(shared[order], begin) | (count > 1))
    yes = np.empty(len(name), bool)
    yes[order] = np.repeat(open_, count)
    return _answers(table, yes, sizes)


def settle_passages(table: pa.Table) -> pa.Table:
    """In a bucket: does a document with a smaller id than the batch's first have the passage?"""
    sizes = _group(table.column("size"))
    name, check, first = (np.concatenate([unpacked(x, kind) for x in _group(table.column(c))])
                          for c, kind in (("names", "<u8"), ("checks", "<u4"), ("firsts", "<i8")))
    order = np.lexsort((first, check, name))
    n, c = name[order], check[order]
    new = np.concatenate([[True], (n[1:] != n[:-1]) | (c[1:] != c[:-1])])
    begin = np.flatnonzero(new)
    least = np.repeat(first[order][begin], np.diff(np.concatenate([begin, [len(n)]])))
    yes = np.empty(len(name), bool)
    yes[order] = least < first[order]
    return _answers(table, yes, sizes)


def _bits_of(answers: pa.Table) -> np.ndarray:
    """The answers of all buckets in the order of the batch's sorted names."""
    rows = sorted(zip(*(_group(answers.column(c)) for c in ("bucket", "size", "yes"))))
    return np.concatenate([bits(yes, n) for _, n, yes in rows]) if rows else np.zeros(0, bool)


def runs(words: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], words.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def lost_words(starts: np.ndarray | None, n: int) -> list[tuple[int, int]]:
    """Of ``n`` words the runs that windows beginning at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    if starts is not None:
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts.astype(np.int64) + WINDOW, -1)
    return runs(np.cumsum(edge)[:-1] > 0)


def gone_words(replies: pa.Table) -> dict[int, np.ndarray]:
    """Of the documents of a batch that lose words the places at which passages begin."""
    bucket = replies.column("bucket").to_numpy()
    yes = _bits_of(replies.filter(pa.array(bucket >= 0)))
    gone: dict[int, np.ndarray] = {}
    for at, number in zip(*(_group(replies.filter(pa.array(bucket < 0)).column(c)) for c in ("at", "number"))):
        place, number = unpacked(at, "<u4").reshape(-1, 2), unpacked(number, "<i8")
        place = place[yes[number >> 1] | (number & 1).astype(bool)]
        cuts = np.flatnonzero(np.diff(place[:, 0])) + 1
        gone = {int(p[0, 0]): p[:, 1] for p in np.split(place, cuts) if len(p)}
    return gone


def kept_words(words: list[bytes], gone: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in gone:
        out += words[at:a]
        at = b
    return out + words[at:]


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without the words covered by 50 consecutive words that also stand, in the
    same order, in a document with a smaller id.

    ``text`` of a document that loses words becomes the words that are left, joined by one
    blank; others stay as they are.  With ``digest`` the result is (key, n_words, n_removed,
    kept_sha256) instead.  Words are runs of anything but blanks, tabs and line ends, and
    compared as bytes.  Null texts have no words and stay null; documents with a null id
    come after all others and are one document, as are rows that share an id.  Passages
    are judged on the input.  Names have 96 bits.
    """

    @F.pandas_udf("binary")
    def shrunk(raw: pd.Series) -> pd.Series:  # a third less than the shuffle's own compression
        return raw.map(lambda x: zlib.compress(x, 1))

    n = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    n = max(n, -(-total // batch_bytes))
    tagged = docs.withColumn("__passage_key", F.coalesce(F.col(key).cast("long"), F.lit(LAST))).withColumn("__passage_hash", F.xxhash64(F.col(key), F.col(text)))
    tagged = tagged.withColumn("__passage_batch", F.pmod(F.col("__passage_hash"), F.lit(n)).cast("int"))
    texts = tagged.select("__passage_batch", "__passage_key", "__passage_hash", shrunk(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__passage_bytes"))
    own = lambda t: t.column("__passage_batch")[0].as_py()

    def probe(table: pa.Table) -> pa.Table:
        slot, _, block, shared = Batch(table).probes(n)
        bucket, name = (slot >> np.uint64(32)).astype(np.int64), slot.astype(np.uint32)
        return _table([(b, own(table), s.stop - s.start, packed(np.diff(name[s], prepend=np.uint32(0))), np.packbits(block[s]).tobytes(), np.packbits(shared[s]).tobytes())
                       for b, s in _split(bucket)], PROBE)

    probes = texts.groupBy("__passage_batch").applyInArrow(probe, _ddl(PROBE))
    hits = written(probes.groupBy("bucket").applyInArrow(settle_probes, _ddl(ANSWER)))

    def documents(table: pa.Table, open_: set[int]) -> list[tuple]:
        """For a digest: documents without a passage are done; only the texts of others go on."""
        rows = []
        for i, k in enumerate(table.column("__passage_key").to_pylist() if digest else []):
            raw = table.column("__passage_bytes")[i].as_py()
            words = zlib.decompress(raw).split()
            sha = None if i in open_ else sha256(b" ".join(words)).hexdigest()
            rows.append((-2, own(table), 0, *[None] * 5, i, None if k == LAST else k, len(words), sha, raw if i in open_ else None))
        return rows

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        yes = _bits_of(answers)
        if not yes.any():
            return _table(documents(table, set()), PASSAGE)
        batch = Batch(table)
        number = batch.probes(n)[1]
        bucket, name, check, first, at, of = batch.passages(yes[number], n)
        rows = [(b, own(table), s.stop - s.start, packed(name[s]), packed(check[s]), packed(first[s]), None, None, *[None] * 5) for b, s in _split(bucket)]
        # what the batch needs to read its answers: each passage's row, word, number, and whether an earlier one of the batch has it
        later = first[of] < batch.keys[batch.doc[at]]
        if len(at):
            rows.append((-1, own(table), len(at), None, None, None, packed(np.stack([batch.doc[at], batch.place[at]], 1).astype("<u4").reshape(-1)),
                         packed((of * 2 + later).astype("<i8")), *[None] * 5))
        return _table(rows + documents(batch.order, set(batch.doc[at].tolist())), PASSAGE)

    asked = written(texts.groupBy("__passage_batch").cogroup(hits.withColumnRenamed("batch", "__passage_for").groupBy("__passage_for")).applyInArrow(extend, _ddl(PASSAGE)))
    answered = asked.where("bucket >= 0").drop("at", "number", "doc", "key", "words", "sha", "raw").groupBy("bucket").applyInArrow(settle_passages, _ddl(ANSWER))
    states = asked.where("bucket = -1").select("batch", "bucket", "size", F.lit(None).cast("binary").alias("yes"), "at", "number")
    replies = states.unionByName(answered, allowMissingColumns=True).withColumnRenamed("batch", "__passage_for")
    if digest:
        schema = f"`{key}` long, n_words long, n_removed long, kept_sha256 string"

        def finish_digest(table: pa.Table, replies: pa.Table) -> pa.Table:
            gone, rows = gone_words(replies), []
            for i, k, raw in zip(*(_group(table.column(c)) for c in ("doc", "key", "raw"))):
                words = zlib.decompress(raw).split()
                lost = lost_words(gone.get(i), len(words))
                rows.append((k, len(words), sum(b - a for a, b in lost), sha256(b" ".join(kept_words(words, lost))).hexdigest()))
            return _table(rows, pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

        done = asked.where("bucket = -2 AND sha IS NOT NULL").select(F.col("key").alias(key), F.col("words").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
        open_ = asked.where("bucket = -2 AND sha IS NULL").select("batch", "doc", "key", "raw")
        return done.unionByName(open_.groupBy("batch").cogroup(replies.groupBy("__passage_for")).applyInArrow(finish_digest, schema))

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = table.sort_by([("__passage_key", "ascending"), ("__passage_hash", "ascending")])
        gone, new = gone_words(replies), []
        for i, t in enumerate(t.as_py() for t in table.column(text)):
            if i in gone:
                words = t.encode("utf-8", "replace").split()
                t = b" ".join(kept_words(words, lost_words(gone[i], len(words)))).decode("utf-8")
            new.append(t)
        out = table.drop_columns(["__passage_key", "__passage_hash", "__passage_batch"])
        return out.set_column(out.schema.get_field_index(text), text, pa.array(new, out.schema.field(text).type))

    return tagged.groupBy("__passage_batch").cogroup(replies.groupBy("__passage_for")).applyInArrow(finish, docs.schema)
