"""Removal of repeated 100-byte passages by distributed prefix doubling.

Positions get names (ranks up to equality) for the 1, 2, 4, ... 64 bytes that follow
them, each from the pair of names half as long at a growing offset.  Sorting every
position of a corpus is not needed: each 100-byte string picks, by its content alone,
one anchor among its 32-byte names, so equal strings have equal anchors at the same
offset.  Round one sorts the anchors' names over the whole corpus and ends for those
that are unique.  Round two, for anchors whose name recurs in other surroundings,
doubles on to the 100-byte names of every string that holds such an anchor.  The
threshold is reached there, and all but the first occurrence of a name are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import written

LENGTH = 100
GRAM = 32
SLICE = 1 << 20
POSITION_BITS = 23  # more than a slice of whole documents and one long part can hold


def _odd(k: int, family: int) -> np.uint64:
    """An odd 64-bit multiplier from a counter."""
    x = (k * 0x9E3779B97F4A7C15 + family * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return np.uint64((x ^ (x >> 27)) | 1)


BYTES = [np.array([_odd(b + 1, f) for b in range(256)], np.uint64) for f in (1, 2)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every bit depends on all; in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def doubled(data: np.ndarray, family: int, keep: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of the strings of the lengths ``keep`` (powers of two) from every position."""
    names, width, out = BYTES[family][data], 1, {}
    while True:
        if width in keep:
            out[width] = names
            if width == max(keep):
                return out
        left = names[:-width] * _odd(width, 7 + family)
        left ^= left >> np.uint64(29)
        left += names[width:]
        names, width = left, 2 * width


def hundred(names64: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the 100-byte strings at ``at``: two of 64 bytes that overlap."""
    return mixed(names64[at] * _odd(100, 11) + names64[at + (LENGTH - 64)])


class Slices:
    """Whole documents, or overlapping parts of one long document, laid end to end."""

    def __init__(self, data: np.ndarray, doc: np.ndarray, shift: np.ndarray, size: np.ndarray):
        self.data, self.doc, self.shift, self.size = data, doc, shift, size
        self.base = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)

    def starts(self) -> np.ndarray:
        """All positions at which a 100-byte string begins, document by document."""
        n = np.maximum(0, self.size - LENGTH + 1)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        return np.arange(n.sum()) + np.repeat(self.base - first, n)

    def locate(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document index and position in the document."""
        k = np.searchsorted(self.base, at, "right") - 1
        return self.doc[k], at - self.base[k] + self.shift[k]


def sliced(texts: list[bytes]) -> Iterator[Slices]:
    """Bounded slices of a batch; parts of a long document overlap by 99 bytes, so every
    100-byte string lies in exactly one slice."""
    part: list[tuple[bytes, int, int]] = []
    size = 0

    def laid():
        raw = b"".join(p for p, _, _ in part)
        return Slices(np.frombuffer(raw, np.uint8), np.array([d for _, d, _ in part]), np.array([s for _, _, s in part]),
                      np.array([len(p) for p, _, _ in part], np.int64))

    for d, t in enumerate(texts):
        for s in range(0, max(0, len(t) - LENGTH + 1), SLICE):
            p = t[s:s + SLICE + LENGTH - 1]
            if part and size + len(p) > SLICE:
                yield laid()
                part, size = [], 0
            part.append((p, d, s))
            size += len(p)
    if part:
        yield laid()


def anchors(s: Slices, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, anchor) of the runs of string starts that share an anchor: the position
    of the smallest 32-byte name inside the string, the leftmost of equal ones."""
    starts = s.starts()
    low = np.uint64((1 << POSITION_BITS) - 1)
    m = mixed(gram.copy())
    m &= ~low
    m |= np.arange(len(m), dtype=np.uint64)
    reach, width = LENGTH - GRAM + 1, 1
    while 2 * width <= reach:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if reach > width:
        m = np.minimum(m[:len(m) - (reach - width)], m[reach - width:])
    own = (m[starts] & low).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    end = np.concatenate([begin[1:], [len(own)]]) - 1
    return starts[begin], starts[end], own[begin]


# Records travel in blobs, so that a shuffled row is a bucket's share of a task.
ANCHOR = np.dtype([("gram", "<u4"), ("name", "<u8"), ("check", "<u4"), ("left", "<u2"), ("right", "<u2"), ("lo", "<u4"),
                   ("before", "u1"), ("after", "u1"), ("doc", "<u4")])
START = np.dtype([("name", "<u8"), ("check", "<u4"), ("lo", "<u4"), ("doc", "<u4")])
RANGE = np.dtype([("lo", "<u4"), ("hi", "<u4"), ("doc", "<u4")])
DOC = np.dtype([("key", "<i8"), ("hash", "<i8")])
KINDS = {"anchor": ANCHOR, "start": START, "repeat": RANGE, "open": RANGE}
BLOB = "bucket int, kind string, docs binary, rows binary"
FLUSH = 1 << 19


def blobs(kind: str, rows: np.ndarray, docs: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, str, bytes, bytes]]:
    """One blob a bucket: its rows and the documents that they name."""
    order = np.lexsort((rows["lo"], rows["doc"], bucket))
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, b in zip(np.split(rows, cuts), bucket[np.concatenate([[0], cuts]).astype(int)] if len(rows) else ()):
        used, part = np.unique(part["doc"], return_inverse=True), part.copy()
        part["doc"], used = used[1], used[0]
        yield int(b), kind, docs[used].tobytes(), b"".join(part[c].tobytes() for c in part.dtype.names)  # by column: they compress better


def opened(kind: str, docs: list[bytes], rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, documents) of several blobs, renumbered."""
    tables, parts, at = [], [], 0
    for d, r in zip(docs, rows):
        part, at_byte = np.zeros(len(r) // KINDS[kind].itemsize, KINDS[kind]), 0
        for c in part.dtype.names:
            part[c] = np.frombuffer(r, KINDS[kind][c], len(part), at_byte)
            at_byte += part[c].nbytes
        part["doc"] += np.uint32(at)
        tables.append(np.frombuffer(d, DOC))
        parts.append(part)
        at += len(tables[-1])
    return (np.concatenate(parts), np.concatenate(tables)) if parts else (np.zeros(0, KINDS[kind]), np.zeros(0, DOC))


def earlier(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, repeat): rows sorted by name and then by place, and which of them (in that
    order) begin after the first of their name.  Rows of one place are all first."""
    key, h = docs["key"][rows["doc"]], docs["hash"][rows["doc"]]
    order = np.lexsort((rows["lo"], h, key, rows["check"], rows["name"]))
    r, key, h = rows[order], key[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r["name"][1:] != r["name"][:-1]) | (r["check"][1:] != r["check"][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) if len(r) else np.zeros(0, int)
    return order, (key != key[first]) | (h != h[first]) | (r["lo"] != r["lo"][first])


def joined(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ranges of string starts as RANGE rows, those that touch made one."""
    order = np.lexsort((lo, doc))
    lo, hi, doc = lo[order].astype(np.int64), hi[order].astype(np.int64), doc[order]
    new = np.ones(len(lo), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), RANGE)
    if len(at):
        out["lo"], out["doc"], out["hi"] = lo[at], doc[at], np.maximum.reduceat(hi, at)
    return out


def anchor_rows(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Round one in a batch: a row for every run of starts with one anchor."""
    for s in sliced(texts):
        one, two = doubled(s.data, 0, (32, 64)), doubled(s.data, 1, (64,))
        gram, n = one[32], len(one[32])
        lo, hi, at = anchors(s, gram)
        size = (hi - lo).astype(np.uint64)
        out = np.zeros(len(lo), ANCHOR)
        out["gram"] = gram[at] >> np.uint64(32)  # a chance meeting only leaves starts open
        out["name"] = mixed(hundred(one[64], lo) * _odd(1, 21) + hundred(one[64], hi) + size)
        out["check"] = (mixed(hundred(two[64], lo) * _odd(2, 21) + hundred(two[64], hi) + size) >> np.uint64(32)).astype(np.uint32)
        left, right = np.maximum(at - 34, 0), np.minimum(at + 34, n - 1)
        out["left"] = mixed(gram[left] * _odd(3, 21) + gram[left + 2]).astype(np.uint16)
        out["right"] = mixed(gram[right - 2] * _odd(3, 21) + gram[right]).astype(np.uint16)
        doc, place = s.locate(lo)
        out["lo"], out["doc"], out["before"], out["after"] = place, doc, at - lo, hi - lo
        yield out


def start_rows(text: bytes, wanted: np.ndarray, doc: int) -> Iterator[np.ndarray]:
    """Round two in a document: a row for every 100-byte string that begins in the ranges ``wanted``."""
    for s in sliced([text]):
        shift = int(s.shift[0])
        lo, hi = np.maximum(wanted["lo"].astype(np.int64) - shift, 0), np.minimum(wanted["hi"].astype(np.int64) - shift, int(s.size[0]) - LENGTH)
        n = np.maximum(0, hi - lo + 1)
        if n.sum():
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out = np.zeros(len(at), START)
            out["name"] = hundred(doubled(s.data, 0, (64,))[64], at)
            out["check"] = (hundred(doubled(s.data, 1, (64,))[64], at) >> np.uint64(32)).astype(np.uint32)
            out["lo"], out["doc"] = at + shift, doc
            yield out


def dealt(kind: str, rows: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, str, bytes, bytes]]:
    """Rows of a batch by the bucket of their name.  Of equal strings only the batch's
    first goes there; the batch itself knows the others to be repeats, so a string that
    everyone has arrives once from each batch."""
    order, repeat = earlier(rows, docs)
    rows = rows[order]
    later = rows[repeat]
    hi = later["lo"] + (later["after"] if kind == "anchor" else np.uint32(0))
    known = joined(later["lo"], hi, later["doc"])
    yield from blobs("repeat", known, docs, np.mod(docs["hash"][known["doc"]], buckets))
    rows = rows[~repeat]
    place = mixed(rows["gram"].astype(np.uint64)) if kind == "anchor" else rows["name"] >> np.uint64(20)
    yield from blobs(kind, rows, docs, (place % np.uint64(buckets)).astype(np.int64))


def settle_anchors(rows: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, str, bytes, bytes]]:
    """Round one in a bucket: equal surroundings are settled; of an anchor name that
    recurs in other surroundings the starts whose 66 bytes on one side recur stay open."""
    order, repeat = earlier(rows, docs)
    rows = rows[order]
    later, rows = rows[repeat], rows[~repeat]
    ranges = joined(later["lo"], later["lo"] + later["after"], later["doc"])
    yield from blobs("repeat", ranges, docs, np.mod(docs["hash"][ranges["doc"]], buckets))
    # repeated rows of one document are all first: count their surroundings once
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["name"][1:] != rows["name"][:-1]) | (rows["check"][1:] != rows["check"][:-1])

    def recurs(side):
        by = np.lexsort((side, rows["gram"]))
        g, s = rows["gram"][by], side[by]
        new = np.ones(len(by), bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        out = np.zeros(len(by), bool)
        out[by] = (np.bincount(group, fresh[by]) > 1)[group] if len(by) else False
        return out

    at = rows["lo"].astype(np.int64) + rows["before"]
    lo, hi = rows["lo"].astype(np.int64), rows["lo"].astype(np.int64) + rows["after"]
    left, right = recurs(rows["left"]), recurs(rows["right"])
    a, b = left & (lo <= at - 34), right & (hi > at - 34)
    ranges = joined(np.concatenate([lo[a], np.maximum(lo, at - 33)[b]]), np.concatenate([np.minimum(hi, at - 34)[a], hi[b]]),
                    np.concatenate([rows["doc"][a], rows["doc"][b]]))
    yield from blobs("open", ranges, docs, np.mod(docs["hash"][ranges["doc"]], buckets))


def settle_starts(rows: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, str, bytes, bytes]]:
    """Round two in a bucket: past the threshold, all but the first of a name are repeats."""
    order, repeat = earlier(rows, docs)
    later = rows[order][repeat]
    ranges = joined(later["lo"], later["lo"], later["doc"])
    yield from blobs("repeat", ranges, docs, np.mod(docs["hash"][ranges["doc"]], buckets))


def _settled(sent: DataFrame, kind: str, settle, buckets: int) -> DataFrame:
    """Bring the blobs of a bucket together and settle them; ``repeat`` blobs pass."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        own = f["kind"] == kind
        out = list(settle(*opened(kind, f["docs"][own], f["rows"][own]), buckets)) if own.any() else []
        out += list(f[~own][["bucket", "kind", "docs", "rows"]].itertuples(index=False, name=None))
        return pd.DataFrame(out, columns=["bucket", "kind", "docs", "rows"])

    return sent.groupBy("bucket").applyInPandas(run, BLOB)


def _ranges(table, kind: str) -> dict[tuple[int, int], np.ndarray]:
    """RANGE rows of a bucket's blobs by document (key, hash)."""
    picked = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
    rows, docs = opened(kind, [table.column("docs")[i].as_py() for i in picked], [table.column("rows")[i].as_py() for i in picked])
    if not len(rows):
        return {}
    key, h = docs["key"][rows["doc"]], docs["hash"][rows["doc"]]
    order = np.lexsort((rows["lo"], h, key))
    rows, key, h = rows[order], key[order], h[order]
    cuts = np.flatnonzero((key[1:] != key[:-1]) | (h[1:] != h[:-1])) + 1
    at = np.concatenate([[0], cuts])
    return {(int(key[i]), int(h[i])): part for i, part in zip(at, np.split(rows, cuts))}


def covered(ranges: np.ndarray | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that begin in ``ranges``."""
    if ranges is None:
        return []
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(ranges["lo"].tolist(), ranges["hi"].tolist())):
        a, b = lo, min(size, hi + LENGTH)
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished rounds before the next one."""
    import gc

    for _ in range(2):  # plans hold shuffles through several weak links
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, buckets: int | None = None) -> DataFrame:
    """``docs`` without the bytes covered by 100-byte strings that also start earlier
    (smaller key, or the same document and an earlier place).

    ``text`` becomes what is left, undecodable bytes at the cuts dropped; with ``digest``
    the result is (key, n_bytes, n_removed, n_spans, kept_sha256) instead.  Null texts
    have no bytes and stay null; documents with a null key come last; of rows with one
    key, equal ones are one document and others are ordered by a hash of their text.
    Every round deals its records into ``buckets`` (the number of shuffle partitions) by name
    and back by document; a task holds one bucket, about 1/buckets of the corpus.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (1 << 63) - 1
    tagged = docs.withColumn("__repeats_key", F.coalesce(F.col(key).cast("long"), F.lit(last))).withColumn("__repeats_hash", F.xxhash64(F.col(key), F.col(text)))
    slim = tagged.select("__repeats_key", "__repeats_hash", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__repeats_bytes"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tables, size, known = [], [], 0, 0

        def flush():
            sent = dealt("anchor", np.concatenate(held), np.concatenate(tables), n)
            return pd.DataFrame(list(sent), columns=["bucket", "kind", "docs", "rows"])

        for f in frames:
            table = np.zeros(len(f), DOC)
            table["key"], table["hash"] = f["__repeats_key"], f["__repeats_hash"]
            tables.append(table)
            for part in anchor_rows(list(f["__repeats_bytes"])):
                part["doc"] += np.uint32(known)
                held.append(part)
                size += len(part)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
            known += len(f)
        if held:
            yield flush()

    round_one = written(_settled(slim.mapInPandas(find, BLOB), "anchor", settle_anchors, n))
    _release(spark)
    by_doc = tagged.withColumn("__repeats_bucket", F.pmod(F.col("__repeats_hash"), F.lit(n)).cast("int"))
    blob_schema = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("docs", pa.binary()), ("rows", pa.binary())])

    def double(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = _ranges(right, "open")
        sent, held, table, size = [], [], [], 0
        for k, h, t in zip(*(left.column(c).to_pylist() for c in ("__repeats_key", "__repeats_hash")), left.column("__repeats_bytes")):
            if (ranges := wanted.get((k, h))) is None:
                continue
            for part in start_rows(t.as_py(), ranges, len(table)):
                held.append(part)
                size += len(part)
            table.append((k, h))
            if size >= FLUSH:
                sent += dealt("start", np.concatenate(held), np.array(table, DOC), n)
                held, table, size = [], [], 0
        if held:
            sent += dealt("start", np.concatenate(held), np.array(table, DOC), n)
        columns = list(zip(*sent)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, blob_schema.types)], schema=blob_schema)

    texts = slim.withColumn("__repeats_bucket", F.pmod(F.col("__repeats_hash"), F.lit(n)).cast("int"))
    open_ = round_one.where("kind = 'open'").withColumnRenamed("bucket", "__repeats_for")
    sent = texts.groupBy("__repeats_bucket").cogroup(open_.groupBy("__repeats_for")).applyInArrow(double, BLOB)
    round_two = written(_settled(sent, "start", settle_starts, n))
    _release(spark)
    repeats = round_one.where("kind = 'repeat'").unionByName(round_two).withColumnRenamed("bucket", "__repeats_for")

    if digest:
        final = texts
        schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        final, schema = by_doc, docs.schema

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _ranges(right, "repeat")
        keys, hashes = left.column("__repeats_key").to_pylist(), left.column("__repeats_hash").to_pylist()
        if digest:
            rows = []
            for k, h, t in zip(keys, hashes, left.column("__repeats_bytes")):
                raw = t.as_py()
                runs = covered(found.get((k, h)), len(raw))
                rows.append((None if k == last else k, len(raw), sum(b - a for a, b in runs), len(runs), sha256(kept_bytes(raw, runs)).hexdigest()))
            types = [pa.int64()] * 4 + [pa.string()]
            return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)],
                            names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        new = []
        for k, h, t in zip(keys, hashes, left.column(text)):
            t = t.as_py()
            runs = covered(found.get((k, h)), len(t.encode("utf-8", "replace"))) if t and (k, h) in found else []
            new.append(kept_bytes(t.encode("utf-8", "replace"), runs).decode("utf-8", "ignore") if runs else t)
        out = left.drop_columns(["__repeats_key", "__repeats_hash", "__repeats_bucket"])
        return out.set_column(out.schema.get_field_index(text), text, pa.array(new, out.schema.field(text).type))

    return final.groupBy("__repeats_bucket").cogroup(repeats.groupBy("__repeats_for")).applyInArrow(finish, schema)
