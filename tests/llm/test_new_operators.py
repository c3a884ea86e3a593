"""Bit-plane clusters, tokenizer alignment and passage removal against brute force."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from opinara.llm import alignment, bitplanes, passages
from tests.llm.conftest import EDGE

# --- bit planes ---


def test_planes_give_exact_dot_products_and_distances():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-5000, 5000, (40, 64)), rng.integers(-(1 << 26), 1 << 26, (5, 64))
    px, pc = bitplanes.to_planes(x, bitplanes.width_of(-5000, 4999)), bitplanes.to_planes(c, 28)
    assert (bitplanes.unpacked(px) == x).all() and (bitplanes.unpacked(pc) == c).all()
    assert (bitplanes.dots(px, pc) == x @ c.T).all()
    assert (bitplanes.distances(px, pc) == ((x[:, None] - c[None]) ** 2).sum(axis=2)).all()
    assert [bitplanes.width_of(a, b) for a, b in ((0, 0), (-1, 0), (0, 1), (-2, 1), (-3, 0))] == [1, 1, 2, 2, 3]


def brute_clusters(rows, k, rounds, scale=1024, seed=3):
    kept = [(i, np.array([int(np.floor(scale * float(e))) for e in v], object)) for i, v in rows]
    start = sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}:{r[0]}".encode()).hexdigest()))[:k]
    cents = [v for _, v in start]
    for r in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda j: (((v - cents[j]) ** 2).sum(), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(cents)):
                if members := [v for (_, v), o in zip(kept, own) if o == j]:
                    cents[j] = sum(members) // len(members)
    return sorted((i, o, int(((v - cents[o]) ** 2).sum())) for (i, v), o in zip(kept, own)), cents


SCHEMA = "vec_id long, embedding array<float>, cluster int, key string"


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = [[float(np.float32(e)) for e in v] for v in np.vstack([rng.normal(size=(60, 64)), np.repeat(rng.normal(size=(1, 64)), 40, axis=0), np.zeros((3, 64))])]
    rows = list(enumerate(x)) + [(0, x[1])]  # a repeated key is another vector
    edge = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] * 64)]
    df = spark.createDataFrame([(i, v, 9, "clash") for i, v in rows + edge], SCHEMA)
    for k in (3, 8):
        found = bitplanes.cluster(df, "vec_id", "embedding", k=k, rounds=5)
        want, cents = brute_clusters(rows, k, 5)
        assert sorted(tuple(r) for r in found.rows.collect()) == want
        assert [list(c) for c in found.centroids] == [list(c) for c in cents]
        per = Counter()
        for _, o, d in want:
            per[o] += d
        for r in bitplanes.with_inertia(found).collect():
            assert (r.cluster_inertia, r.inertia) == (per[r.cluster], sum(per.values()))


def test_clusters_of_few_none_and_huge_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64, 0, ""), (2, [-0.5] * 64, 0, ""), (None, [0.5] * 64, 0, "")], SCHEMA)
    assert {(r.key, r.distance) for r in bitplanes.cluster(df, "vec_id", "embedding").rows.collect()} == {(1, 0), (2, 0), (None, 0)}
    assert bitplanes.with_inertia(bitplanes.cluster(df.limit(0), "vec_id", "embedding")).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 64, 0, "")], SCHEMA)
    with pytest.raises(ArithmeticError):
        bitplanes.cluster(huge, "vec_id", "embedding")


# --- alignment ---

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def whole_alignment(pair, text):
    """Tokens of the whole text at once: (a, b, groups, links) or None."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode("utf-8")
    pa, pb = [pair.bytes_a.get(i) for i in a], [pair.bytes_b.get(i) for i in b]
    if None in pb or b"".join(pa) != raw or b"".join(pb) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(p) for p in pa]), np.cumsum([len(p) for p in pb])
    both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups, links, fa, fb = [], [], 0, 0
    for e in both:
        i, j = int(np.searchsorted(ends_a, e)) + 1, int(np.searchsorted(ends_b, e)) + 1
        groups.append(",".join(map(str, a[fa:i])) + "|" + ",".join(map(str, b[fb:j])))
        links.append((a[i - 1], b[j - 1]))
        fa, fb = i, j
    return a, b, groups, links


def odd_texts(n=300):
    rng = random.Random(7)
    parts = ["word", "Über", "naïve", " ", "  ", "\n", " \n ", "\t", "\x1c", "\x85", " ", "　", "日本語", "🙂", "don't", "x=1;", "12345", "...", "<s>", "</s>",
             "<0x41>", "<|endoftext|>", "\r\n", "é", "​", "_", "a" * 30, " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)] + [" ", "\n", "  ", " a", "a ", "a  ", "\n ", "a\n", "▁", "a▁b", "\x00"]


def test_words_tokenise_apart_as_they_do_together():
    pair = alignment.Pair(*PATHS)
    assert pair.apart
    for t in odd_texts():
        words = pair.words(t)
        assert "".join(words) == " " + t
        made, want = pair.align(words), whole_alignment(pair, t)
        assert made.ok.all() == (want is not None), repr(t)
        if want:
            a, b, groups, links = want
            assert b"".join(made.groups).decode() == ";".join(groups) + ";", repr(t)
            assert (made.n_a.sum(), made.n_b.sum(), [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in made.links], made.n_links.sum()) == (len(a), len(b), links, len(links))


def brute_alignment(rows):
    pair = alignment.Pair(*PATHS)
    made = [(k, whole_alignment(pair, t)) for k, t in rows]
    count = Counter(x for _, m in made if m for x in m[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for k, m in made:
        if m is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = m
            out.append((k, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                        sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [40, 4 << 20])
def test_alignment_equals_brute_force(spark, make_docs, chars):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(odd_texts(80), 100)] + EDGE
    rows += [(1000 + i, rng.choice(["the same text", "the same text again", "x"])) for i in range(200)] + [(1000, "the same text")]
    got = sorted((tuple(r) for r in alignment.align(make_docs(rows), *PATHS, batch_chars=chars).collect()), key=repr)
    assert got == brute_alignment(rows)


def test_alignment_of_long_texts_and_no_rows(spark, make_docs):
    assert alignment.align(make_docs([(1, "a")]).limit(0), *PATHS).count() == 0
    assert alignment.align(make_docs([(1, None), (2, "")]), *PATHS).collect()[0].n_a == 0
    rows = [(1, "some words and more " * 100_000), (2, "0123456789abcdef" * 20_000)]
    assert sorted((tuple(r) for r in alignment.align(make_docs(rows), *PATHS).collect()), key=repr) == brute_alignment(rows)


def test_known_words_are_one_run_of_bytes():
    """A worker remembers hundreds of thousands of words: each is one value, not a tuple of six."""
    pair = alignment.Pair(*PATHS)
    words = pair.words("many words, many more words\n and ñandú \u2603 <s>") + ["  ", " many"]
    made, want = pair.align(words), pair.align_new(words)
    for c in ("ok", "n_a", "n_b", "n_links", "links"):
        assert getattr(made, c).tolist() == getattr(want, c).tolist()
    assert made.groups == want.groups and made.ok.dtype == bool
    assert all(type(x) is bytes for x in pair.known.values())
    assert pair.align([]).groups == []


# --- passages ---


def brute_passages(rows):
    last, width = float("inf"), passages.WINDOW
    split = [(k, (t or "").encode().split()) for k, t in rows]
    least = {}
    for k, w in split:
        for i in range(len(w) - width + 1):
            s = tuple(w[i:i + width])
            least[s] = min(least.get(s, last), last if k is None else k)
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i:i + width])] < (last if k is None else k):
                gone |= set(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passage_rows():
    rng = random.Random(5)
    some = [f"w{i}" for i in range(30)]
    phrase = [" ".join(rng.choice(some) for _ in range(n)) for n in (49, 50, 51, 75, 130)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(phrase), " ".join(rng.choice(some) for _ in range(rng.randint(0, 30)))]
        rows.append((i, rng.choice([" ", "\n", "\t \n"]).join(parts)))
    copies = [(500 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1]), (7, phrase[4]), (None, phrase[4]), (None, phrase[3] + " end")]
    edge = [(k if k is None else 1000 + k, t) for k, t in EDGE]
    return rows + copies + edge + [(2000, "the same words again and again " * 30), (2001, "é è ☃ " * 40), (2002, "　".join("ab") + " x" * 70), (2003, " x" * 70)]


@pytest.mark.parametrize("size", [2000, 8 << 20])
def test_passages_equal_brute_force(spark, make_docs, size):
    rows = passage_rows()
    docs = make_docs(rows)
    got = sorted((tuple(r) for r in passages.remove_passages(docs, digest=True, batch_bytes=size).collect()), key=repr)
    assert got == brute_passages(rows)
    left = passages.remove_passages(docs, batch_bytes=size)
    assert left.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in left.collect()}
    whole = {(k, t) for k, t in rows}
    assert (1001, None) in texts and (500, "") in texts
    for k, t in texts - whole:  # what changed has one blank between words
        assert t == " ".join(t.split(" ")) and not t.startswith(" ")


def test_hashes_do_not_depend_on_chunks():
    rng = random.Random(3)
    raw = "".join(rng.choice(["ab", "c", " ", "\n", "日本"]) for _ in range(3000)).encode() + b"\n"
    whole = passages.word_hashes(raw)
    for chunk in (7, 100):
        passages._tables.clear()
        old, passages.CHUNK = passages.CHUNK, chunk
        try:
            parts = passages.word_hashes(raw)
        finally:
            passages.CHUNK = old
            passages._tables.clear()
        assert (parts[0] == whole[0]).all() and (parts[1] == whole[1]).all()
    words = raw.split()
    assert len(words) == len(whole[1]) and len(set(words)) == len(set(whole[1].tolist()))


def test_passages_of_no_rows_and_a_long_text(spark, make_docs):
    assert passages.remove_passages(make_docs([(1, "a")]).limit(0), digest=True).count() == 0
    rows = [(2, " ".join(map(str, range(400_000)))), (1, " ".join(map(str, range(1000, 1060))))]
    assert sorted(tuple(r)[:3] for r in passages.remove_passages(make_docs(rows), digest=True).collect()) == [(1, 60, 0), (2, 400_000, 60)]


def test_only_texts_with_a_passage_are_dealt_again(spark, make_docs, monkeypatch):
    said, tables = " ".join(f"w{i}" for i in range(60)), []
    rows = [(1, f"a {said}"), (2, f"{said} b"), *[(i, f"{i} " * 70) for i in range(10, 30)], (None, "short")]
    real = passages.written
    monkeypatch.setattr(passages, "written", lambda df: tables.append(real(df)) or tables[-1])
    got = passages.remove_passages(make_docs(rows), digest=True).collect()
    assert sorted(map(tuple, got), key=repr) == brute_passages(rows)
    assert {r.key for r in tables[-1].where("raw IS NOT NULL").collect()} <= {1, 2}
