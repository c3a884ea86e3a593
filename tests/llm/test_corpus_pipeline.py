"""Whole queries on the small tables, and the pipeline against a brute-force version."""

import os
import random

import pytest

import __spark_entry__
import corpus_pipeline
from opinara.llm import packing, queries, secrets, toxicity
from tests.compare import duck, rows
from tests.llm.test_text_operators import WORDS, brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = duck(FOLDER).execute(queries.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cursor.description], cursor.fetchall())


@tables
def test_every_operator_is_registered(spark):
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@tables
def test_held_out_languages(spark):
    got = {r.doc_id: r for r in queries.op8_language(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if got[d.doc_id].held_out and d.lang]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}x" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randrange(5, 120)) for _ in range(60)]
    passage = text(40)
    docs = [(i, t + (" vile scum filth" if i % 7 == 0 else "")) for i, t in enumerate(base)]
    docs += [(100 + i, docs[i][1]) for i in range(1, 20, 3)] + [(200 + i, text(30) + passage + text(20)) for i in range(8)]
    docs += [(300, "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff " + text(20)), (301, None), (302, "")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int("scum" in (t or ""))) for k, t in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    scorer = queries.toxicity_scorer(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(k, t) for k, t in sorted(docs) if scorer.score(scorer.counts(t))[0] < 0.5]
    assert {k for k, t in docs if "scum" in (t or "")}.isdisjoint(k for k, _ in left)
    roots = brute_components([brute_fingerprint(t) for _, t in left])
    left = [d for i, d in enumerate(left) if roots[i] == i]
    seen, clean = set(), []
    for k, t in left:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                cover[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        clean.append((k, bytes(x for x, c in zip(b, cover) if not c).decode()))
    tok = packing.Tokens(WORDS)
    want = {}
    for k, t in clean:
        out, at = [], 0
        for s in secrets.spans(t):
            if s["start"] >= at:
                out += [t[at:s["start"]], "[secret]"]
            at = max(at, s["end"])
        want[k] = tok.ids("".join(out) + t[at:]) + b"\2\0\0\0"
    pieces = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + bytes(r.ids)
    assert pieces == want


def test_stages_take_edge_rows(spark, make_docs, tmp_path):
    from tests.llm.conftest import EDGE

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (make_docs(EDGE), make_docs([])):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            if name != "packing":
                assert got.columns == table.columns, name
            got.collect()
    kept = corpus_pipeline.simhash_stage(spark, make_docs([*EDGE, (4, "word")]), str(tmp_path))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 9]


def test_scorer_without_labels(spark, make_docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(make_docs([(1, "x")]), queries.toxicity_scorer(make_docs([(1, "x")]), empty)).first().score == 0.0
