"""Texts meet the vectors of their words where they stand."""

import numpy as np
import pytest

from opinara.operators import wordvectors as wv
from opinara.plans import q_vectors as qv

TEXTS = [(1, 0, "red blue red"), (1, 0, "green none"), (2, 0, "Blue, green!"), (2, 1, "none at all"), (None, 0, "red"), (3, None, "red"), (4, 0, None), (5, 0, ""), (6, 0, "zero")]
WORDS = [("red", 7), ("blue", 8), ("green", 8), ("zero", 9), ("odd", 404), (None, 7), ("lost", None)]
VECTORS = [(7, [3.0, 4.0]), (8, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [0.0, 0.0]), (11, None), (None, [9.0, 9.0])]


def rows_of(df):
    show = lambda v: None if v is None else tuple(round(x, 9) for x in v)
    return sorted(((r.id, r.spos, r.text, r.n_known, show(r.vec)) for r in df.collect()), key=str)


@pytest.mark.parametrize("shared", [True, False])
def test_a_held_dictionary_gives_what_a_join_gives(spark, shared):
    texts = spark.createDataFrame(TEXTS, "id long, spos int, text string").select("text", "id", "spos")
    words, vectors = spark.createDataFrame(WORDS, "word string, id long"), spark.createDataFrame(VECTORS, "id long, vec array<double>")
    if not shared:  # a word that stands twice in a dictionary of its own counts twice
        words, vectors = words.join(vectors.where("vec IS NOT NULL"), "id").select("word", "vec"), None
    else:
        vectors = vectors.where("id IS NULL OR vec IS NOT NULL")
    held = wv.mean_vectors(texts, ["id", "spos"], "text", words, vectors)
    joined = wv.mean_vectors(texts, ["id", "spos"], "text", words, vectors, most=0)
    assert held.columns == joined.columns == ["id", "spos", "text", "n_known", "vec"]
    assert rows_of(held) == rows_of(joined)
    got = {(r.id, r.spos, r.text): r for r in held.collect()}
    both = 2 * np.array([3.0, 4.0]) + 2 * np.ones(2)  # blue and green have two vectors each
    assert got[1, 0, "green none"].n_known == 6 and got[1, 0, "green none"].vec == pytest.approx(both / np.linalg.norm(both))
    assert got[None, 0, "red"].vec is got[3, None, "red"].vec is got[2, 1, "none at all"].vec is None
    assert got[6, 0, "zero"].vec == [0.0, 0.0]


def test_sentences_are_embedded_without_a_join_of_their_words(spark, tmp_path):
    """However many words a corpus has, a word and its vector are not shuffled."""
    for name, n in (("one", 3), ("more", 400)):
        rows = [(i, " ".join(f"w{i}x{j}" for j in range(n)) + ". again w1", "en", "s", 5) for i in range(4)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(9)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        plan = qv.sentence_vectors(qv_tables(spark, f"{tmp_path}/{name}"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "hashpartitioning(word" not in plan and "SortMergeJoin" not in plan


def qv_tables(spark, folder):
    from opinara.plans.fixtures import Tables

    return Tables(spark, folder)


def test_files_of_a_stream_hold_no_vectors_but_those_of_shared_keys(spark, tmp_path):
    rows = [(1, "red blue. green"), (1, "green blue"), (2, "red"), (None, "red")]
    spark.createDataFrame([(i, x, "en", "s", 5) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(9)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = qv_tables(spark, str(tmp_path))
    means, files = qv.unembedded_sentences(t)
    assert {(r.id, r.spos, r.sentence): r.vec is None for r in files.collect()} == {
        (1, 0, "red blue"): False, (1, 0, "green blue"): False, (1, 1, "green"): True, (2, 0, "red"): True}
    want = {(r.id, r.spos, r.sentence): r.vec for r in qv.sentence_vectors(t).collect()}
    got = {(r.id, r.spos, r.sentence): r.vec for r in qv.embedded(means, files).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("held", [wv.HELD_BYTES, 0])
def test_learned_vectors_are_the_same_packed_and_joined(spark, monkeypatch, held):
    """A block that a task holds needs no table of pairs, whichever word of a pair comes first."""
    from tests.test_wordvectors import corpus

    monkeypatch.setattr(wv, "STEP_PAIRS", 50)
    if held:  # counts are packed where they are made
        monkeypatch.setattr(wv, "cooccurrences", None)
        monkeypatch.setattr(wv, "_times", None)
    df = spark.createDataFrame([*corpus(150), (9000, "a1 a1 a1 a1"), (9001, None), (9002, "a2")], "id long, text string")
    got = {r.word: np.array(r.vec) for r in wv.word_vectors(df, "text", size=3, rounds=6, shift=1.2, held=held).collect()}
    monkeypatch.undo()
    found, values = wv.eigenvectors(wv.positive_information(wv.cooccurrences(df, "text", wv.frequent_words(df, "text")), 1.2), 3, rounds=6)
    want = {r.word: np.array(r.vec) * np.sqrt(np.abs(values)) for r in found.collect()}
    names = sorted(want)
    a, b = (np.stack([x[w] for w in names]) for x in (got, want))
    assert got.keys() == want.keys() and np.abs(a @ a.T) == pytest.approx(np.abs(b @ b.T), abs=1e-6)
