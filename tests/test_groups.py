"""Functions over groups of any size, and corrections learned from a stream."""

import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.operators import groups as gr
from opinara.operators import textflow as tf
from opinara.streaming import jobs as st


def longest(limit):
    """The number of rows and the longest names of a group; fails on more than ``limit`` rows at once."""

    def update(s, rows):
        assert len(rows) <= limit
        return merge(s, (len(rows), set(rows["name"].dropna())))

    def merge(a, b):
        return a[0] + b[0], set(sorted(a[1] | b[1], key=lambda x: (-len(x), x))[:2])

    def finish(s):
        return pd.DataFrame({"n": s[0], "name": sorted(s[1])})

    return gr.Fold(lambda: (0, set()), update, merge, finish)


@pytest.mark.parametrize("held", [2, 10_000])
def test_a_hot_group_is_folded_in_several_tasks(spark, held):
    rows = [("hot" if i % 3 else f"k{i % 7}", i % 2 if i % 5 else None, "x" * (i % 40) + str(i)) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, h int, name string").repartition(12)
    got = {}
    for r in gr.fold_groups(df, ["g", "h"], longest(1000), "n long, name string", held=held, fan=4).collect():
        got.setdefault((r.g, r.h, r.n), []).append(r.name)
    want = {}
    for g, h, name in rows:
        want.setdefault((g, h), []).append(name)
    assert got == {(*k, len(v)): sorted(sorted(v, key=lambda x: (-len(x), x))[:2]) for k, v in want.items()}
    assert gr.fold_groups(df.limit(0), ["g"], longest(9), "n long, name string").count() == 0


def texts():
    rng = random.Random(4)
    right = ["maison", "jardin", "voiture", "montagne"]
    rows = [(i, " ".join(rng.choice(right) for _ in range(12))) for i in range(60)]
    wrong = ["maisn", "jardn", "voitture", "montagn", "xyzzy"]
    return rows + [(100 + i, f"{rng.choice(right)}, {w}! {rng.choice(right)}") for i, w in enumerate(wrong)] + [(200, None), (201, "")]


def learned(spark, tmp_path, name, parts):
    source, state = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-state")
    schema = spark.createDataFrame([], "id long, text string").schema
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        st.learning_correction_stream(spark, source, schema, state)
    return state, schema, source


def test_any_split_ends_at_the_result_of_one_batch(spark, tmp_path):
    rows = texts()
    df = spark.createDataFrame(rows, "id long, text string")
    counts = df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    want = {r.id: r.corrected_text for r in tf.correct_texts(df, tf.corrections(counts)).collect()}
    assert set(want) == {100, 101, 102, 103}
    # first the misspelt texts, when nothing is known; then the others in two lots
    state, schema, source = learned(spark, tmp_path, "a", [rows[60:], rows[:20], rows[20:60]])
    got = {r.id: r.corrected_text for r in st.learned_corrections(spark, state).collect()}
    assert got == want
    # the last batch once more: its progress is lost, its folders are there
    shutil.rmtree(f"{state}/progress/commits")
    (tmp_path / "a-state/progress/commits").mkdir()
    st.learning_correction_stream(spark, source, schema, state)
    assert {r.id: r.corrected_text for r in st.learned_corrections(spark, state).collect()} == want


def test_rows_of_a_small_group_are_updated_together(spark):
    """Scattered rows of many groups: a group costs about one update, not one a row."""
    calls = spark.sparkContext.accumulator(0)

    def update(s, rows):
        calls.add(1)
        return s + len(rows)

    fold = gr.Fold(lambda: 0, update, lambda a, b: a + b, lambda s: pd.DataFrame({"n": [s]}))
    df = spark.range(12_000).selectExpr("IF(id % 300 = 0, NULL, id % 300) AS g", "id").repartition(12)
    got = {r.g: r.n for r in gr.fold_groups(df, ["g"], fold, "n long").collect()}
    assert got == {k or None: 40 for k in range(300)}
    assert calls.value <= 2 * 300
