"""The text of a token's parent, found in the row of its sentence."""

from collections import Counter

from opinara.operators import textflow as tf
from opinara.plans import load_registry
from opinara.plans.fixtures import Tables

KINDS = "id long, spos int, pos int, head int, text string, lemma string, tag string, rel string"


def joined(rows):
    return Counter((i, s, p, t, u) for i, s, p, h, t in rows for j, r, q, _, u in rows if i is not None and (i, s, h) == (j, r, q) and p != h)


def test_parents_equal_a_join(spark):
    one = [(1, 0, p, p // 2, f"w{p}") for p in range(6)]
    several = [(2, 0, p, p // 2, f"{x}{p}") for x, n in (("a", 4), ("b", 2)) for p in range(n)]
    rows = [*one, *several, (3, 0, 0, 0, "alone"), (3, 1, 0, 1, "up"), (3, 1, 1, 1, "top"), (None, 0, 0, 0, "x"), (None, 0, 1, 0, "y")]
    df = spark.createDataFrame([(*r, "l", "NOUN", "dep") for r in rows], KINDS)
    assert Counter(map(tuple, tf.parent_texts(df, ["id", "spos"]).collect())) == joined(rows)


def test_no_token_is_shuffled(spark, tmp_path):
    texts = [(1, "A b c d. E f"), (1, "G h"), (2, "I j k l m"), (None, "N o"), (4, None)]
    spark.createDataFrame([(i, x, "en", "s", 5) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    found = load_registry()["j9_parent_token"].run(t)
    rows = [(r.id, r.spos, r.pos, r["head"], r.text) for r in t.tokens.collect()]
    assert Counter(map(tuple, found.collect())) == joined(rows)
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert not [x for x in plan if "Join [" in x and "spos#" in x]
