"""Terms of several words against a search by hand."""

import random

import pytest
from pyspark.sql import functions as F

from opinara.operators import aspects as asp
from opinara.operators import phrases as ph

SCHEMA = "id long, spos int, pos int, head int, text string, lemma string, tag string, rel string"


def brute(rows, terms):
    sents = {}
    for r in rows:
        if r[5]:
            sents.setdefault((r[0], r[1]), []).append((r[2], r[5]))
    out = []
    for (i, s), words in sents.items():
        words.sort()
        for term, lemmas in terms:
            for k in range(len(words) - len(lemmas) + 1):
                if [w for _, w in words[k:k + len(lemmas)]] == lemmas:
                    out.append((i, s, term, words[k][0], words[k + len(lemmas) - 1][0]))
    return sorted(out)


@pytest.mark.parametrize("rows_in_memory", [ph.BROADCAST_ROWS, 0])
def test_occurrences_equal_brute_force(spark, monkeypatch, rows_in_memory):
    monkeypatch.setattr(ph.checked_small, "__defaults__", (rows_in_memory,))
    rng = random.Random(3)
    rows = []
    for i in range(60):
        for s in range(rng.randint(1, 3)):
            for p in range(rng.randint(0, 14)):
                lemma = rng.choice(["a", "bb", "ccc", "a", "bb", "", None])
                rows.append((i, s, p, 0, lemma or ",", lemma, "NOUN", "dep"))
    terms = [("t1", ["a"]), ("t2", ["a", "bb"]), ("t3", ["bb", "a", "bb"]), ("t4", ["a", "a"]), ("t5", ["ccc"]), ("t6", ["ccc", "ccc", "ccc", "ccc"]), ("t7", ["zz", "a"])]
    found = ph.occurrences(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(terms, "term string, lemmas array<string>"), ["id", "spos"])
    want = brute(rows, terms)
    assert sorted(map(tuple, found.collect())) == want and {w[2] for w in want} >= {"t1", "t2", "t3", "t4", "t5"}


def test_terms_get_the_lemmas_of_the_corpus(spark):
    words = [("Экраны", "экран")] * 3 + [("экраны", "экранный")] + [("яркие", "яркий"), ("Яркие", "яркий"), ("!", "")]
    tokens = spark.createDataFrame([(1, 0, i, 0, t, m, "NOUN", "dep") for i, (t, m) in enumerate(words)], SCHEMA)
    lexicon = spark.createDataFrame([("g", "a", "Яркие экраны"), ("g", "a", "экраны"), ("g", "b", "unknown, Thing"), ("g", "c", "!"), ("g", "c", "")], "grp string, aspect string, term string")
    got = {r.term: r.lemmas for r in ph.lemma_terms(lexicon, tokens).collect()}
    assert got == {"Яркие экраны": ["яркий", "экран"], "экраны": ["экран"], "unknown, Thing": ["unknown", "thing"]}
    own = spark.createDataFrame([("экраны", "дисплей")], "word string, lemma string")
    assert {r.term: r.lemmas for r in ph.lemma_terms(lexicon, tokens, own).collect()}["Яркие экраны"] == ["яркие", "дисплей"]


def test_inflected_phrases_are_mentioned_with_their_characteristics(spark):
    sentence = [("Мне", "я", "PRON", 1), ("понравились", "понравиться", "VERB", 1), ("новые", "новый", "ADJ", 4), ("цветные", "цветной", "ADJ", 4), ("экраны", "экран", "NOUN", 1),
                (",", "", "PUNCT", 1), ("цветной", "цветной", "ADJ", 7), ("экран", "экран", "NOUN", 1)]
    tokens = spark.createDataFrame([(1, 0, p, h, t, m, tag, "dep") for p, (t, m, tag, h) in enumerate(sentence)], SCHEMA)
    sents = spark.createDataFrame([(1, "c", "p", 5, 0, " ".join(w[0] for w in sentence))], "id long, category string, product string, rating int, spos int, sentence string")
    lexicon = spark.createDataFrame([("g", "display", "цветного экрана"), ("g", "sound", "звук")], "grp string, aspect string, term string")
    forms = spark.createDataFrame([("цветного", "цветной"), ("экрана", "экран")], "word string, lemma string")
    rows = asp.mentions(sents, lexicon, tokens, lemmas=forms).collect()
    assert [(r.aspect, r.term, r.sentiment) for r in rows] == [("display", "цветного экрана", "positive")]
    assert rows[0].characteristics == ["новый", "понравиться", "цветной"]
    assert asp.mentions(sents, lexicon.where(F.lit(False)), tokens).count() == 0
