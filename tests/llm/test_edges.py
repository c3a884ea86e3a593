"""Empty tables, long texts, repeated rows and clashing columns through the row-wise operators."""

import public_tokenizers
import pytest

from opinara.llm import bpe, langid, licences, packing, secrets
from tests.llm.conftest import EDGE

LONG = "some words, numbers 12345 and a token = abcdefgh12345678 again and again\n" * 30_000  # 2 MB
ONE = "x" * 1_000_000


@pytest.fixture(scope="module")
def model():
    words = {"en": b"the house and the river ", "de": b"das haus und der fluss "}
    return langid.train([w * 4 for w in words.values()] * 20, list(words) * 20, steps=5, batch=8)


OPERATORS = {
    "bpe": lambda d, m: bpe.digests(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "langid": lambda d, m: langid.identify(d, m),
    "licences": lambda d, m: licences.recognise(d),
    "secrets": lambda d, m: secrets.find_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_in_are_rows_out(spark, make_docs, model, name):
    run = OPERATORS[name]
    docs = make_docs([*EDGE, (4, "word"), (4, "word"), (20, LONG), (21, LONG), (22, ONE)])
    out = run(docs, model)
    rows = out.drop("text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    new = [c for c in out.columns if c not in ("doc_id", "text", "n_chars")]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append([r[c] for c in new])
    assert by[4][0] == by[4][1] == by[4][2] == by[5][0] and by[20] == by[21]
    none = run(docs.limit(0), model)
    assert none.count() == 0 and none.columns == out.columns


def test_packing_of_long_texts_and_no_rows(spark, make_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = make_docs([*EDGE, (20, LONG), (22, ONE), (4, "word")])
    rows = packing.pack_documents(docs, path, with_ids=False).collect()
    total = {}
    for r in rows:
        total.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert all(sum(v) % n == 0 for (_, n), v in total.items()) and len({k for k, _ in total}) == len({k for k, _ in [*EDGE, (20, 0), (22, 0)]})
    assert packing.pack_documents(docs.limit(0), path).count() == 0
