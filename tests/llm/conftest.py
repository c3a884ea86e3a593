import datetime

import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, day date"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns, some of which clash with names that operators make."""

    def make(rows):
        full = [(k, t, "en", "s", None if t is None else len(t), 1.5, "x", datetime.date(2024, 1, 2)) for k, t in rows]
        return spark.createDataFrame(full, WIDE)

    return make


EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "word"), (6, "long passage " * 4000), (7, "ñandú ☃ 日本語 \U0001f642"), (None, "no key here"), (9, "the same words again and again " * 9),
        (10, "the same words again and again " * 9)]
