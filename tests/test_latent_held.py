"""Groups with many terms and many texts, in one task and across tasks."""

import pytest

from opinara.operators import latent as lt
from tests.test_latent import brute, corpus


@pytest.mark.parametrize("held", [lt.HELD_ENTRIES, 0])
def test_a_large_group_needs_joins_only_where_its_matrix_has_many_entries(spark, monkeypatch, held):
    rows = [(g, k + 1000 * "abc".index(g), t) for g, k, t in corpus()]
    df = spark.createDataFrame(rows, "g string, id long, text string")
    if held:
        monkeypatch.setattr(lt, "_powered", None)
    monkeypatch.setattr(lt, "STEP_ENTRIES", 7)
    got = {(r.g, r.id): r["rank"] for r in lt.latent_ranks(lt.term_matrix(df, ["g"], "id", "text"), ["g"], "id", 2, small=0, rounds=16, **({} if held else {"held": 0})).collect()}
    assert got == pytest.approx(brute(rows, 2), abs=1e-3)
