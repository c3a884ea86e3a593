"""Every query with an oracle against DuckDB on the small tables (needs them)."""

import os

import pytest

from opinara.plans import load_registry
from tests.compare import check, duck

FOLDER = "/root/testdata/sf0.001"
SLOW = ("c4", "c5", "i1")
NAMES = [n for n, q in load_registry().items() if q.sql and n.split("_")[0] not in SLOW]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    status, detail, _, _ = check(spark, con, FOLDER, name, load_registry()[name])
    assert status in ("ok", "TYPE"), detail
