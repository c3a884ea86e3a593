"""The package's front door."""

import opinara
from opinara import cli
from opinara.plans.fixtures import Tables


def test_names_are_found():
    assert all(callable(getattr(opinara, n)) for n in opinara.__all__)


def test_command_rolls_aspects_up(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    paths = {}
    for name in ("reviews", "lexicon", "tokens"):
        paths[name] = str(tmp_path / name)
        getattr(t, name).write.parquet(paths[name])
    cli.main([paths["reviews"], paths["lexicon"], paths["tokens"], str(tmp_path / "out"), "--category", "en"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.category for r in got.select("category").distinct().collect()} == {"en"}
