"""analyze-reviews REVIEWS LEXICON TOKENS OUT: roll aspects up from Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from opinara.operators import aspects


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="analyze-reviews", description=__doc__)
    for name, what in (("reviews", "reviews to analyse"), ("lexicon", "grp, aspect, term"), ("tokens", "annotated tokens"), ("out", "where the roll-up goes")):
        p.add_argument(name, help=what)
    p.add_argument("--category", action="append", help="only these categories")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("analyze-reviews").getOrCreate()
    read = spark.read.parquet
    aspects.analyse(read(a.reviews), read(a.lexicon), read(a.tokens), categories=a.category).write.mode("overwrite").parquet(a.out)
