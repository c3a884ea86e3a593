"""Column choice, aggregation, windows and exact quantiles on plain tables."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

BINS = 4096


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def abbreviate(name: str) -> str:
    """First letters of the parts; parts with s or n in front keep three."""
    return re.sub(r"(?:^|_)(?:([sn][^_]{0,2})|([^_]?))[^_]*", r"\1\2", name)


def rename_abbreviated(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: abbreviate(c) for c in columns})


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, name, value)


def column_stats(df: DataFrame, columns: list[str], **aggs) -> DataFrame:
    """One scan: name and one column per aggregate function in ``aggs``."""
    rows = [F.struct(F.lit(c).alias("name"), *[fn(F.col(c)).alias(a) for a, fn in aggs.items()]) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def zero_one_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = column_stats(df, columns, lo=lambda c: F.min(c).cast("double"), hi=lambda c: F.max(c).cast("double"))
    return stats.where("lo = 0 and hi = 1").select("name")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def element_counts(df: DataFrame, array: Column, name: str = "item") -> DataFrame:
    return value_counts(df.select(F.explode(array).alias(name)), name)


def map_totals(df: DataFrame, scores: Column) -> DataFrame:
    return df.select(F.explode(scores).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, sep: str, part_rows: int | None = None,
                 name: str = "joined") -> DataFrame:
    """Texts of a group joined in the order of ``order``.

    With ``part_rows`` a group of any size comes as several rows: ``part`` is
    ``order div part_rows`` and the parts in order make the whole text, so no task
    holds a whole hot group.
    """
    by = [*keys]
    if part_rows:
        df = df.withColumn("part", F.floor(F.col(order) / part_rows).cast("long"))
        by.append("part")
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    grouped = df.groupBy(*by).agg(pairs.alias("p"), F.count("*").alias("n"))
    return grouped.select(*by, "n", F.array_join(F.transform("p", lambda x: x["t"]), sep).alias(name))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark keeps n rows per task before the shuffle."""
    rk = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rk", rk).where(F.col("rk") <= n)


def prefix_sum(df: DataFrame, key: str, value: str, name: str = "before", width: int = 65536, levels: int = 2) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key`` (a unique integer).

    Rows are summed inside buckets of ``width`` keys; the bucket totals, far fewer,
    are summed the same way and added, so no task orders the whole table.
    """
    if levels == 0:
        return df.withColumn(name, F.coalesce(F.sum(value).over(
            W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    b, inner, outer = f"_b{levels}", f"_in{levels}", f"_out{levels}"
    df = df.withColumn(b, F.floor(F.col(key) / width))
    totals = df.groupBy(b).agg(F.sum(value).alias(value))
    offsets = prefix_sum(totals, b, value, outer, width, levels - 1).select(b, outer)
    local = W.partitionBy(b).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    cum = df.withColumn(inner, F.coalesce(F.sum(value).over(local), F.lit(0)))
    return cum.join(offsets, b).withColumn(name, F.col(inner) + F.col(outer)).drop(b, inner, outer)


def batch_numbers(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Batch per row: the running size before the row divided by ``limit``."""
    summed = prefix_sum(df.withColumn("_size", size), key, "_size")
    return summed.withColumn("batch", F.floor(F.col("before") / limit)).drop("_size", "before")


def appearance_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values numbered from 0 by where they first appear."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first_at"))
    return prefix_sum(first.withColumn("_one", F.lit(1)), "first_at", "_one", "code").drop("_one")


# --- quantiles --------------------------------------------------------------------------


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """name, prob, value with linear interpolation, exact at any size.

    Equal values are counted first, the counts fall into 4,096 equal bins per
    column, and only the bins that hold a wanted rank are ordered.
    """
    counts = unpivot(df, [], columns).where(F.col("value").isNotNull()).groupBy("name", "value").agg(
        F.count("*").alias("n"))
    span = column_stats(df, columns, lo=lambda c: F.min(c).cast("double"), hi=lambda c: F.max(c).cast("double"),
                        total=F.count)
    width = F.col("hi") - F.col("lo")
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width * BINS), F.lit(BINS - 1)))
    binned = counts.join(span, "name").withColumn("bin", at.cast("int"))
    per_bin = binned.groupBy("name", "bin").agg(F.sum("n").alias("n"))
    run = W.partitionBy("name").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("bin_before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    exact = F.col("prob") * (F.col("total") - 1)
    wanted = (
        span.where("total > 0").select("name", "total", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .select("name", "prob", (exact - F.floor(exact)).alias("frac"),
                F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.floor(exact).alias("rank")),
                                  F.struct(F.lit("hi").alias("side"), F.ceil(exact).alias("rank")))).alias("t"))
        .select("name", "prob", "frac", "t.side", "t.rank")
    )
    hit = wanted.join(per_bin, "name").where(
        (F.col("rank") >= F.col("bin_before")) & (F.col("rank") < F.col("bin_before") + F.col("n"))
    ).select("name", "prob", "frac", "side", "rank", "bin", "bin_before")
    run_in = W.partitionBy("name", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    inside = binned.join(hit.select("name", "bin").distinct(), ["name", "bin"], "left_semi").select(
        "name", "bin", "value", "n", F.coalesce(F.sum("n").over(run_in), F.lit(0)).alias("before"))
    found = hit.join(inside, ["name", "bin"]).where(
        (F.col("rank") - F.col("bin_before") >= F.col("before"))
        & (F.col("rank") - F.col("bin_before") < F.col("before") + F.col("n")))
    ends = found.groupBy("name", "prob", "frac").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("a"),
        F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("b"))
    return ends.select("name", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("value"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, quartiles exact."""
    base = column_stats(df, columns, n=F.count, mean=F.avg, std=F.stddev_samp,
                        lo=lambda c: F.min(c).cast("double"), hi=lambda c: F.max(c).cast("double"))
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("name").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(a) for p, a in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    return base.join(q, "name", "left").select("name", "n", "mean", "std", "lo", "q1", "q2", "q3", "hi")


def right_closed_bin(c: Column, edges: list[Column]) -> Column:
    """Bin number from 0: (edge i, edge i+1], the lowest edge included."""
    out = F.when(c < edges[0], F.lit(None))
    for i, e in enumerate(edges[1:]):
        out = out.when(c <= e, F.lit(i))
    return out


# --- scaling, indicators, correlation ------------------------------------------------------


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to 0..1, a constant column to 0."""
    return _scaled(df, columns, F.min, lambda c: F.max(c) - F.min(c))


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation, a constant column to 0."""
    return _scaled(df, columns, F.avg, F.stddev_pop)


def _scaled(df: DataFrame, columns: list[str], centre, spread) -> DataFrame:
    stats = df.agg(F.struct(*[centre(c).alias(f"c_{c}") for c in columns],
                            *[spread(c).alias(f"s_{c}") for c in columns]).alias("st"))
    one = df.withColumn("_st", stats.scalar())
    out = {c: F.when(F.col(f"_st.s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_st.c_{c}")) / F.col(f"_st.s_{c}"))
           for c in columns}
    return one.withColumns(out).drop("_st")


def one_hot(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """0/1 columns ``<column>_<value>`` in place of ``column``; the distinct values
    are counted first and more than ``limit`` is refused rather than cut."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values; use pyspark.ml.feature.OneHotEncoder")
    return df.select(*[c for c in df.columns if c != column],
                     *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in sorted(values)])


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One pass over the data for all pairs: a, b, r."""
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("x")).select("x.*")


def top_correlations(df: DataFrame, columns: list[str], n: int = 50) -> DataFrame:
    """Pairs by absolute correlation; each pair once, exact 1 left out."""
    both = correlations(df, list(combinations(columns, 2)))
    return both.where(F.abs("r") != 1).orderBy(F.abs("r").desc(), "a", "b").limit(n)


def cluster_correlations(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """feature, cluster, r: correlation of every feature with every cluster's 0/1
    indicator, for any number of clusters: from the sums of each cluster and of all rows."""
    long = unpivot(df.withColumn("_cluster", F.col(cluster).cast("string")), ["_cluster"], features, "feature", "x").where("x IS NOT NULL")
    mean = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    per = long.where("_cluster IS NOT NULL").groupBy("feature", "_cluster").agg(F.count("*").alias("k"), F.avg("x").alias("m"))
    share = F.col("k") / F.col("n")
    r = F.try_divide((F.col("m") - F.col("mean")) * F.sqrt(share), F.col("sd") * F.sqrt(1 - share))
    return per.join(mean, "feature").select("feature", F.concat(F.lit(f"{cluster}_"), "_cluster").alias("cluster"), r.alias("r"))


def cluster_profile(df: DataFrame, features: list[str], cluster: str) -> tuple[DataFrame, DataFrame]:
    """Means per cluster, and per feature the spread of those means: sample
    deviation over mean, the divisor being 1 for 0/1 columns."""
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in features])
    flags = zero_one_columns(df, features).withColumn("flag", F.lit(True))
    spread = column_stats(means, features, std=F.stddev_samp, mean=F.avg).join(flags, "name", "left")
    ratio = F.when(F.col("flag"), F.col("std")).otherwise(F.try_divide("std", "mean"))
    return means, spread.select("name", ratio.alias("dispersion"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """node -> its root and the slash path from the root, by pointer doubling.

    ``nodes``: id, parent (null or itself for a root), name.  Each round doubles the
    distance a row has climbed, so log2(depth) joins are enough; a cycle, on which a
    row climbs further than there are rows, is an error.
    """
    from opinara.session import cut

    at_root = F.col("parent").isNull() | (F.col("parent") == F.col("id"))
    cur = nodes.select(
        "id", F.when(at_root, F.lit(None)).otherwise(F.col("parent")).alias("up"), F.col("name").alias("path"))
    climbed, rows = 1, nodes.count()
    while True:
        above = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        cur = cut(cur.join(above, "up", "left").select(
            "id", F.col("up2").alias("up"),
            F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", F.lit("/"), "path")).alias("path")))
        if cur.where(F.col("up").isNotNull()).isEmpty():
            return cur.select("id", "path")
        climbed *= 2
        if climbed > rows:
            raise ValueError("the parents hold a cycle")
