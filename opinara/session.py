"""Session set-up and lineage cutting.

Iterative jobs cut their plan with a written table.  The folder is the one
the cluster names in ``spark.checkpoint.dir``; only a local session without that
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: list[tempfile.TemporaryDirectory] = []  # of local sessions, deleted when the process ends


def local_session(cores: int | str = "*", name: str = "opinara", conf: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=conf or {})
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _FOLDERS.append(tempfile.TemporaryDirectory(prefix="opinara-ckpt-", ignore_cleanup_errors=True))
        folder = _FOLDERS[-1].name
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and go on from the written rows.

    A table has the size of its files.  A checkpoint keeps the size estimated for its plan;
    in a loop of joins that estimate is multiplied with itself in every round, until
    planning takes longer than the work.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    Text work costs far more than reading, so a small file must not keep it on one
    core; an input with enough splits, as any large one, is passed on unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def many_tasks(df: DataFrame) -> int:
    """Tasks for work whose cost does not show in its bytes: some for every core, and never
    fewer than the session's shuffle partitions."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
