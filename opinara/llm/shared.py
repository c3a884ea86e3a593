"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage is cut
    and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once its readers have ended."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(key, n: int):
    """crc32 of a key's decimal text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n
