"""Vector columns as packed doubles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, key: str, vec: str, change: Callable[[np.ndarray], np.ndarray] | None = None, zero: bool = True) -> DataFrame:
    """(key long, v binary): one row for every key whose vector has no null and no
    non-finite component (nor is zero, if ``zero`` is false), as doubles, after ``change``.

    Vectors of another length than most (ties: the shorter) and null keys are left out.
    A repeated key counts once, with the smallest vector by bytes.
    """
    sized = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n"))
    top = sized.orderBy(F.desc("n"), "d").first()
    dim = top.d if top else 0
    rows = df.where(F.col(key).isNotNull() & (F.size(vec) == dim)).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("v"))
    out = pa.schema([("key", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)  # nulls become nan
            x = x if change is None else change(x)
            ok = np.isfinite(x).all(axis=1)
            if not zero:
                ok &= (x != 0).any(axis=1)
            keys = b.column(0).to_numpy(zero_copy_only=False)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([r.tobytes() for r in x[ok]], pa.binary())], schema=out)

    return rows.mapInArrow(run, "key long, v binary").groupBy("key").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """Packed vectors as the rows of a matrix."""
    values = list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))
