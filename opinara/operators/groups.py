"""A user's own function over groups of any size.

The function is given as four steps, so that no task ever needs a whole group: ``init``
makes an empty state, ``update`` adds some rows of the group to it, ``merge`` puts two
states together, and ``finish`` turns the last state into rows.  Rows are dealt to tasks in order
of their keys, so a task meets the rows of a group one after another and a small group has
one state; a hot group is cut between tasks, and its states, one a task, are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

HELD = 10_000  # groups whose states a task holds before it hands them on
FAN = 64  # parts whose states are merged first where a hot group has left many


@dataclass(frozen=True)
class Fold:
    """The steps of a group function.  ``update`` and ``merge`` may change and return their
    first argument; the order of rows and of states is not fixed.  States are pickled."""

    init: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], pd.DataFrame]


def fold_groups(df: DataFrame, keys: list[str], fold: Fold, schema: str, held: int = HELD, fan: int = FAN) -> DataFrame:
    """keys and the columns of ``schema``: what ``fold`` makes of every group.

    Null keys are a group like any other.  A task holds the states of at most ``held``
    groups and the rows of one batch."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    columns = [c for c in df.columns if c not in keys]

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}

        def rows():
            return pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "_state"])

        for f in frames:
            for key, part in f.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                states[key] = fold.update(states[key] if key in states else fold.init(), part[columns])
            if len(states) > held:
                yield rows()
                states.clear()
        if states:
            yield rows()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Any]]:
        """The merged state of each group; rows of a group follow one another."""
        last, state, any_row = None, None, False
        for batch in batches:
            told = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for key, raw in zip(told, batch.column("_state").to_pylist()):
                if any_row and key == last:
                    state = fold.merge(state, pickle.loads(raw))
                    continue
                if any_row:
                    yield last, state
                last, state, any_row = key, pickle.loads(raw), True
        if any_row:
            yield last, state

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = runs(batches)
        while part := list(islice(found, 1000)):
            told = [pa.array([k[i] for k, _ in part], key_types[i]) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*told, pa.array([pickle.dumps(s) for _, s in part], pa.binary())], [*keys, "_state"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = runs(batches)
        while part := list(islice(found, 1000)):
            outs = [fold.finish(s) for _, s in part]
            size = [len(o) for o in outs]
            if not sum(size):
                continue
            told = [pa.array(np.repeat(np.arange(len(part)), size)) for _ in keys]
            told = [pa.array([k[i] for k, _ in part], key_types[i]).take(at) for i, at in enumerate(told)]
            rest = pd.concat([o for o in outs if len(o)], ignore_index=True)
            made = [pa.array(rest[f.name], f.type, from_pandas=True) for f in out_types]
            yield pa.RecordBatch.from_arrays([*told, *made], [*keys, *(f.name for f in out_types)])

    key_types = [to_arrow_type(df.schema[k].dataType) for k in keys]
    out_types = list(to_arrow_schema(T.StructType.fromDDL(schema)))
    parts = max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the row's number parts a hot group between tasks; without it all equal keys meet in one
    at = F.monotonically_increasing_id()
    rows = df.withColumn("_at", at).repartitionByRange(parts, *keys, "_at").sortWithinPartitions(*keys).drop("_at")
    states = rows.mapInPandas(update, f"{kinds}, _state binary").withColumn("_part", F.pmod(F.xxhash64("_state"), F.lit(fan)))
    few = states.repartition(*keys, "_part").sortWithinPartitions(*keys).drop("_part").mapInArrow(some, f"{kinds}, _state binary")
    return few.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, f"{kinds}, {schema}")
