"""A user's own aggregates of groups, with partial states before the shuffle.

A reducer tells how a state starts, takes in a batch of values, merges with another, and gives its
result. Each task keeps a state for each key that it meets and hands the states on when
there are too many. A hot key has one state for each task, so it never has its rows in one task.

With few keys only states are shuffled. With so many that a batch has few rows of each, states would be
nearly as many as rows; then rows are first sorted by key over ranges, so that a key's values come together. Ranges are cut
within a key too, by a random number.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from attestra.functions.codes import codes_of
from attestra.functions.hot import tasks_for

#: States that a task keeps at once; keys from which on rows are sorted first.
STATES, MANY = 50_000, 500


@dataclass(frozen=True)
class Reducer:
    """start() gives a state, add(state, values) and merge(state, state) the next one, finish(state) the result or None.

    values is a numpy array of known values; result is the SQL type of the result. States must be picklable, and merge must
    not mind the order.
    """

    start: Callable[[], Any]
    add: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    result: str = "double"


def reduce_by(df: DataFrame, keys: Sequence[str], value: str, reducer: Reducer, out: str = "value", states: int = STATES) -> DataFrame:
    """(keys, out): the reducer's result over the known values of each key; keys without any have that of the start. Missing keys match."""
    keys = list(keys)
    parts = [f"_k{i}" for i in range(len(keys))]
    flat = df.select(*[F.col(f"`{k}`").alias(p) for k, p in zip(keys, parts)], F.col(f"`{value}`").alias("v"))
    found = flat.agg(F.approx_count_distinct(F.xxhash64(*parts))).first()[0] if keys else 0
    if found > MANY:
        flat = flat.withColumn("_r", F.rand(0)).repartitionByRange(tasks_for(df), *parts, "_r").sortWithinPartitions(*parts)
    rows = flat.select(F.struct(*[F.col(p).alias(k) for k, p in zip(keys, parts)]).alias("k"), "v")
    kind = rows.schema["k"].dataType.simpleString()

    def partial(batches):
        held_states: dict[tuple, Any] = {}
        held: pa.Array | None = None

        def told() -> pa.RecordBatch:
            names = pa.array([dict(zip(keys, k)) for k in held_states], held.type)
            return pa.RecordBatch.from_arrays([names, pa.array([pickle.dumps(s) for s in held_states.values()], pa.binary())], ["k", "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(0)
            codes = np.zeros(batch.num_rows, np.int64)
            for i in range(len(keys)):
                own = codes_of(held.field(i))
                codes = np.unique(codes * (int(own.max()) + 1) + own, return_inverse=True)[1]
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)
            first = held.take(pa.array([at[0] for at in groups]))
            for k, at in zip(zip(*[first.field(i).to_pylist() for i in range(len(keys))]), groups):
                state = held_states[k] if k in held_states else reducer.start()
                some = at[known[at]]
                held_states[k] = reducer.add(state, values[some]) if len(some) else state
            if len(held_states) > states:
                yield told()
                held_states = {}
        if held_states:
            yield told()

    def merged(table: pa.Table) -> pa.Table:
        found = [pickle.loads(x.as_py()) for x in table.column("state")]
        whole = found[0]
        for s in found[1:]:
            whole = reducer.merge(whole, s)
        first = table.column("k").combine_chunks().slice(0, 1)
        return pa.Table.from_arrays([first, pa.array([pickle.dumps(whole)], pa.binary())], ["k", "state"])

    def finish(batches):
        for batch in batches:
            results = [reducer.finish(pickle.loads(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, arrow)], ["k", "r"])

    arrow = to_arrow_type(DataType.fromDDL(reducer.result))
    # A number of its own: states are small, and few bytes would be dealt to one task.
    states_ = rows.mapInArrow(partial, f"k {kind}, state binary").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    met = states_.groupBy("k").applyInArrow(merged, f"k {kind}, state binary")
    return met.mapInArrow(finish, f"k {kind}, r {reducer.result}").select(*[F.col(f"k.`{k}`").alias(k) for k in keys], F.col("r").alias(out))
