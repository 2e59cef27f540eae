"""Running sums, places and predecessors along a key's order without one task for a key.

Rows are dealt by ranges of (key, order) that hold about equally many rows, so a hot key spreads over many tasks; they are
sorted, passed over once in Arrow batches and written. A range's first key may go on from the range before: what it takes over
(a total and a value) is one row for each range, summed up on the driver, which gets a row for each task and no more.
Keys may be null; null orders come first, and rows of equal order stand in any order among themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.plans.materialize import materialize

#: What a row adds to its key's total: of its value, the value of the row before, and whether it is the key's first row.
Increment = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _own(now: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    return now


def _new_key(keys: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Where another key begins; last is an array of the key before, if there is one."""
    joined = pa.concat_arrays([last if last is not None else keys.slice(0, 1), keys])
    a, b = joined.slice(0, len(keys)), joined.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    new = ~same.to_numpy(zero_copy_only=False)
    if last is None:
        new[0] = True
    return new


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(column.type.to_pandas_dtype())


def scan(rows: DataFrame, key: str, order: str, value: Column, total: str | None = None, increment: Increment = _own, previous: str | None = None) -> DataFrame:
    """rows with `total`, the sum of the increments of the key's rows up to each one, and `previous`, the value in the row before, null in a key's first row.

    For totals the value must be a number that is never null; a previous value may be of any type. Sums are 64-bit integers.
    """
    own = rows.withColumns({"_rng_value": value, "_rng_tie": F.monotonically_increasing_id()})
    own = own.repartitionByRange(key, order, "_rng_tie").sortWithinPartitions(key, order, "_rng_tie").drop("_rng_tie")
    kind = own.schema["_rng_value"].dataType
    fields = [T.StructField("_rng_part", T.IntegerType()), T.StructField("_rng_at", T.LongType()), T.StructField("_rng_head", T.BooleanType())]
    fields += [T.StructField("_rng_total", T.LongType())] if total else []
    fields += [T.StructField("_rng_before", kind)] if previous else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, sum_, head = TaskContext.get().partitionId(), 0, 0, True
        last_key = last_value = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, values = batch[key], batch["_rng_value"]
            first = _new_key(keys, last_key)
            starts = np.flatnonzero(first[1:]) + 1 if not at else np.flatnonzero(first)
            heads = np.zeros(n, bool)
            heads[: (starts[0] if len(starts) else n)] = head
            head = head and not len(starts)
            before = pa.concat_arrays([last_value if last_value is not None else values.slice(0, 1), values])
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(heads)]
            if total:
                now = _numbers(before)
                adds = increment(now[1:], now[:-1], first).astype(np.int64)
                run_ = np.cumsum(adds)
                began = np.maximum.accumulate(np.where(first, np.arange(n), 0))
                carried = np.where(np.maximum.accumulate(first), 0, sum_)
                run_ = run_ - np.where(np.maximum.accumulate(first), run_[began] - adds[began], 0) + carried
                sum_ = int(run_[-1])
                columns.append(pa.array(run_))
            if previous:
                columns.append(before.take(pa.array(np.arange(n), mask=first)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in fields)])
            at += n
            last_key, last_value = keys.slice(n - 1), values.slice(n - 1)

    done = materialize(own.mapInArrow(run, T.StructType([*own.schema.fields, *fields])), "ranges")
    ends = done.groupBy("_rng_part").agg(
        F.min_by(F.struct(F.col(key).alias("k"), F.col("_rng_value").alias("v"), F.col("_rng_total" if total else "_rng_at").alias("t")), "_rng_at").alias("first"),
        F.max_by(F.struct(F.col(key).alias("k"), F.col("_rng_value").alias("v"), F.col("_rng_total" if total else "_rng_at").alias("t")), "_rng_at").alias("last"),
        F.bool_and("_rng_head").alias("single"),
    )
    carries, before = [], None
    for e in sorted(ends.collect(), key=lambda e: e["_rng_part"]):  # a row for each task
        carry = 0
        goes_on = before is not None and before["last"]["k"] == e["first"]["k"]
        if goes_on:
            if total:
                pair = np.array([e["first"]["v"], before["last"]["v"]])
                real = int(increment(pair[:1], pair[1:], np.array([False]))[0])
                carry = held + real - e["first"]["t"]
            carries.append((e["_rng_part"], carry, before["last"]["v"]))
        held = e["last"]["t"] + (carry if e["single"] else 0)
        before = e
    schema = T.StructType([T.StructField("_rng_part", T.IntegerType()), T.StructField("_rng_carry", T.LongType()), T.StructField("_rng_last", kind)])
    out = done.join(F.broadcast(rows.sparkSession.createDataFrame(carries, schema)), "_rng_part", "left")
    if total:
        out = out.withColumn(total, F.col("_rng_total") + F.when(F.col("_rng_head"), F.coalesce("_rng_carry", F.lit(0))).otherwise(0))
    if previous:
        out = out.withColumn(previous, F.when((F.col("_rng_at") == 0) & F.col("_rng_carry").isNotNull(), F.col("_rng_last")).otherwise(F.col("_rng_before")))
    return out.drop("_rng_value", "_rng_carry", "_rng_last", *(f.name for f in fields))


def running_sum(rows: DataFrame, key: str, order: str, value: Column, out: str) -> DataFrame:
    """rows with the sum of a value over the rows of the key up to each row, itself included; nulls count as 0."""
    return scan(rows, key, order, F.coalesce(value, F.lit(0)).cast("bigint"), out)


def numbered(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """rows with their place, from 0, in the order within each key."""
    return scan(rows, key, order, F.lit(1).cast("bigint"), out).withColumn(out, F.col(out) - 1)


def with_previous(rows: DataFrame, key: str, order: str, column: str, out: str) -> DataFrame:
    """rows with the column's value in the row before of the key, null in its first row."""
    return scan(rows, key, order, F.col(column), previous=out)


def changes(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The rows whose columns differ from those of the row before of their key, and each key's first row; nulls are equal."""
    said = scan(rows.withColumn("_rng_said", F.struct(*columns)), key, order, F.struct(F.lit(True).alias("there"), *columns), previous="_rng_old")
    return said.where(~F.struct(F.lit(True).alias("there"), *columns).eqNullSafe(F.col("_rng_old"))).drop("_rng_said", "_rng_old")
