"""Helpers for linear scans over range-partitioned, sorted rows.

A table range-partitioned by (key, order...) and sorted within partitions splits
a heavy key over several neighbouring partitions. A scan sees one partition;
what it cannot know is what came before its first key. That is at most one key
per partition, so the missing state is a table of a few rows a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def range_sorted(df: DataFrame, partitions: int, *order: str) -> DataFrame:
    return df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def changes(column: pa.Array, before: str | None) -> np.ndarray:
    """True where a sorted string column differs from the row above it; `before` is the value above the first row."""
    codes = column.dictionary_encode()
    idx = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new = np.empty(len(idx), bool)
    new[1:] = idx[1:] != idx[:-1]
    if len(idx):
        new[0] = before is None or column[0].as_py() != before
    return new


def running_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running maximum of values within ascending group numbers, without overflow: by rank."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    top = np.maximum.accumulate(rank + group * len(values)) - group * len(values)
    return values[order[top]]


def numbered(df: DataFrame, key: str | None, order: list[str], partitions: int, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with `_pos`, the 0-based place of each row within its key (or in the whole table) by `order`, and for each column of `sums` its running sum `_sum_<column>` up to and with the row (nulls count 0).

    One range exchange over (key, order); a linear scan counts within each
    partition. Only the first key of a partition can have begun before it, so one
    row a partition, broadcast, tells what the partitions before hold. A heavy key
    spreads over many partitions. `order` should be total within the key, else
    ties get any order.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from netquarry.session import cut

    by = ([key] if key else []) + order
    added = [T.StructField("_pid", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_k", T.LongType())]
    schema = T.StructType([*df.schema.fields, *added, *[T.StructField(f"_in_{c}", T.DoubleType()) for c in sums]])
    where = df.columns.index(key) if key else None
    summed = [df.columns.index(c) for c in sums]

    def count(batches):
        pid, at, row, name, begun, held = partition_id(), 0, 0, None, False, np.zeros(len(summed))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            idx = np.arange(n)
            new = np.zeros(n, bool)
            if where is not None:
                new = changes(b.column(where), name if begun else None)
                if begun and b.column(where)[0].as_py() == name:
                    new[0] = False
                name, begun = b.column(where)[n - 1].as_py(), True
            head = np.maximum.accumulate(np.where(new, idx, -1))
            k = np.where(head >= 0, idx - head, idx + at)
            at = int(k[-1]) + 1
            more = []
            for i, c in enumerate(summed):
                v = np.nan_to_num(b.column(c).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False))
                upto = np.cumsum(v)
                base = np.where(head > 0, upto[head - 1], 0.0)
                run = upto - base + np.where(head >= 0, 0.0, held[i])
                held[i] = run[-1]
                more.append(pa.array(run))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * n, pa.int32()), pa.array(idx + row), pa.array(k, pa.int64()), *more], names=schema.names)
            row += n

    rows = cut(range_sorted(df, partitions, *by).mapInArrow(count, schema))
    key_of = (F.col(key) if key else F.lit(0)).alias("key")
    last = F.struct(key_of, (F.col("_k") + 1).alias("n"), *[F.col(f"_in_{c}").alias(f"of_{c}") for c in sums])
    edges = rows.groupBy("_pid").agg(F.min_by(F.struct(key_of), "_row").alias("first"), F.max_by(last, "_row").alias("last"))
    ends = edges.select(F.col("_pid").alias("_q"), "last.*")
    begins = edges.select(F.col("_pid").alias("_p"), F.col("first.key").alias("_key"))
    # One row for each partition whose first key ends a partition before it.
    met = begins.join(F.broadcast(ends), F.col("_key").eqNullSafe(F.col("key")) & (F.col("_q") < F.col("_p")))
    offset = met.groupBy("_p", "_key").agg(F.sum("n").alias("_before"), *[F.sum(f"of_{c}").alias(f"_before_{c}") for c in sums])
    match = F.col("_pid") == F.col("_p")
    if key:
        match = match & F.col(key).eqNullSafe(F.col("_key"))
    added = lambda mine, before, none: F.col(mine) + F.coalesce(F.col(before), F.lit(none))
    placed = rows.join(F.broadcast(offset), match, "left")
    return placed.select(*df.columns, added("_k", "_before", 0).alias("_pos"), *[added(f"_in_{c}", f"_before_{c}", 0.0).alias(f"_sum_{c}") for c in sums])
