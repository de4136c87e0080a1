"""Sessions of activity parted by idleness (problem 4).

Secondary sort by source and time through one range exchange, then one linear
scan a partition that emits sessions with constant memory. A source spread over
several partitions leaves one open end at each partition's edge; these are
stitched from a table of at most two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.columns import epoch_us, finite, source_id
from netquarry.operators.scan import changes, partition_id, range_sorted, running_max
from netquarry.session import cut, shuffle_partitions

_LOCAL = "pid int, first_key boolean, last_key boolean, src_ip string, start_us long, end_us long, flow_count long"


def sessions(flows: DataFrame, gap_s: float = 1800, partitions: int | None = None) -> DataFrame:
    """Sessions (src_ip, start_us, end_us, flow_count) of flows(_flow_id, src_ip, ts_start, flow_duration_ms).

    Flows without source or start do not count. Repeats of a _flow_id count once
    (they agree in source and start); rows without _flow_id count each. A null,
    NaN or negative duration is 0. A flow opens a session if it starts more than
    gap_s after the latest end of all earlier flows of its source. Other columns
    are ignored; an empty table has no sessions.
    """
    partitions = partitions or shuffle_partitions(flows.sparkSession)
    rows = flows.select(
        source_id(F.col("src_ip")).alias("src_ip"),
        epoch_us(F.col("ts_start")).alias("start_us"),
        F.col("_flow_id").alias("flow"),
        F.greatest(F.coalesce(F.round(finite(F.col("flow_duration_ms")) * 1000).cast("long"), F.lit(0)), F.lit(0)).alias("lasts_us"),
    ).where("src_ip is not null and start_us is not null")
    gap_us = round(gap_s * 1_000_000)
    local = cut(range_sorted(rows, partitions, "src_ip", "start_us", "flow").mapInArrow(lambda batches: scan(batches, gap_us), _LOCAL))
    return stitch(local, gap_us)


def scan(batches: Iterator[pa.RecordBatch], gap_us: int) -> Iterator[pa.RecordBatch]:
    """Sessions of one sorted partition; carries one open session from batch to batch."""
    pid = partition_id()
    src = flow = None  # of the row above
    first = None
    start = end = count = 0
    held: list[tuple] = []  # closed sessions of the current key: whether it is the last key shows later
    out = _Out(pid)

    for b in batches:
        if not b.num_rows:
            continue
        names, starts, lasts = b.column(0), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
        no_id = b.column(2).is_null().to_numpy(zero_copy_only=False)
        flows = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        new = changes(names, src)
        same = np.zeros(len(starts), bool)
        same[1:] = ~new[1:] & (starts[1:] == starts[:-1]) & (flows[1:] == flows[:-1]) & ~no_id[1:] & ~no_id[:-1]
        if not new[0] and flow is not None:
            same[0] = not no_id[0] and flow == (starts[0], flows[0])
        keep = np.flatnonzero(~same)
        flow, above = (starts[-1], None if no_id[-1] else flows[-1]), src
        src = names[len(starts) - 1].as_py()
        if not len(keep):
            continue
        new, starts, ends = new[keep], starts[keep], starts[keep] + lasts[keep]
        names = names.take(pa.array(keep))
        group = np.cumsum(new) - (1 if new[0] else 0)
        if not new[0]:  # the open session goes on being the latest end
            ends = ends.copy()
            ends[0] = max(ends[0], end)
            own_end0 = int(starts[0] + lasts[keep][0])
        latest = running_max(ends, group)
        opens = new.copy()
        opens[1:] |= starts[1:] > latest[:-1] + gap_us
        if not new[0] and starts[0] > end + gap_us:
            opens[0] = True
            ends[0] = own_end0
            latest = running_max(ends, group)
            opens[1:] = new[1:] | (starts[1:] > latest[:-1] + gap_us)
        heads = np.flatnonzero(opens)
        bounds = np.append(heads, len(starts))
        lead = int(bounds[0])
        if lead:
            end, count = max(end, int(latest[lead - 1])), count + lead
        if len(heads):
            if above is not None:
                out.add(above, start, end, count, above == first)
            tails = bounds[1:] - 1
            key_at = names.take(pa.array(heads[:-1])).to_pylist()
            for k, (s, e, n) in zip(key_at, zip(starts[heads[:-1]].tolist(), latest[tails[:-1]].tolist(), np.diff(bounds)[:-1].tolist())):
                first = k if first is None else first
                out.add(k, s, e, n, k == first)
            start, end, count = int(starts[heads[-1]]), int(latest[-1]), int(len(starts) - heads[-1])
            if first is None:
                first = src
        yield from out.full()
    if src is not None:
        out.add(src, start, end, count, src == first)
    yield from out.rest()


class _Out:
    """Rows on their way out. Sessions of the newest key wait, in bounded pieces, until it is known whether that key is the partition's last."""

    def __init__(self, pid: int, piece: int = 50_000):
        self.pid, self.piece, self.rows = pid, piece, []

    def add(self, *row) -> None:
        self.rows.append(row)

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.rows) < self.piece:
            return
        newest = self.rows[-1][0]
        n = len(self.rows)
        while n and self.rows[n - 1][0] == newest:
            n -= 1
        if n:
            yield self._batch(self.rows[:n], None)
            self.rows = self.rows[n:]
        elif len(self.rows) >= 4 * self.piece:  # one key fills the piece: treating it as an edge key is always right
            yield self._batch(self.rows, newest)
            self.rows = []

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self._batch(self.rows, self.rows[-1][0])

    def _batch(self, rows: list[tuple], last: str | None) -> pa.RecordBatch:
        k, s, e, n, f = zip(*rows)
        return pa.RecordBatch.from_pydict({
            "pid": pa.array([self.pid] * len(rows), pa.int32()), "first_key": pa.array(f, pa.bool_()), "last_key": pa.array([x == last for x in k], pa.bool_()),
            "src_ip": pa.array(k, pa.string()), "start_us": pa.array(s, pa.int64()), "end_us": pa.array(e, pa.int64()), "flow_count": pa.array(n, pa.int64()),
        })


def stitch(local: DataFrame, gap_us: int) -> DataFrame:
    """Joins the ends that partition edges cut. Only keys at an edge are looked at again."""
    out = ["src_ip", "start_us", "end_us", "flow_count"]
    inner = local.where("not first_key and not last_key").select(out)
    edge = local.where("first_key or last_key")
    before = Window.partitionBy("src_ip").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.groupBy("src_ip", "pid").agg(F.max("end_us").alias("m")).select("src_ip", "pid", F.max("m").over(before).alias("carry"))
    told = edge.join(carry, ["src_ip", "pid"]).withColumn("goes_on", F.coalesce(F.col("start_us") <= F.col("carry") + gap_us, F.lit(False)))
    anchor = told.groupBy("src_ip", "pid").agg(F.max(F.when(~F.col("goes_on"), F.col("start_us"))).alias("a")).select("src_ip", "pid", F.max("a").over(before).alias("anchor"))
    merged = (
        told.join(anchor, ["src_ip", "pid"])
        .groupBy("src_ip", F.when(F.col("goes_on"), F.col("anchor")).otherwise(F.col("start_us")).alias("opened"))
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("flow_count").alias("flow_count"))
        .select(out)
    )
    return inner.unionByName(merged)
