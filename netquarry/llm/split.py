"""Splitting of oversized units at natural boundaries (problem 2).

A unit's flows, in time order, are cut into atomic segments at its silences; the
segments are merged agglomeratively, weakest boundary first, while the piece and
its overlap fit the limit. Ordering and gaps come from one range exchange and a
linear scan, so a huge unit spreads over many partitions. Merging takes a unit's
list of segments as a whole, three numbers for each. Segments begin after silences,
so there is at most one for each silence of the unit's time span (with 60 s, half a
million a year, some 13 MB), however many flows it has. The flows are then cut by
the resulting places, in blocks.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.columns import epoch_us, source_id
from netquarry.operators.scan import changes, partition_id, range_sorted
from netquarry.session import cut, shuffle_partitions

LIMIT, OVERLAP, SILENCE_S = 80, 8, 60
#: Flows a cutting task sees at once, besides those around its ends; results do not depend on it.
BLOCK = 65_536


def oversized(units: DataFrame, flows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(unit, flow_id, start_us) of each unit whose flow_ids hold more than `limit` different ids.

    Null ids and ids without a flow with source and start drop out after the
    count. Rows may repeat, as units and flows do; a scan takes them once.
    """
    ids = F.array_distinct(F.filter("flow_ids", lambda x: x.isNotNull()))
    big = units.where("eval_unit_id is not null").select(F.col("eval_unit_id").alias("unit"), ids.alias("ids")).where(F.size("ids") > limit)
    listed = big.select("unit", F.explode("ids").alias("flow_id"))
    timed = flows.select(F.col("_flow_id").alias("flow_id"), epoch_us(F.col("ts_start")).alias("start_us"), source_id(F.col("src_ip")).alias("s")).where("s is not null and start_us is not null").drop("s")
    return listed.join(timed, "flow_id").select("unit", "flow_id", "start_us")


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted (unit, start_us, flow_id) batches without repeats: names, new-unit marks, gaps to the row above (-1 unknown), starts, ids."""
    unit, start, flow = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        names, starts, flows = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        new = changes(names, unit)
        above_s, above_f = np.empty_like(starts), np.empty_like(flows)
        above_s[1:], above_f[1:] = starts[:-1], flows[:-1]
        above_s[0], above_f[0] = start, flow
        keep = np.flatnonzero(new | (starts != above_s) | (flows != above_f))
        unit, start, flow = names[len(starts) - 1].as_py(), starts[-1], flows[-1]
        if len(keep):
            gap = np.where(new, -1, starts - above_s)[keep]
            yield names.take(pa.array(keep)), new[keep], gap, starts[keep], flows[keep]


_EDGE = "unit string, pid int, role int, k long, gap long, flow_id long, start_us long"
START, HEAD, TAIL = 0, 1, 2


def _boundaries(batches: Iterator[pa.RecordBatch], silence_us: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition that begin a segment (START), its first row of each unit (HEAD) and its last (TAIL), with their places k among its rows of the unit."""
    pid, last, at = partition_id(), None, 0

    def rows(unit, role, k, gap, flow, start) -> pa.RecordBatch:
        n = len(flow)
        unit = unit if isinstance(unit, pa.Array) else pa.array(unit, pa.string())
        arrays = [unit, pa.array([pid] * n, pa.int32()), pa.array([role] * n, pa.int32()), *(pa.array(x, pa.int64()) for x in (k, gap, flow, start))]
        return pa.RecordBatch.from_arrays(arrays, ["unit", "pid", "role", "k", "gap", "flow_id", "start_us"])

    for names, new, gap, starts, flows in _unique(batches):
        k = _places(new, at)
        at = int(k[-1]) + 1
        inner = np.flatnonzero(gap >= silence_us)
        yield rows(names.take(pa.array(inner)), START, k[inner], gap[inner], flows[inner], starts[inner])
        heads = np.flatnonzero(new)
        yield rows(names.take(pa.array(heads)), HEAD, k[heads], gap[heads], flows[heads], starts[heads])
        ends = heads - 1
        if len(heads):
            if heads[0] == 0:
                if last:
                    yield rows(*last)
                ends = ends[1:]
            yield rows(names.take(pa.array(ends)), TAIL, k[ends], gap[ends], flows[ends], starts[ends])
        last = ([names[len(flows) - 1].as_py()], TAIL, k[-1:], gap[-1:], flows[-1:], starts[-1:])
    if last:
        yield rows(*last)


def _places(new: np.ndarray, at: int) -> np.ndarray:
    """0-based places within runs that begin at the marks; the first run goes on at `at`."""
    idx = np.arange(len(new))
    head = np.maximum.accumulate(np.where(new, idx, -1))
    return np.where(head >= 0, idx - head, idx + at)


def _ordered(units: DataFrame, flows: DataFrame, limit: int, partitions: int | None) -> DataFrame:
    n = partitions or shuffle_partitions(units.sparkSession)
    return range_sorted(oversized(units, flows, limit).select("unit", "start_us", "flow_id"), n, "unit", "start_us", "flow_id")


def _segments(found: DataFrame, silence: int) -> DataFrame:
    """Atomic segments (unit, pid, k, gap, flow_id) by their first flows, gap being the silence before (null at a unit's first), from the rows of _boundaries."""
    fields = ["unit", "pid", "k", "gap", "flow_id"]
    # Heads and tails are two rows for each unit and partition that meet.
    before = F.lag("start_us").over(Window.partitionBy("unit").orderBy("pid", "role"))
    heads = found.where(F.col("role") != START).withColumn("gap", F.col("start_us") - before).where((F.col("role") == HEAD) & (F.col("gap").isNull() | (F.col("gap") >= silence)))
    return found.where(F.col("role") == START).select(fields).unionByName(heads.select(fields))


def segments(units: DataFrame, flows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, silence_s: float = SILENCE_S, partitions: int | None = None) -> DataFrame:
    """The atomic segments of the oversized units as merged: (eval_unit_id, flow_id, place, gap_us, piece_start).

    A segment begins with the unit's first flow by (start, id) and with each flow
    that starts at least silence_s after the start of the one before; flow_id is
    that flow, place its 0-based place in the unit, gap_us the silence before it (0
    at the unit's first) and piece_start the place at which the piece that it
    begins in was made to start. Units with null or few flow_ids have none; ties in
    start are ordered by id.
    """
    silence = round(silence_s * 1_000_000)
    found = cut(_ordered(units, flows, limit, partitions).mapInArrow(lambda it: _boundaries(it, silence), _EDGE))
    merged = _merged(found, silence, limit, overlap).where("flow_id is not null")
    return merged.select(F.col("unit").alias("eval_unit_id"), "flow_id", F.col("pos").alias("place"), F.col("gap").alias("gap_us"), "piece_start")


def merge_segments(sizes: list[int], gaps: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """First segment of each piece: adjacent segments are merged, smallest gap first (then the earlier), while they fit.

    gaps[i] is the silence before segment i. Every piece but the first starts with
    the overlap, so it holds limit - overlap flows of its own; which piece comes
    first is known from the start.
    """
    n = len(sizes)
    left, right, size, alive, tried = array("q", range(-1, n - 1)), array("q", range(1, n + 1)), array("q", sizes), bytearray([1]) * n, bytearray(n)
    # Merging changes no gap, so one stable order serves as the queue. Sizes only grow: a boundary that does not fit now fits later only where the piece
    # before it has become part of the first piece, which may hold more.
    for i in memoryview(np.argsort(np.asarray(gaps[1:], np.int64), kind="stable") + 1):  # the boundary before segment i
        tried[i] = 1
        while i < n and tried[i]:
            a = left[i]
            if size[a] + size[i] > (limit if a == 0 else limit - overlap):
                break
            size[a] += size[i]
            alive[i] = 0
            right[a] = right[i]
            if right[i] < n:
                left[right[i]] = a
            if a:
                break
            i = right[0]
    return [i for i in range(n) if alive[i]]


def cut_points(at: np.ndarray, gaps: np.ndarray, total: int, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in a unit of `total` flows, and whether at a silence, from the places and gaps of its segments.

    A segment too long for any piece is cut at equal lengths. The unit is merged as
    a whole: it is only taken apart at boundaries that can't be merged, since the
    atoms beside them are too large together, and pieces only grow.
    """
    step = limit - overlap
    sizes = np.diff(at, append=total)
    own = np.full(len(at), step)
    own[0] = limit
    parts = 1 + np.maximum(0, -(-(sizes - own) // step))
    seg = np.repeat(np.arange(len(at)), parts)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = at[seg] + np.where(nth > 0, own[seg] + (nth - 1) * step, 0)
    natural = nth == 0
    size, gap = np.diff(begin, append=total), np.where(natural, gaps[seg], 0)
    # The first piece, which has no overlap, may hold more, as long as it can reach the boundary.
    pair = size[:-1] + size[1:]
    stays = pair > limit
    reach = int(np.argmax(stays)) if stays.any() else len(stays)
    stays[reach:] |= pair[reach:] > step
    heads = np.append(0, np.flatnonzero(stays) + 1)
    keep = np.zeros(len(begin), bool)
    keep[heads] = True
    ends = np.append(heads[1:], len(begin))
    for h, e in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist()):
        most, shared = (step, 0) if h else (limit, overlap)
        keep[h + np.array(merge_segments(size[h:e], gap[h:e], most, shared))] = True
    return begin[keep], natural[keep]


_ROW = "unit string, pid int, k long, gap long, flow_id long, start_us long"
_PIECE = "unit string, flow_id long, pos long, gap long, piece_start long, piece_end long, natural boolean"
_OUT = "eval_unit_id string, piece_start long, natural boolean, flow_ids array<long>, start_us long, end_us long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, at = partition_id(), 0
    for names, new, gap, starts, flows in _unique(batches):
        n = len(flows)
        k = _places(new, at)
        at = int(k[-1]) + 1
        yield pa.RecordBatch.from_arrays([names, pa.array([pid] * n, pa.int32()), *(pa.array(x, pa.int64()) for x in (k, gap, flows, starts))], ["unit", "pid", "k", "gap", "flow_id", "start_us"])


def _marked(rows: DataFrame, silence: int) -> DataFrame:
    """What _boundaries finds, from rows that are numbered and written already."""
    fields = ["k", "gap", "flow_id", "start_us"]
    role = lambda df, r: df.select("unit", "pid", F.lit(r).alias("role"), *fields)
    last = rows.groupBy("unit", "pid").agg(F.max(F.struct(*fields)).alias("last")).select("unit", "pid", "last.*")
    return role(rows.where(F.col("gap") >= silence), START).unionByName(role(rows.where("k = 0"), HEAD)).unionByName(role(last, TAIL))


def _merge_unit(table: pa.Table, limit: int, overlap: int) -> pa.Table:
    """One unit merged, from its segments (unit, pos, gap, flow_id) and a last row with gap -1 whose pos is the number of its flows: its segments with the pieces they begin in, and its pieces (flow_id null)."""
    t = table.sort_by("pos")
    pos, gap = (t.column(c).to_numpy() for c in ("pos", "gap"))
    end, is_segment = int(pos[gap == -1][0]), gap != -1
    pos, gap, flow = pos[is_segment], gap[is_segment], t.column("flow_id").filter(pa.array(is_segment)).combine_chunks()
    begin, natural = cut_points(pos, gap, end, limit, overlap)
    ends = np.append(begin[1:], end)
    into = np.searchsorted(begin, pos, "right") - 1
    n, m = len(pos), len(begin)
    return pa.table({
        "unit": pa.array([t.column("unit")[0].as_py()] * (n + m), pa.string()),
        "flow_id": pa.concat_arrays([flow if isinstance(flow, pa.Array) else pa.concat_arrays(flow.chunks), pa.nulls(m, pa.int64())]),
        "pos": np.append(pos, begin), "gap": np.append(gap, np.zeros(m, np.int64)), "piece_start": np.append(begin[into], begin), "piece_end": np.append(ends[into], ends), "natural": np.append(natural[into], natural),
    })


def _placed_by(found: DataFrame) -> DataFrame:
    """(unit, pid, offset): how many of a unit's flows stand in the partitions before; a row for each unit and partition that meet."""
    held = found.where(F.col("role") == TAIL).select("unit", "pid", (F.col("k") + 1).alias("n"))
    before = Window.partitionBy("unit").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("unit", "pid", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def _merged(found: DataFrame, silence: int, limit: int, overlap: int) -> DataFrame:
    """The units' segments, merged agglomeratively: rows of _merge_unit."""
    offset = _placed_by(found)
    listed = _segments(found, silence).join(offset, ["unit", "pid"]).select("unit", (F.col("k") + F.col("offset")).alias("pos"), F.coalesce("gap", F.lit(0)).alias("gap"), "flow_id")
    totals = offset.groupBy("unit").agg(F.sum("n").alias("pos")).select("unit", "pos", F.lit(-1).cast("long").alias("gap"), F.lit(None).cast("long").alias("flow_id"))
    return listed.unionByName(totals).groupBy("unit").applyInArrow(lambda t: _merge_unit(t, limit, overlap), _PIECE)


def _cut_block(rows: pa.Table, cuts: pa.Table, overlap: int) -> pa.Table:
    """The pieces of `cuts` with their flows, which all stand in `rows`."""
    begin, end = (cuts.column(c).to_numpy() for c in ("piece_start", "piece_end"))
    pos = rows.column("pos").to_numpy()
    order = np.argsort(pos)
    base = int(pos[order[0]]) if len(pos) else 0
    lo, hi = np.maximum(0, begin - overlap) - base, end - base
    n = hi - lo
    ends = np.cumsum(n)
    at = order[np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - lo, n)]
    ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(rows.column("flow_id").to_numpy()[at], pa.int64()))
    starts = rows.column("start_us").to_numpy()[order]
    return pa.table({"eval_unit_id": cuts.column("unit"), "piece_start": begin, "natural": cuts.column("natural"), "flow_ids": ids, "start_us": starts[lo], "end_us": starts[hi - 1]})


def pieces(units: DataFrame, flows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, silence_s: float = SILENCE_S, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """Pieces (eval_unit_id, piece_start, natural, flow_ids, start_us, end_us) of the oversized units.

    piece_start is the 0-based place of the piece's first own flow in the unit's
    time order; before it stand the `overlap` flows of the piece before. No piece
    holds more than `limit` flows. natural tells a cut at a silence from one made
    because no silence was near. One task holds a unit's list of segments, and
    another at most `block` of its flows and those around them.
    """
    if not 0 <= overlap < limit <= block:
        raise ValueError("overlap < limit <= block must hold")
    silence = round(silence_s * 1_000_000)
    rows = cut(_ordered(units, flows, limit, partitions).mapInArrow(_numbered, _ROW))
    found = cut(_marked(rows, silence))
    offset = _placed_by(found).select("unit", "pid", "offset")
    cuts = _merged(found, silence, limit, overlap).where("flow_id is null").select("unit", "piece_start", "piece_end", "natural", F.expr(f"piece_start div {block}").alias("block"))
    placed = rows.join(offset, ["unit", "pid"]).select("unit", (F.col("k") + F.col("offset")).alias("pos"), "flow_id", "start_us").withColumn("block", F.expr(f"pos div {block}"))
    # A piece is made in the block in which it begins: flows before the block go along as its overlap, flows after it as its end.
    lead = placed.where(F.col("pos") % block >= block - overlap).withColumn("block", F.col("block") + 1)
    tail = placed.where((F.col("pos") % block < limit) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    around = placed.unionByName(lead).unionByName(tail)
    return around.groupBy("unit", "block").cogroup(cuts.groupBy("unit", "block")).applyInArrow(lambda a, b: _cut_block(a, b, overlap), _OUT)


def checked(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Per unit what its pieces amount to: (eval_unit_id, flow_count, within_limit, overlaps_hold): own flows of all pieces, whether none exceeds the limit, and whether each begins with the last flows of the one before, which a piece meets by its place."""
    p = pieces.select("eval_unit_id", "piece_start", "flow_ids", F.when(F.col("piece_start") > 0, overlap).otherwise(0).alias("shared"))
    p = p.withColumn("own", F.size("flow_ids") - F.least("shared", "piece_start"))
    ends = p.select("eval_unit_id", (F.col("piece_start") + F.col("own")).alias("piece_start"), F.expr(f"slice(flow_ids, -least({overlap}, size(flow_ids)), {overlap})").alias("tail"))
    met = p.join(ends, ["eval_unit_id", "piece_start"], "left")
    holds = (F.col("piece_start") == 0) | F.coalesce(F.slice("flow_ids", 1, F.size("tail")) == F.col("tail"), F.lit(False))
    return met.groupBy("eval_unit_id").agg(F.sum("own").cast("long").alias("flow_count"), F.every(F.size("flow_ids") <= limit).alias("within_limit"), F.every(holds).alias("overlaps_hold"))
