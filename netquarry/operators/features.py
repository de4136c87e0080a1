"""Per-entity feature table from events (problem 1).

Events are dealt by id over all partitions. Each partition gives its entities
local ordinals and keeps, for each type, bit-sliced counters and totals over
those ordinals with aligned arrays of first and last times. States are cut by a
digit of their entities' hash and added with bitmap carries, fan_in at a time, in
as many rounds as the partitions need: a node gets at most fan_in states and sends
at most fan_in, so their number grows with the partitions, and a heavy entity
arrives as small states and never as rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.columns import epoch_us, protocol_name, source_id, whole
from netquarry.operators.bitslice import TypedState
from netquarry.operators.scan import partition_id
from netquarry.session import shuffle_partitions, small

ROWS_AT_ONCE = 131_072
#: States that are added in one task, and parts a state is cut into.
FAN_IN = 64


def service_events(flows: DataFrame, services: DataFrame) -> DataFrame:
    """Events (id, index_id, host, service_id, value, time_us) of the flows that have a source, a start and a service."""
    s = services.select(F.col("dst_port").alias("_port"), protocol_name(F.col("protocol")).alias("_proto"), F.col("service_id")).where("_port is not null and _proto is not null and service_id is not null")
    f = flows.select(
        F.col("_flow_id").alias("id"),
        "index_id",
        source_id(F.col("src_ip")).alias("host"),
        F.col("dst_port").alias("_port"),
        protocol_name(F.col("protocol")).alias("_proto"),
        whole(F.col("bytes_out")).alias("value"),
        epoch_us(F.col("ts_start")).alias("time_us"),
    ).where("host is not null and time_us is not null and index_id is not null")
    return f.join(small(s), ["_port", "_proto"]).select("id", "index_id", "host", "service_id", "value", "time_us")


def rounds_of(partitions: int, fan_in: int) -> tuple[int, int]:
    """(rounds, fan-in of each): the fewest rounds that bring all partitions together, evenly."""
    rounds = 1
    while fan_in**rounds < partitions:
        rounds += 1
    even = next(f for f in range(1, partitions + 1) if f**rounds >= partitions)
    return rounds, max(even, 1)


def entity_features(events: DataFrame, partitions: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (index_id, host, service_id, flow_count, bytes_out_total, first_us, last_us) for each entity and type with an event.

    Events with the same id count once; events without id count each. The value
    is a whole number of either sign. No events give no rows.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    n = partitions or shuffle_partitions(events.sparkSession)
    rounds, f = rounds_of(n, fan_in)
    dealt = (
        events.withColumn("hash", F.pmod(F.xxhash64("index_id", "host"), F.lit(f**rounds)))
        .withColumn("deal", F.coalesce(F.xxhash64("id"), F.xxhash64("host", "time_us", "value")))
        .repartition(n, "deal")
        .sortWithinPartitions("id")
        .select("id", "index_id", "host", "service_id", "value", "time_us", "hash")
    )
    states = dealt.mapInArrow(lambda it: partition_states(it, f), _STATE)
    inner = lambda level: lambda t: merge_states(t, f, level)
    for level in range(1, rounds):
        states = states.groupBy("block", "node").applyInArrow(inner(level), _STATE)
    return states.groupBy("block", "node").applyInArrow(feature_rows, "index_id string, host string, service_id long, flow_count long, bytes_out_total long, first_us long, last_us long")


_STATE = "block long, node int, state binary"


def partition_states(batches: Iterator[pa.RecordBatch], fan_in: int) -> Iterator[pa.RecordBatch]:
    """A partition's state, cut by the lowest digit of its entities' hashes."""
    ordinal: dict[tuple[str, str], int] = {}
    hash_of: list[int] = []
    types: dict[int, int] = {}
    state, waiting, held, last_id = TypedState.empty(), [], 0, None

    def flush() -> None:
        nonlocal state, waiting, held
        if waiting:
            ent, typ, val, time = (np.concatenate(x) for x in zip(*waiting))
            state = state + TypedState.of_rows((typ << 32) | ent, val, time)
            waiting, held = [], 0

    for b in batches:
        if not b.num_rows:
            continue
        no_id = b.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != ids[:-1]) | no_id[1:] | no_id[:-1]
        keep[0] = no_id[0] or last_id is None or ids[0] != last_id
        last_id = None if no_id[-1] else ids[-1]
        b = b.filter(pa.array(keep))
        if not b.num_rows:
            continue
        entity = pc.binary_join_element_wise(b.column(1), b.column(2), "\x1f").dictionary_encode()
        heads = _first_rows(entity.indices.to_numpy(zero_copy_only=False), len(entity.dictionary))
        hashes = b.column(6).to_numpy(zero_copy_only=False)
        codes = np.empty(len(heads), np.int64)
        for i, name in enumerate(entity.dictionary.to_pylist()):
            o = ordinal.get(name)
            if o is None:
                o = ordinal[name] = len(ordinal)
                hash_of.append(int(hashes[heads[i]]))
            codes[i] = o
        service = b.column(3).to_numpy(zero_copy_only=False)
        kinds, inverse = np.unique(service, return_inverse=True)
        kind_codes = np.array([types.setdefault(int(k), len(types)) for k in kinds], np.int64)
        waiting.append((codes[entity.indices.to_numpy(zero_copy_only=False)], kind_codes[inverse], b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)))
        held += b.num_rows
        if held >= ROWS_AT_ONCE:
            flush()
    flush()
    if not ordinal:
        return
    yield from _cut(np.array(list(ordinal), object), np.array(hash_of), np.array(list(types), np.int64), state, fan_in, 0, 0, partition_id())


def _cut(names: np.ndarray, hashes: np.ndarray, ids: np.ndarray, state: TypedState, fan_in: int, level: int, block: int, node: int) -> Iterator[pa.RecordBatch]:
    """A state in parts by a digit of its entities' hashes, each with ordinals of its own, addressed to the node that adds it."""
    digit = hashes // fan_in**level % fan_in
    by_digit = np.argsort(digit, kind="stable")
    bounds = np.searchsorted(digit[by_digit], np.arange(fan_in + 1))
    local = np.empty(len(names), np.int64)
    local[by_digit] = np.arange(len(names)) - bounds[digit[by_digit]]
    ent, typ = state.at & 0xFFFFFFFF, state.at >> 32
    to, of_row = (typ << 32) | local[ent], digit[ent]
    rows = np.argsort(of_row, kind="stable")
    row_bounds = np.searchsorted(of_row[rows], np.arange(fan_in + 1))
    codec = pa.Codec("zstd", compression_level=1)
    for k in range(fan_in):
        members = by_digit[bounds[k] : bounds[k + 1]]
        if not len(members):
            continue
        part = state.moved(to, rows[row_bounds[k] : row_bounds[k + 1]])
        raw = pickle.dumps((names[members].tolist(), hashes[members], ids, part), protocol=5)
        packed = len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([block + k * fan_in**level], pa.int64()), pa.array([node // fan_in], pa.int32()), pa.array([packed], pa.binary())], ["block", "node", "state"])


def _first_rows(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


def _added(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, TypedState]:
    """The states of a node on common ordinals, added: names, hashes, types and the sum."""
    codec = pa.Codec("zstd")
    ordinal: dict[str, int] = {}
    hashes: list[np.ndarray] = []
    types: dict[int, int] = {}
    waiting: list[tuple[int, TypedState]] = []  # (how many states it holds, state): equals are added, as in a binary counter
    for raw in table.column("state"):
        data = raw.as_buffer()
        names, hashed, ids, part = pickle.loads(codec.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little")))
        known = len(ordinal)
        ent = np.array([ordinal.setdefault(n, len(ordinal)) for n in names], np.int64)
        fresh = ent >= known
        hashes.append(hashed[fresh][np.argsort(ent[fresh])])
        typ = np.array([types.setdefault(int(i), len(types)) for i in ids], np.int64)
        to = (typ[part.at >> 32] << 32) | ent[part.at & 0xFFFFFFFF]
        waiting.append((1, part.moved(to, np.arange(len(to)))))
        while len(waiting) > 1 and waiting[-1][0] == waiting[-2][0]:
            (n, a), (m, b) = waiting.pop(), waiting.pop()
            waiting.append((n + m, a + b))
    total = TypedState.empty()
    for _, part in reversed(waiting):
        total = total + part
    return list(ordinal), np.concatenate(hashes), np.array(list(types), np.int64), total


def merge_states(table: pa.Table, fan_in: int, level: int) -> pa.Table:
    """One node of an inner round: its states added, and cut by the next digit."""
    names, hashes, types, total = _added(table)
    block, node = table.column("block")[0].as_py(), table.column("node")[0].as_py()
    return pa.Table.from_batches(_cut(np.array(names, object), hashes, types, total, fan_in, level, block, node))


def feature_rows(table: pa.Table) -> pa.Table:
    """The last round: a block of entities, decoded."""
    entities, _, types, total = _added(table)
    counts, totals = total.numbers()
    names = np.array([n.split("\x1f") for n in entities], object).reshape(-1, 2)[total.at & 0xFFFFFFFF]
    service = types[total.at >> 32]
    return pa.table({
        "index_id": pa.array(names[:, 0], pa.string()), "host": pa.array(names[:, 1], pa.string()), "service_id": pa.array(service, pa.int64()), "flow_count": pa.array(counts, pa.int64()),
        "bytes_out_total": pa.array(totals, pa.int64()), "first_us": pa.array(total.first, pa.int64()), "last_us": pa.array(total.last, pa.int64()),
    })


def feature_table(features: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row an entity: a map service_id -> (flow_count, bytes_out_total, first_us, last_us) next to the totals of its latest build in hosts.

    Entities of either side appear; what a side lacks is null, an entity without
    any service has an empty map. Of repeated builds the latest built_at holds,
    then the larger flow_count. The map is bounded by the number of types.
    """
    total = ["flow_count", "malicious_flow_count", "distinct_destinations", "distinct_malicious_destinations", "ts_start_min", "ts_start_max", "bytes_out_total", "bytes_in_total"]
    latest = (
        hosts.select("index_id", source_id(F.col("host")).alias("host"), F.struct("built_at", *[F.col(c).alias(c) for c in total]).alias("_b"))
        .where("index_id is not null and host is not null")
        .groupBy("index_id", "host")
        .agg(F.max("_b").alias("_b"))
        .select("index_id", "host", *[F.col(f"_b.{c}").alias(c) for c in total])
    )
    entry = F.struct("service_id", F.struct("flow_count", "bytes_out_total", "first_us", "last_us").alias("v"))
    wide = features.groupBy("index_id", "host").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("services"))
    return latest.join(wide, ["index_id", "host"], "full").withColumn("services", F.coalesce("services", F.expr("cast(map() as map<bigint, struct<flow_count: bigint, bytes_out_total: bigint, first_us: bigint, last_us: bigint>>)")))
