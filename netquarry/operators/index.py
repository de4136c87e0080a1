"""Flow ids, rollups and evaluation units of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.columns import gold_label, n_unique, sum0
from netquarry.operators.scan import numbered
from netquarry.session import cut, looked_up, shuffle_partitions

#: Fixed value: the order that gives flows their ids; the remaining columns break ties.
ID_ORDER = ["ts_start", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_out", "pkts_out"]


def assign_flow_ids(flows: DataFrame, partitions: int | None = None) -> DataFrame:
    """flows with contiguous flow_id from 0 by ID_ORDER and then every other column."""
    rest = [c for c in flows.columns if c not in ID_ORDER]
    n = partitions or shuffle_partitions(flows.sparkSession)
    return numbered(flows, None, ID_ORDER + rest, n).withColumnRenamed("_pos", "flow_id")


def _by_service(flows: DataFrame) -> DataFrame:
    """Flows of one pair, destination port and protocol as one row: what the wider rollups count distinct values over."""
    sums = {"b": F.col("bytes_in") + F.col("bytes_out"), "p": F.col("pkts_in") + F.col("pkts_out"), **{c: F.col(c) for c in ("bytes_in", "bytes_out", "pkts_in", "pkts_out")}}
    return flows.groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_malicious").alias("m"), F.min("ts_start").alias("lo"), F.max("ts_start").alias("hi"), *[F.sum(c).alias(f"s_{name}") for name, c in sums.items()]
    )


def pair_stats(flows: DataFrame) -> DataFrame:
    """Rollup by (src_ip, dst_ip); nulls count as values in distinct counts, and a sum over nulls only is 0.

    Source ports, which hardly repeat, are counted by a grouping of their own; all
    else comes from one grouping by service, so no row of flows is repeated.
    """
    wide = (
        _by_service(flows)
        .groupBy("src_ip", "dst_ip")
        .agg(
            F.sum("n").alias("flow_count"),
            F.sum("m").alias("malicious_flow_count"),
            sum0(F.col("s_b")).alias("bytes_total"),
            sum0(F.col("s_p")).alias("pkts_total"),
            n_unique(F.col("dst_port")).alias("distinct_dst_ports"),
            n_unique(F.col("protocol")).alias("distinct_protocols"),
            F.min("lo").alias("ts_start_min"),
            F.max("hi").alias("ts_start_max"),
            sum0(F.col("s_bytes_in")).alias("bytes_in_total"),
            sum0(F.col("s_bytes_out")).alias("bytes_out_total"),
        )
    )
    ports = flows.select("src_ip", "dst_ip", "src_port").distinct().groupBy(F.col("src_ip").alias("_s"), F.col("dst_ip").alias("_d")).agg(F.count(F.lit(1)).alias("distinct_src_ports"))
    both = wide.join(ports, F.col("src_ip").eqNullSafe(F.col("_s")) & F.col("dst_ip").eqNullSafe(F.col("_d")))
    order = ["src_ip", "dst_ip", "flow_count", "malicious_flow_count", "bytes_total", "pkts_total", "distinct_dst_ports", "distinct_src_ports", "distinct_protocols", "ts_start_min", "ts_start_max"]
    return both.select(*order, "bytes_in_total", "bytes_out_total")


def pairs(stats: DataFrame) -> DataFrame:
    """The pair table, a projection of pair_stats, with an id that SQL can also make."""
    pair_id = F.substring(F.md5(F.concat_ws("|", "src_ip", F.coalesce("dst_ip", F.lit("")))), 1, 16)
    return stats.select(pair_id.alias("pair_id"), "src_ip", "dst_ip", "flow_count", "malicious_flow_count", "ts_start_min", "ts_start_max", "bytes_total", "pkts_total", "distinct_dst_ports", "distinct_src_ports")


def with_pair_ids(p: DataFrame) -> DataFrame:
    """p with pair_id as 16 hex digits of BLAKE2b over source and destination."""

    def name(batches):
        import pyarrow as pa

        from netquarry.functions.hashing import hash_obj

        for b in batches:
            at = [b.schema.get_field_index(c) for c in ("pair_id", "src_ip", "dst_ip")]
            ids = pa.array([hash_obj([s, d])[:16] for s, d in zip(*(b.column(i).to_pylist() for i in at[1:]))], pa.string())
            yield b.set_column(at[0], "pair_id", ids)

    return p.mapInArrow(name, p.schema)


def hosts(flows: DataFrame) -> DataFrame:
    """Rollup by source. Destinations are counted over a first grouping by pair, so a heavy source arrives as partial states of its pairs."""
    by_pair = flows.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_malicious").alias("m"),
        F.min("ts_start").alias("lo"),
        F.max("ts_start").alias("hi"),
        F.sum("bytes_out").alias("o"),
        F.sum("bytes_in").alias("i"),
    )
    return by_pair.groupBy(F.col("src_ip").alias("host")).agg(
        F.sum("n").alias("flow_count"),
        F.sum("m").alias("malicious_flow_count"),
        F.count(F.lit(1)).alias("distinct_destinations"),
        F.count_if(F.col("m") > 0).alias("distinct_malicious_destinations"),
        F.min("lo").alias("ts_start_min"),
        F.max("hi").alias("ts_start_max"),
        sum0(F.col("o")).alias("bytes_out_total"),
        sum0(F.col("i")).alias("bytes_in_total"),
    )


def hosts_rollup(flows: DataFrame) -> DataFrame:
    """Rollup by source over a first grouping by pair and service, so distinct values are counted over few rows and a heavy source arrives in parts."""
    return _by_service(flows).groupBy(F.col("src_ip").alias("host")).agg(
        F.sum("n").alias("flow_count"),
        F.sum("m").alias("malicious_flow_count"),
        n_unique(F.col("dst_ip")).alias("distinct_destinations"),
        sum0(F.col("s_bytes_out")).alias("bytes_out_total"),
        sum0(F.col("s_bytes_in")).alias("bytes_in_total"),
        sum0(F.col("s_pkts_out")).alias("pkts_out_total"),
        sum0(F.col("s_pkts_in")).alias("pkts_in_total"),
        F.min("lo").alias("ts_start_min"),
        F.max("hi").alias("ts_start_max"),
        n_unique(F.col("dst_port")).alias("distinct_dst_ports"),
        n_unique(F.col("protocol")).alias("distinct_protocols"),
    )


def bucketed(flows: DataFrame, window_min: float) -> DataFrame:
    return flows.withColumn("bucket", F.floor(F.col("ts_start") / F.lit(60.0 * window_min)).cast("long"))


def host_fanout(flows: DataFrame, window_min: float) -> DataFrame:
    """(host, max_distinct_dst): most distinct destinations of a source in one epoch-aligned window."""
    per_bucket = bucketed(flows, window_min).select("src_ip", "bucket", "dst_ip").distinct().groupBy("src_ip", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return per_bucket.groupBy(F.col("src_ip").alias("host")).agg(F.max("n").alias("max_distinct_dst"))


def unit_bridge(flows: DataFrame, k: int, window_min: float, max_flows: int, partitions: int | None = None) -> DataFrame:
    """Every flow with its unit: (unit_type, src_ip, dst_ip, bucket, chunk, flow_id, ts_start, flow_dst, is_malicious).

    A source that reaches k destinations in any window has all its flows in
    host_egress units by window; the others' are pair_timeline units. Units longer
    than max_flows are chunked by (ts_start, flow_id); max_flows <= 0 does not
    chunk. Labels play no part.
    """
    wide = cut(host_fanout(flows, window_min).where(F.col("max_distinct_dst") >= k).select(F.col("host").alias("src_ip"), F.lit(True).alias("wide")))
    f = looked_up(bucketed(flows, window_min), wide, ["src_ip"], "flow_id").withColumn("wide", F.coalesce("wide", F.lit(False)))
    f = f.select(
        F.when(F.col("wide"), "host_egress").otherwise("pair_timeline").alias("unit_type"),
        "src_ip",
        F.when(~F.col("wide"), F.col("dst_ip")).alias("dst_ip"),
        F.when(F.col("wide"), F.col("bucket")).alias("bucket"),
        "flow_id",
        "ts_start",
        F.col("dst_ip").alias("flow_dst"),
        "is_malicious",
    )
    if max_flows <= 0:
        return f.withColumn("chunk", F.lit(0).cast("long"))
    key = F.concat_ws("\x1f", "unit_type", "src_ip", F.coalesce("dst_ip", F.col("bucket").cast("string"), F.lit("")))
    n = partitions or shuffle_partitions(flows.sparkSession)
    out = numbered(f.withColumn("_unit", key), "_unit", ["ts_start", "flow_id"], n)
    return out.withColumn("chunk", F.expr(f"_pos div {max_flows}")).drop("_unit", "_pos")


UNIT = ["unit_type", "src_ip", "dst_ip", "bucket", "chunk"]


def units(bridge: DataFrame) -> DataFrame:
    """Unit rows with ordered flow_ids (bounded by the chunk size), counts, span and gold label."""
    u = bridge.groupBy(*UNIT).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts_start", "flow_id"))), lambda x: x["flow_id"]).alias("flow_ids"),
        F.count(F.lit(1)).alias("flow_count"),
        F.count_if("is_malicious").alias("malicious_flow_count"),
        F.count_distinct("flow_dst").alias("distinct_destinations"),
        F.min("ts_start").alias("ts_start_min"),
        F.max("ts_start").alias("ts_start_max"),
    )
    return u.withColumn("gold_label", gold_label(F.col("malicious_flow_count"), F.col("flow_count")))


def ordered_units(u: DataFrame, partitions: int | None = None) -> DataFrame:
    """u with `place`, its 0-based position by type, source, destination (none first) and start; later chunks of one start come later."""
    keyed = u.withColumn("_dst", F.coalesce("dst_ip", F.lit("")))
    return numbered(keyed, None, ["unit_type", "src_ip", "_dst", "ts_start_min", "bucket", "chunk"], partitions or shuffle_partitions(u.sparkSession)).withColumnRenamed("_pos", "place").drop("_dst")


def chosen_units(u: DataFrame, unit_id: str | None = None, limit: int | None = None, id_col: str = "eval_unit_id") -> DataFrame:
    """The unit of an id, or the first `limit` units by id; exactly one of the two must be asked for."""
    if (unit_id is None) == (limit is None):
        raise ValueError("ask for either a unit or a limit")
    if limit is not None:
        if limit < 1:
            raise ValueError("the limit must be positive")
        return u.orderBy(id_col).limit(limit)
    found = u.where(F.col(id_col) == unit_id)
    if found.isEmpty():
        raise LookupError(f"no unit {unit_id}")
    return found


def assignment_report(u: DataFrame) -> DataFrame:
    """One row: units by type and by label, and how many hosts have host_egress units."""
    is_ = lambda c, v: F.col(c) == v
    by_host = u.groupBy("src_ip").agg(
        *[F.count_if(is_("unit_type", t)).alias(f"{t}_count") for t in ("pair_timeline", "host_egress")], *[F.count_if(is_("gold_label", g)).alias(f"{g}_units") for g in ("benign", "mixed", "malicious")]
    )
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in by_host.columns if c != "src_ip"]
    return by_host.agg(*total, F.count_if(F.col("host_egress_count") > 0).alias("host_egress_hosts"))


def unit_report(u: DataFrame) -> DataFrame:
    return u.groupBy("unit_type", "gold_label").agg(F.count(F.lit(1)).alias("units"), F.sum("flow_count").alias("flow_count"), F.sum("malicious_flow_count").alias("malicious_flow_count"))


def with_unit_ids(u: DataFrame) -> DataFrame:
    """Units with their content ids: pt-/he- and 16 hex digits of BLAKE2b over what the unit holds."""

    def name(batches):
        import pyarrow as pa

        from netquarry.functions.hashing import hash_flow_ids, hash_obj

        for b in batches:
            ids = []
            for kind, src, bucket, flows in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("unit_type", "src_ip", "bucket", "flow_ids"))):
                ids.append("pt-" + hash_flow_ids(flows)[:16] if kind == "pair_timeline" else "he-" + hash_obj([src, bucket, flows])[:16])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *b.columns], names=["eval_unit_id", *b.schema.names])

    return u.mapInArrow(name, "eval_unit_id string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in u.schema.fields))
