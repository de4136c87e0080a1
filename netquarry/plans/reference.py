"""Queries of the index, tool, scoring, sampling and rollup operators, with their SQL.

All run over the whole flows (or documents, raw_records) table. Queries of the
tools and scores read an index that the first of them in a session builds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.columns import epoch_us, protocol_name, source_id
from netquarry.functions.hashing import hash_obj
from netquarry.operators import costs, index, lint, normalize, scoring, strata, summary, tools
from netquarry.plans import build
from netquarry.session import cut, stored, work_folder
from netquarry.sources import artifacts, tables
from netquarry.sources.tables import table

K, WINDOW_MIN, MAX_FLOWS = 5, 60, 100
SEED = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- the canonical flows -------------------------------------------------------------------------------------------

MEASURES = ["src_port", "dst_port", "bytes_in", "bytes_out", "pkts_in", "pkts_out", "tcp_flags", "flow_duration_ms"]


def flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows once per id, with source, destination and start; addresses and protocols in one spelling."""
    f = table(spark, d, "flows").select(
        F.col("_flow_id").alias("flow_id"),
        source_id(F.col("src_ip")).alias("src_ip"),
        source_id(F.col("dst_ip")).alias("dst_ip"),
        "ts_start",
        protocol_name(F.col("protocol")).alias("protocol"),
        *MEASURES,
        F.coalesce("_is_malicious", F.lit(False)).alias("is_malicious"),
    )
    # Repeats are few: rows are dealt by id at once, and one sort on each side of that exchange is saved.
    return f.where("src_ip is not null and dst_ip is not null and ts_start is not null").repartition("flow_id").dropDuplicates(["flow_id"])


def _version(spark: SparkSession, d: str, name: str) -> str:
    """What a table's files are now: their names, sizes and times, hashed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return hash_obj(sorted(seen))


def indexed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the index over the flows of a folder: flows, pair_stats, hosts_rollup, bridge, units, unit_sets or submissions. Each is written once a session, for the files as they are."""
    made = {
        "flows": lambda: flows(spark, d),
        "pair_stats": lambda: index.pair_stats(indexed(spark, d, "flows")),
        "hosts_rollup": lambda: index.hosts_rollup(indexed(spark, d, "flows")),
        "bridge": lambda: index.unit_bridge(indexed(spark, d, "flows"), K, WINDOW_MIN, MAX_FLOWS).withColumn("unit", unit_key()),
        "units": lambda: index.units(indexed(spark, d, "bridge")).withColumn("first_flow", F.array_min("flow_ids")).withColumn("unit", unit_key()),
        "unit_sets": lambda: scoring.unit_sets(indexed(spark, d, "bridge").withColumn("dst_ip", F.col("flow_dst"))),
        "submissions": lambda: submissions(indexed(spark, d, "unit_sets"), indexed(spark, d, "units").select("unit", "unit_type", "gold_label")),
    }
    return stored(spark, f"{_version(spark, d, 'flows')}-{name}", made[name])


_BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
CANON = f"""b AS (SELECT * FROM (SELECT _flow_id AS flow_id, nullif(lower(trim(any_value(src_ip), {_BLANKS})), '') AS src_ip, nullif(lower(trim(any_value(dst_ip), {_BLANKS})), '') AS dst_ip, any_value(ts_start) AS ts_start,
 CASE upper(trim(any_value(protocol))) WHEN '1' THEN 'ICMP' WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '132' THEN 'SCTP' ELSE upper(trim(any_value(protocol))) END AS protocol,
 {', '.join(f'any_value({m}) AS {m}' for m in MEASURES)}, coalesce(any_value(_is_malicious), false) AS is_malicious FROM flows GROUP BY _flow_id) WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND ts_start IS NOT NULL)"""


def _nu(c: str) -> str:
    return f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"


def _s0(e: str) -> str:
    return f"coalesce(sum({e}), 0.0)"


_PAIR_STATS = f"""ps AS (SELECT src_ip, dst_ip, count(*) AS flow_count, CAST(count(*) FILTER (is_malicious) AS BIGINT) AS malicious_flow_count, {_s0('bytes_in + bytes_out')} AS bytes_total, {_s0('pkts_in + pkts_out')} AS pkts_total,
 CAST({_nu('dst_port')} AS BIGINT) AS distinct_dst_ports, CAST({_nu('src_port')} AS BIGINT) AS distinct_src_ports, CAST({_nu('protocol')} AS BIGINT) AS distinct_protocols, min(ts_start) AS ts_start_min, max(ts_start) AS ts_start_max,
 {_s0('bytes_in')} AS bytes_in_total, {_s0('bytes_out')} AS bytes_out_total FROM b GROUP BY src_ip, dst_ip)"""
_HOSTS_ROLLUP = f"""hr AS (SELECT src_ip AS host, count(*) AS flow_count, CAST(count(*) FILTER (is_malicious) AS BIGINT) AS malicious_flow_count, CAST({_nu('dst_ip')} AS BIGINT) AS distinct_destinations, {_s0('bytes_out')} AS bytes_out_total,
 {_s0('bytes_in')} AS bytes_in_total, {_s0('pkts_out')} AS pkts_out_total, {_s0('pkts_in')} AS pkts_in_total, min(ts_start) AS ts_start_min, max(ts_start) AS ts_start_max, CAST({_nu('dst_port')} AS BIGINT) AS distinct_dst_ports, CAST({_nu('protocol')} AS BIGINT) AS distinct_protocols FROM b GROUP BY 1)"""
_PSC = f"{CANON}, {_PAIR_STATS}"

# ---- normalisation -------------------------------------------------------------------------------------------------

_RAW = {"src_ip": "IPV4_SRC_ADDR", "dst_ip": "IPV4_DST_ADDR", "ts_start": "flow_start_milliseconds", "protocol": "PROTOCOL", "src_port": "L4_SRC_PORT", "dst_port": "L4_DST_PORT", "bytes_in": "IN_BYTES", "bytes_out": "OUT_BYTES", "pkts_in": "IN_PKTS", "pkts_out": "OUT_PKTS"}


def _config(spark: SparkSession, d: str, **kw) -> normalize.Config:
    rows = table(spark, d, "column_aliases").orderBy("canonical_name", "alias_rank").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10 000 aliases")
    aliases: dict[str, tuple[str, ...]] = {}
    for r in rows:
        aliases[r.canonical_name] = (*aliases.get(r.canonical_name, ()), r.alias_name)
    return normalize.Config(aliases=aliases, **kw)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """flows as an exporter would have written them: other names, milliseconds, ports with halves."""
    f = table(spark, d, "flows").withColumn("ts_start", F.col("ts_start") * 1000).withColumn("src_port", F.col("src_port") + F.lit(0.5))
    f = f.withColumns({"Attack": F.when(F.col("_attack_label") != "benign", F.concat(F.lit(" "), "_attack_label")).otherwise(F.lit("  ")), "Label": F.col("_numeric_label")})
    return reduce(lambda df, kv: df.withColumnRenamed(*kv), _RAW.items(), f).drop("_attack_label", "_is_malicious", "_numeric_label", "tcp_flags")


_HALF_EVEN = "CAST(CASE WHEN src_port % 2 = 0 THEN src_port ELSE src_port + 1 END AS BIGINT)"


@query(f"""SELECT src_ip, dst_ip, ts_start * 1000 / 1000.0 AS ts_start, protocol, {_HALF_EVEN} AS src_port, dst_port, bytes_in, bytes_out, pkts_in, pkts_out, '' AS tcp_flags, flow_duration_ms, coalesce(sampling_rate, 1) AS sampling_rate,
CASE WHEN _attack_label IS NULL OR _attack_label = 'benign' THEN 'benign' ELSE trim(_attack_label) END AS _attack_label, lower(CASE WHEN _attack_label = 'benign' OR _attack_label IS NULL THEN '  ' ELSE ' ' || _attack_label END) NOT IN ('', 'benign') AS _is_malicious, _numeric_label FROM flows""")
def flows_normalize(spark, d):  # D1 S1 S2 P1 P2 P3 P4 P5 P7 P8
    return normalize.normalize(_raw(spark, d), _config(spark, d))


@query("SELECT CASE WHEN _numeric_label > 0 THEN 'malicious' ELSE 'benign' END AS _attack_label, coalesce(_numeric_label > 0, false) AS _is_malicious, count(*) AS n FROM flows GROUP BY ALL")
def label_numeric_fallback(spark, d):  # P6
    out = normalize.normalize(_raw(spark, d).drop("Attack"), _config(spark, d))
    return out.groupBy("_attack_label", "_is_malicious").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT median(ts_start * 1000) AS median_start, median(ts_start * 1000) > 1e12 AS milliseconds FROM flows")
def ts_median_unit(spark, d):  # A13 P3
    m = normalize.exact_median(table(spark, d, "flows"), F.col("ts_start") * 1000)
    return m.select(F.col("median").alias("median_start"), (F.col("median") > 1e12).alias("milliseconds"))


# ---- ids and rollups -----------------------------------------------------------------------------------------------

_ID_KEYS = "ts_start, src_ip, dst_ip, src_port, dst_port, protocol, bytes_out, pkts_out"


@query(f"""WITH {CANON} SELECT flow_id AS source_id, row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in _ID_KEYS.split(', '))}, flow_id) - 1 AS flow_id FROM b""")
def flow_ids(spark, d):  # D2 W1 O7
    f = flows(spark, d).select(*index.ID_ORDER, F.col("flow_id").alias("source_id"))
    return index.assign_flow_ids(f).select("source_id", "flow_id")


@query(f"""WITH {_PSC} SELECT substr(md5(concat_ws('|', src_ip, coalesce(dst_ip, ''))), 1, 16) AS pair_id, src_ip, dst_ip, flow_count, malicious_flow_count, ts_start_min, ts_start_max, bytes_total, pkts_total, distinct_dst_ports, distinct_src_ports FROM ps""")
def pairs(spark, d):  # A1 H5
    return index.pairs(index.pair_stats(flows(spark, d)))


@query(f"""WITH {CANON} SELECT src_ip AS host, count(*) AS flow_count, CAST(count(*) FILTER (is_malicious) AS BIGINT) AS malicious_flow_count, count(DISTINCT dst_ip) AS distinct_destinations, count(DISTINCT CASE WHEN is_malicious THEN dst_ip END) AS distinct_malicious_destinations,
min(ts_start) AS ts_start_min, max(ts_start) AS ts_start_max, {_s0('bytes_out')} AS bytes_out_total, {_s0('bytes_in')} AS bytes_in_total FROM b GROUP BY 1""")
def hosts(spark, d):  # A2
    return index.hosts(flows(spark, d))


@query(f"WITH {CANON}, {_HOSTS_ROLLUP} SELECT * FROM hr")
def hosts_rollup(spark, d):  # A3
    return index.hosts_rollup(flows(spark, d))


@query(f"WITH {_PSC} SELECT * FROM ps")
def pair_stats_rollup(spark, d):  # A4
    return index.pair_stats(flows(spark, d))


# ---- evaluation units ----------------------------------------------------------------------------------------------

_FAN = f"""fb AS (SELECT *, CAST(floor(ts_start / {60.0 * WINDOW_MIN}) AS BIGINT) AS bucket FROM b),
fo AS (SELECT src_ip AS host, max(n) AS max_distinct_dst FROM (SELECT src_ip, bucket, count(DISTINCT dst_ip) AS n FROM fb GROUP BY ALL) GROUP BY 1)"""
_BRIDGE = f"""{CANON}, {_FAN}, w AS (SELECT host FROM fo WHERE max_distinct_dst >= {K}),
br0 AS (SELECT CASE WHEN host IS NOT NULL THEN 'host_egress' ELSE 'pair_timeline' END AS unit_type, src_ip, CASE WHEN host IS NULL THEN dst_ip END AS dst_ip, CASE WHEN host IS NOT NULL THEN bucket END AS bucket, flow_id, ts_start, dst_ip AS flow_dst, is_malicious FROM fb LEFT JOIN w ON src_ip = host),
br AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY unit_type, src_ip, dst_ip, bucket ORDER BY ts_start, flow_id) - 1) / {MAX_FLOWS}) AS BIGINT) AS chunk FROM br0)"""
_UNITS = f"""{_BRIDGE}, un AS (SELECT unit_type, src_ip, dst_ip, bucket, chunk, count(*) AS flow_count, CAST(count(*) FILTER (is_malicious) AS BIGINT) AS malicious_flow_count, count(DISTINCT flow_dst) AS distinct_destinations, min(ts_start) AS ts_start_min, max(ts_start) AS ts_start_max, min(flow_id) AS first_flow, string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY ts_start, flow_id) AS flow_ids,
 CASE WHEN count(*) FILTER (is_malicious) = 0 THEN 'benign' WHEN count(*) FILTER (is_malicious) >= 0.8 * count(*) THEN 'malicious' ELSE 'mixed' END AS gold_label,
 concat_ws('|', unit_type, src_ip, coalesce(dst_ip, CAST(bucket AS VARCHAR)), CAST(chunk AS VARCHAR)) AS unit FROM br GROUP BY unit_type, src_ip, dst_ip, bucket, chunk)"""


def bridge(spark, d) -> DataFrame:
    narrow = cut(flows(spark, d).select("flow_id", "src_ip", "dst_ip", "ts_start", "is_malicious"))  # read twice
    return index.unit_bridge(narrow, K, WINDOW_MIN, MAX_FLOWS)


def unit_key():
    return F.concat_ws("|", "unit_type", "src_ip", F.coalesce("dst_ip", F.col("bucket").cast("string")), F.col("chunk").cast("string"))


def units(spark, d) -> DataFrame:
    return index.units(bridge(spark, d)).withColumn("first_flow", F.array_min("flow_ids")).withColumn("unit", unit_key())


@query(f"WITH {CANON}, {_FAN} SELECT * FROM fo")
def host_fanout(spark, d):  # P9 A5 A6
    return index.host_fanout(flows(spark, d), WINDOW_MIN)


@query(f"WITH {CANON}, {_FAN} SELECT host FROM fo WHERE max_distinct_dst >= {K}")
def wide_hosts(spark, d):  # P13
    return index.host_fanout(flows(spark, d), WINDOW_MIN).where(F.col("max_distinct_dst") >= K).select("host")


def _unit_cols(df):
    listed = F.concat_ws(",", F.transform("flow_ids", lambda x: x.cast("string"))).alias("flow_ids")
    return df.select("unit_type", "src_ip", "dst_ip", "bucket", "chunk", listed, "flow_count", "malicious_flow_count", "distinct_destinations", "ts_start_min", "ts_start_max", "first_flow", "gold_label", "unit")


@query(f"WITH {_UNITS} SELECT * FROM un WHERE unit_type = 'pair_timeline'")
def eval_units_pair(spark, d):  # D3 J1 P12 A7 A8 P14 O8 W2
    return _unit_cols(units(spark, d)).where("unit_type = 'pair_timeline'")


@query(f"WITH {_UNITS} SELECT * FROM un WHERE unit_type = 'host_egress'")
def eval_units_host(spark, d):  # D3
    return _unit_cols(units(spark, d)).where("unit_type = 'host_egress'")


@query(f"WITH {_BRIDGE} SELECT * FROM br")
def unit_flow_bridge(spark, d):  # W2 J1 D9
    return bridge(spark, d)


@query(f"WITH {_UNITS} SELECT unit_type, gold_label, count(*) AS units, CAST(sum(flow_count) AS BIGINT) AS flow_count, CAST(sum(malicious_flow_count) AS BIGINT) AS malicious_flow_count FROM un GROUP BY ALL")
def unit_report(spark, d):  # A23 P14
    return index.unit_report(units(spark, d))


@query(f"WITH {_UNITS} SELECT count(*) FILTER (unit_type = 'pair_timeline') AS pair_timeline_count, count(*) FILTER (unit_type = 'host_egress') AS host_egress_count, count(*) FILTER (gold_label = 'benign') AS benign_units, count(*) FILTER (gold_label = 'mixed') AS mixed_units, count(*) FILTER (gold_label = 'malicious') AS malicious_units, count(DISTINCT CASE WHEN unit_type = 'host_egress' THEN src_ip END) AS host_egress_hosts FROM un")
def assignment_report(spark, d):  # A9
    return index.assignment_report(indexed(spark, d, "units"))


@query(f"WITH {_UNITS} SELECT unit, row_number() OVER (ORDER BY unit_type, src_ip, coalesce(dst_ip, ''), ts_start_min, bucket NULLS FIRST, chunk) - 1 AS place FROM un")
def unit_order(spark, d):  # O9
    return index.ordered_units(indexed(spark, d, "units")).select("unit", "place")


@query(f"WITH {_UNITS} SELECT unit, flow_count FROM un ORDER BY unit LIMIT 25")
def first_units(spark, d):  # O10
    return index.chosen_units(indexed(spark, d, "units"), limit=25, id_col="unit").select("unit", "flow_count")


@query(f"WITH {_UNITS} SELECT unit, flow_count FROM un WHERE unit = (SELECT max(unit) FROM un)")
def unit_by_id(spark, d):  # O10
    u = indexed(spark, d, "units")
    last = u.agg(F.max("unit").alias("u")).first().u
    return index.chosen_units(u, unit_id=last, id_col="unit").select("unit", "flow_count")


@query(f"WITH {_UNITS} SELECT unit, '[' || string_agg(CAST(flow_id AS VARCHAR), ',' ORDER BY flow_id) || ']' AS payload FROM (SELECT concat_ws('|', unit_type, src_ip, coalesce(dst_ip, CAST(bucket AS VARCHAR)), CAST(chunk AS VARCHAR)) AS unit, flow_id FROM br) GROUP BY 1")
def unit_payloads(spark, d):  # H1 H4: what the ids are hashes of
    def canonical(batches):
        import pyarrow as pa

        from netquarry.functions.hashing import canonical_json

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canonical_json(sorted(ids)) for ids in b.column(1).to_pylist()], pa.string())], ["unit", "payload"])

    return indexed(spark, d, "units").select("unit", "flow_ids").mapInArrow(canonical, "unit string, payload string")


@query()
def unit_content_ids(spark, d):  # H1 H2 H4 H6
    return index.with_unit_ids(units(spark, d)).select("eval_unit_id", "unit_type", "flow_count")


# ---- tools ---------------------------------------------------------------------------------------------------------


def tool_index(spark, d) -> tools.Index:
    return tools.Index(*(lambda name=name: indexed(spark, d, name) for name in ("flows", "pair_stats", "hosts_rollup")))


_TOP = f"{_PSC}, top AS (SELECT src_ip, dst_ip FROM ps ORDER BY flow_count DESC, src_ip, dst_ip LIMIT 1)"


def _busiest(ix: tools.Index) -> tuple[str, str]:  # O12
    r = tools.list_pairs(ix, limit=1).first()
    return (r.src_ip, r.dst_ip) if r else ("", "")


_PAIR_COLS = "src_ip, dst_ip, flow_count, ts_start_min, ts_start_max, bytes_total, pkts_total, distinct_dst_ports, distinct_src_ports, distinct_protocols"
_CALL = tools.registry().call


def _list_pairs(sort: str):  # D15 O1 P10 P22 T13
    def run(spark, d):
        return _CALL(tool_index(spark, d), "list_pairs", sort=sort, limit=50)

    run.__name__ = f"list_pairs_{sort}"
    column, way = tools.PAIR_ORDER[sort]
    return query(f"WITH {_PSC} SELECT {_PAIR_COLS} FROM ps ORDER BY {column} {way} NULLS LAST, src_ip, dst_ip LIMIT 50")(run)


for _sort in tools.PAIR_ORDER:
    _list_pairs(_sort)

_FLOW_COLS = "ts_start, protocol, src_port, dst_port, bytes_in, bytes_out, pkts_in, pkts_out, tcp_flags, flow_duration_ms"


@query(f"WITH {_TOP} SELECT flow_id, {_FLOW_COLS} FROM b JOIN top USING (src_ip, dst_ip) ORDER BY ts_start, flow_id LIMIT 40 OFFSET 10")
def pair_timeline_page(spark, d):  # D16 O2
    ix = tool_index(spark, d)
    src, dst = _busiest(ix)
    return _CALL(ix, "get_pair_timeline", src_ip=src, dst_ip=dst, offset=10, limit=40)


@query(f"WITH {_TOP} SELECT count(*) AS total_flows_in_pair FROM b JOIN top USING (src_ip, dst_ip)")
def pair_timeline_total(spark, d):  # A12
    ix = tool_index(spark, d)
    return tools.pair_timeline_total(ix, *_busiest(ix))


_ASKED = [1, 5, 5, 77, 123456789012, 8, 3, 1000]


@query(f"WITH {CANON} SELECT flow_id, src_ip, dst_ip, {_FLOW_COLS} FROM b WHERE flow_id IN ({', '.join(map(str, _ASKED))})")
def get_flows(spark, d):  # D17 P11 O3 S3
    return _CALL(tool_index(spark, d), "get_flows", flow_ids=_ASKED)


@query(f"WITH {CANON}, a AS (SELECT unnest({_ASKED}) AS flow_id, unnest(range({len(_ASKED)})) AS position) SELECT CAST(position AS INTEGER) AS position, CAST(flow_id AS BIGINT) AS flow_id FROM a WHERE flow_id NOT IN (SELECT flow_id FROM b)")
def get_flows_missing(spark, d):  # J10
    return tools.missing_flow_ids(tool_index(spark, d), _ASKED)


@query(f"WITH {_TOP}, {_HOSTS_ROLLUP} SELECT host, flow_count, distinct_destinations, bytes_out_total, bytes_in_total, pkts_out_total, pkts_in_total, ts_start_min, ts_start_max, distinct_dst_ports, distinct_protocols FROM hr WHERE host = (SELECT src_ip FROM top)")
def host_rollup_lookup(spark, d):  # D18 P17 X5
    ix = tool_index(spark, d)
    return _CALL(ix, "host_rollup", host=_busiest(ix)[0])


@query(f"WITH {_TOP} SELECT src_ip, dst_ip, flow_count, bytes_total, pkts_total, distinct_dst_ports, distinct_src_ports, distinct_protocols, ts_start_min, ts_start_max FROM ps JOIN top USING (src_ip, dst_ip)")
def pair_stats_lookup(spark, d):  # D19
    ix = tool_index(spark, d)
    src, dst = _busiest(ix)
    return _CALL(ix, "pair_stats", src_ip=src, dst_ip=dst)


@query(f"WITH {_TOP} SELECT dst_ip, flow_count, bytes_total, pkts_total, distinct_dst_ports, distinct_protocols, ts_start_min, ts_start_max FROM ps WHERE src_ip = (SELECT src_ip FROM top) ORDER BY flow_count DESC, dst_ip LIMIT 25")
def top_destinations(spark, d):  # D20 O4
    ix = tool_index(spark, d)
    return _CALL(ix, "top_destinations", host=_busiest(ix)[0], limit=25)


@query(f"WITH {CANON} SELECT dst_port, protocol, count(*) AS flow_count, sum(bytes_in + bytes_out) AS bytes_total FROM b GROUP BY ALL ORDER BY flow_count DESC, dst_port NULLS LAST, protocol NULLS LAST LIMIT 100")
def port_proto_matrix(spark, d):  # D21 A10 O5
    return _CALL(tool_index(spark, d), "port_proto_matrix", limit=100)


@query(f"WITH {_TOP} SELECT dst_port, protocol, count(*) AS flow_count, sum(bytes_in + bytes_out) AS bytes_total FROM b WHERE src_ip = (SELECT src_ip FROM top) GROUP BY ALL ORDER BY flow_count DESC, dst_port NULLS LAST, protocol NULLS LAST LIMIT 100")
def port_proto_matrix_scoped(spark, d):  # D21 P10
    ix = tool_index(spark, d)
    return _CALL(ix, "port_proto_matrix", scope={"src_ip": _busiest(ix)[0]}, limit=100)


def _rarest(column: str, where: str) -> str:
    return f"SELECT 'rarest_{column}s' AS kind, CAST(value AS VARCHAR) AS value, flow_count FROM (SELECT {column} AS value, count(*) AS flow_count FROM b {where} GROUP BY ALL ORDER BY flow_count, value NULLS LAST LIMIT 50)"


_BUSIEST = "WHERE src_ip = (SELECT src_ip FROM top)"


@query(f"WITH {_TOP} {_rarest('dst_port', _BUSIEST)} UNION ALL {_rarest('dst_ip', _BUSIEST)}")
def rarity_scoped(spark, d):  # D22 A11 O6
    ix = tool_index(spark, d)
    return _CALL(ix, "rarity_stats", scope={"src_ip": _busiest(ix)[0]}, limit=50)


@query(f"WITH {CANON} {_rarest('dst_port', '')} UNION ALL {_rarest('dst_ip', '')}")
def rarity_all(spark, d):  # D22
    return _CALL(tool_index(spark, d), "rarity_stats", limit=50)


# ---- submissions and scores ----------------------------------------------------------------------------------------

PERSONAS = ["p0", "p1", "p2", "p3"]
PROVIDERS = ["alpha", "beta"]


MODELS = [("alpha", "big"), ("beta", "unpriced")]


def submissions(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Renderings of fixed, label-blind policies: units x providers x personas (J6), one row each."""
    u = sets.select("unit", F.sort_array("flows.flow_id").alias("ids"), F.array_distinct("flows.dst_ip").alias("dsts"), F.array_min("flows.flow_id").alias("m")).join(labels, "unit")
    who = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(q).alias("persona"), F.lit(m).alias("model")) for p, m in MODELS for q in PERSONAS])
    s = u.withColumn("who", F.explode(who)).select("*", "who.*")
    beta, is_ = F.col("provider") == "beta", lambda p: F.col("persona") == p
    none_ids, none_dst = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    ids = F.when(is_("p0"), F.concat(F.filter("ids", lambda x: x % 3 == 0), F.array(F.col("m") + 1_000_000_000_000))).otherwise(none_ids)
    dst = F.when(is_("p1"), F.filter("dsts", lambda x: F.length(x) % 2 == 0)).otherwise(none_dst)
    verdict = F.when(is_("p3") | is_("p0") & F.exists("ids", lambda x: x % 3 == 0) | is_("p1") & F.exists("dsts", lambda x: F.length(x) % 2 == 0), "malicious").otherwise("benign")
    return s.select(
        "provider", "persona", "model", "unit", "unit_type", "gold_label", verdict.alias("verdict"), ids.alias("indices"), dst.alias("destinations"),
        F.when(beta, F.filter("ids", lambda x: x % 2 == 0)).alias("observed_ids"), F.when(beta, F.filter("dsts", lambda x: F.length(x) % 4 == 0)).alias("observed_dsts"),
        (F.col("m") % 7 != 0).alias("valid"), ((F.col("m") % 100) / F.lit(100.0)).alias("confidence"), (100 + F.col("m") % 997).alias("wall_time_ms"), (200 + F.col("m") % 13).alias("prompt_tokens"),
        (F.col("m") % 31).alias("cached_tokens"), (40 + F.col("m") % 5).alias("output_tokens"), (F.col("m") % 3).alias("reasoning_tokens"),
    )


def rates(spark) -> DataFrame:
    """A rate card for the queries, in powers of two so that sums are exact; a card is a table like any other."""
    return spark.createDataFrame([("alpha", "big", 4.0, 0.5, 16.0, 8.0), ("alpha", "small", 1.0, 0.25, 2.0, 2.0)], "provider string, model string, input double, cached_input double, output double, reasoning double")


def priced(spark, d) -> DataFrame:
    return costs.priced(indexed(spark, d, "submissions"), rates(spark))


_SUB = f"""{_BRIDGE}, ub AS (SELECT concat_ws('|', unit_type, src_ip, coalesce(dst_ip, CAST(bucket AS VARCHAR)), CAST(chunk AS VARCHAR)) AS unit, unit_type, src_ip, flow_dst AS dst_ip, flow_id, is_malicious FROM br),
who AS (SELECT * FROM (VALUES ('alpha'), ('beta')) a(provider), (VALUES ('p0'), ('p1'), ('p2'), ('p3')) c(persona)),
us AS (SELECT unit, unit_type, min(flow_id) AS m, count(*) AS n, count(*) FILTER (is_malicious) AS mal, bool_or(flow_id % 3 = 0) AS any0, bool_or(length(dst_ip) % 2 = 0) AS any1 FROM ub GROUP BY ALL),
su AS (SELECT provider, persona, unit, unit_type, CASE WHEN mal = 0 THEN 'benign' WHEN mal >= 0.8 * n THEN 'malicious' ELSE 'mixed' END AS gold_label,
 CASE WHEN persona = 'p3' OR persona = 'p0' AND any0 OR persona = 'p1' AND any1 THEN 'malicious' ELSE 'benign' END AS verdict, m % 7 <> 0 AS valid, (m % 100) / 100.0 AS confidence, 100 + m % 997 AS wall_time_ms, 200 + m % 13 AS prompt_tokens, m % 31 AS cached_tokens, 40 + m % 5 AS output_tokens, m % 3 AS reasoning_tokens,
 CASE WHEN provider = 'alpha' THEN (200 + m % 13) / 1e6 * 4 + (m % 31) / 1e6 * 0.5 + (40 + m % 5) / 1e6 * 16 + (m % 3) / 1e6 * 8 ELSE 0.0 END AS cost_usd FROM us, who),
pf AS (SELECT provider, persona, unit, flow_id, src_ip, dst_ip, CASE WHEN persona = 'p0' AND flow_id % 3 = 0 AND (provider = 'alpha' OR flow_id % 2 = 0) OR persona = 'p1' AND length(dst_ip) % 2 = 0 AND (provider = 'alpha' OR length(dst_ip) % 4 = 0) THEN 1 ELSE 0 END AS predicted,
 CASE WHEN is_malicious THEN 1 ELSE 0 END AS gold FROM ub, who)"""


def _lens_sql(name: str, keys: str) -> str:
    return f"""{name}_k AS (SELECT provider, persona, unit, {keys}, max(predicted) AS p, max(gold) AS g FROM pf GROUP BY ALL),
{name}_c AS (SELECT provider, persona, unit, CAST(sum(p * g) AS BIGINT) AS tp, CAST(sum(p * (1 - g)) AS BIGINT) AS fp, CAST(sum((1 - p) * g) AS BIGINT) AS fn FROM {name}_k GROUP BY ALL),
{name}_r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS {name}_precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS {name}_recall FROM {name}_c),
{name} AS (SELECT *, CASE WHEN {name}_precision + {name}_recall = 0 THEN 0.0 ELSE 2 * {name}_precision * {name}_recall / ({name}_precision + {name}_recall) END AS {name}_f1 FROM {name}_r)"""


_LENSES = ", ".join([_lens_sql("per_flow", "flow_id"), _lens_sql("per_pair", "src_ip, dst_ip"), _lens_sql("per_host", "src_ip")])
_SCORED = f"""{_SUB}, {_LENSES}, sc AS (SELECT su.*, per_flow_precision, per_flow_recall, per_flow_f1, per_pair_precision, per_pair_recall, per_pair_f1, per_host_precision, per_host_recall, per_host_f1,
 CASE WHEN (verdict = 'malicious') = (f.tp + f.fp = 0) THEN 'verdict_indices_mismatch' END AS defect
 FROM su JOIN per_flow f USING (provider, persona, unit) JOIN per_pair USING (provider, persona, unit) JOIN per_host USING (provider, persona, unit))"""


def _scores(spark, d) -> DataFrame:
    return scoring.scored(indexed(spark, d, "submissions"), indexed(spark, d, "unit_sets"))


@query(f"WITH {_SUB} SELECT * FROM pf")
def per_flow_predictions(spark, d):  # D9 J2 J3 J4 J5 J6 U2 U3
    return scoring.per_flow(indexed(spark, d, "submissions"), indexed(spark, d, "unit_sets"))


def _score(name: str, keys: str):  # D6 D7 A14 U4 U5
    def run(spark, d):
        return scoring.lens(indexed(spark, d, "submissions"), indexed(spark, d, "unit_sets"), name)

    run.__name__ = f"score_{name}"
    return query(f"WITH {_SUB}, {_lens_sql(name, keys)} SELECT * FROM {name}")(run)


_score("per_flow", "flow_id")
_score("per_pair", "src_ip, dst_ip")
_score("per_host", "src_ip")


@query(f"WITH {_SCORED} SELECT provider, persona, defect, count(*) AS n FROM sc GROUP BY ALL")
def defects(spark, d):  # D8
    return _scores(spark, d).groupBy("provider", "persona", "defect").agg(F.count(F.lit(1)).alias("n"))


_COSTS = "SELECT provider, persona, count(*) AS renderings, round_even(sum(cost_usd), 6) AS cost_usd, CAST(sum(wall_time_ms) AS BIGINT) AS wall_time_ms, CAST(count(*) FILTER (valid) AS BIGINT) AS valid FROM su GROUP BY ALL"


@query(f"WITH {_SUB} {_COSTS}")
def cost_rollup(spark, d):  # A15 P18 P19 J8
    return summary.cost_rollup(priced(spark, d))


@query(f"WITH {_SUB}, c AS ({_COSTS}) SELECT provider, persona, round_even(sum(cost_usd) / sum(renderings), 6) AS cost_per_alert FROM c GROUP BY GROUPING SETS ((provider, persona), (provider))")
def cost_per_alert(spark, d):  # A25
    return costs.cost_per_alert(summary.cost_rollup(priced(spark, d)))


@query(f"WITH {_SUB} SELECT concat_ws('__', unit, provider, persona) AS rendering_id, verdict FROM su")
def rendering_ids(spark, d):  # H13
    return indexed(spark, d, "submissions").select(F.concat_ws("__", "unit", "provider", "persona").alias("rendering_id"), "verdict")


_FAMILY = "CASE provider WHEN 'alpha' THEN 'openai' WHEN 'beta' THEN CASE persona WHEN 'p0' THEN 'gemini' ELSE 'anthropic' END END"


@query(f"""WITH {_SUB}, f AS (SELECT {_FAMILY} AS provider, prompt_tokens - 190 AS prompt_tokens, cached_tokens, output_tokens - 40 AS output_tokens, reasoning_tokens FROM su)
SELECT provider, CAST(sum(CASE WHEN provider = 'anthropic' THEN prompt_tokens ELSE greatest(0, prompt_tokens - cached_tokens) END) AS BIGINT) AS prompt_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
CAST(sum(CASE WHEN provider = 'openai' THEN greatest(0, output_tokens - reasoning_tokens) ELSE output_tokens END) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens FROM f GROUP BY 1""")
def normalized_tokens(spark, d):  # G8
    s = indexed(spark, d, "submissions").select(F.expr(_FAMILY).alias("provider"), (F.col("prompt_tokens") - 190).alias("prompt_tokens"), "cached_tokens", (F.col("output_tokens") - 40).alias("output_tokens"), "reasoning_tokens")
    return costs.normalized_tokens(s).groupBy("provider").agg(*[F.sum(c).alias(c) for c in costs.CLASSES])


_POLICIES = [("p0", 4, 6, 60, 1.0), ("p1", 8, 12, 121, 2.0), ("p2", 1, 1, 3, 0.5)]
_MULTIPLIERS = {"alpha": 1.5, "beta": 0.5, "gamma": 0.125}


@query(f"""WITH p AS (SELECT * FROM (VALUES {', '.join(map(str, _POLICIES))}) t(persona, turns, calls, seconds, cap)), m AS (SELECT * FROM (VALUES {', '.join(map(str, _MULTIPLIERS.items()))}) t(provider, m))
SELECT provider, persona, {', '.join(f'CAST(greatest(1, round_even(CAST({c} AS DOUBLE) * m, 0)) AS BIGINT) AS {c}' for c in ('turns', 'calls', 'seconds'))}, CAST(cap AS DOUBLE) * m AS cap FROM p, m""")
def budget_scaling(spark, d):  # P20 G11
    p = spark.createDataFrame(_POLICIES, "persona string, turns long, calls long, seconds long, cap double")
    return costs.scaled_budgets(p, _MULTIPLIERS, ("turns", "calls", "seconds"), "cap")


@query(f"""WITH {_SUB}, n AS (SELECT provider, persona, wall_time_ms AS v, row_number() OVER (PARTITION BY provider, persona ORDER BY wall_time_ms) AS rn, count(*) OVER (PARTITION BY provider, persona) AS c FROM su)
SELECT provider, persona, count(*) AS count, CAST(trunc(avg(v)) AS BIGINT) AS mean, max(v) FILTER (rn = least(c, greatest(1, round_even(0.5 * c, 0)))) AS p50, max(v) FILTER (rn = least(c, greatest(1, round_even(0.95 * c, 0)))) AS p95, max(v) AS max FROM n GROUP BY ALL""")
def latency(spark, d):  # A16 W6
    return summary.latency(indexed(spark, d, "submissions"))


_OK, _MAL = "valid", "valid AND gold_label <> 'benign'"


def _mean(c: str, cond: str) -> str:
    return f"round_even(coalesce(avg({c}) FILTER ({cond}), 0.0), 6)"


_NATIVE = "CASE WHEN unit_type = 'host_egress' THEN per_host_f1 ELSE per_flow_f1 END"


_RATE = "round_even(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6)"
_ENTRY = f"""SELECT provider, persona, count(*) AS units, count(*) FILTER (valid) AS units_scored, {', '.join(f'{_mean(c, _OK)} AS {c}_macro' for c in summary.LENSES)}, {', '.join(f'{_mean(c, _MAL)} AS {c}_macro_malicious' for c in summary.LENSES[:3])},
count(*) FILTER ({_MAL}) AS malicious_units_scored, {_mean(_NATIVE, _OK)} AS native_lens_f1, {_RATE} AS first_pass_valid_rate, count(defect) AS defect_count,
round_even({_mean('per_flow_f1', _OK)} * {_RATE}, 6) AS effective_per_flow_f1, round_even({_mean(_NATIVE, _OK)} * {_RATE}, 6) AS effective_native_lens_f1 FROM sc GROUP BY ALL"""


@query(f"WITH {_SCORED} {_ENTRY}")
def score_entry(spark, d):  # A17 D11 D12
    return summary.score_entry(_scores(spark, d))


def _ratio(a: str, b: str) -> str:
    return f"round_even(CAST({a} AS DOUBLE) / nullif({b}, 0), 6)"


_VERDICTS = f"""vc AS (SELECT provider, persona, count(*) FILTER ({_MAL} AND verdict = 'malicious') AS tp, count(*) FILTER (valid AND gold_label = 'benign' AND verdict = 'malicious') AS fp, count(*) FILTER (valid AND gold_label = 'benign' AND verdict = 'benign') AS tn,
 count(*) FILTER ({_MAL} AND verdict = 'benign') AS fn, count(*) FILTER (gold_label <> 'benign') AS malicious_units_total FROM su GROUP BY ALL),
vr AS (SELECT *, {_ratio('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_ratio('tp', 'tp + fp')} AS "precision", {_ratio('tp', 'tp + fn')} AS recall FROM vc),
vf AS (SELECT *, CASE WHEN "precision" IS NULL OR recall IS NULL THEN NULL WHEN "precision" + recall = 0 THEN 0.0 ELSE round_even(2 * "precision" * recall / ("precision" + recall), 6) END AS f1, {_ratio('tp', 'malicious_units_total')} AS coverage_adjusted_recall FROM vr)"""


@query(f"WITH {_SUB}, {_VERDICTS} SELECT * FROM vf")
def verdict_confusion(spark, d):  # A18
    return summary.verdict_confusion(indexed(spark, d, "submissions"))


_RIGHT = "(gold_label <> 'benign') = (verdict = 'malicious')"
_CONFIDENCE = f"SELECT provider, persona, count(*) AS n, round_even(avg(confidence), 6) AS mean, {_mean('confidence', _RIGHT)} AS mean_correct, {_mean('confidence', 'NOT (' + _RIGHT + ')')} AS mean_incorrect FROM su WHERE valid GROUP BY ALL"


@query(f"WITH {_SUB} {_CONFIDENCE}")
def confidence(spark, d):  # A19
    return summary.confidence(indexed(spark, d, "submissions"))


@query(f"""WITH {_SCORED}, {_VERDICTS}, e AS ({_ENTRY}), k AS ({_CONFIDENCE}), o AS ({_COSTS})
SELECT provider, persona, o.cost_usd, o.renderings, e.native_lens_f1, e.defect_count, vf.f1 AS verdict_f1, vf.malicious_units_total, k.mean_correct, k.n AS confidence_n, e.units AS latency_count
FROM o JOIN e USING (provider, persona) JOIN vf USING (provider, persona) LEFT JOIN k USING (provider, persona)""")
def run_summary(spark, d):  # D10
    s = summary.compute_summary(costs.priced(_scores(spark, d), rates(spark)), indexed(spark, d, "submissions"))
    return s.select(
        "provider", "persona", "cost.cost_usd", "cost.renderings", "scoring.native_lens_f1", "scoring.defect_count", F.col("verdict.f1").alias("verdict_f1"), "verdict.malicious_units_total", "confidence.mean_correct",
        F.col("confidence.n").alias("confidence_n"), F.col("latency_per_unit_ms.count").alias("latency_count"),
    )


@query(f"WITH {_SCORED} SELECT unit_type || '/' || gold_label AS stratum, provider, persona, count(*) AS n, avg(per_flow_f1) AS per_flow_f1, avg(per_pair_f1) AS per_pair_f1, avg(per_host_f1) AS per_host_f1, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS valid_rate, count(defect) AS defects FROM sc GROUP BY ALL")
def stratum_breakdown(spark, d):  # A24
    return summary.stratum_breakdown(_scores(spark, d))


@query(f"""WITH {_SUB}, p AS (SELECT provider, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM su GROUP BY 1),
v AS (SELECT *, CASE WHEN provider = 'alpha' THEN round_even(cached_tokens / 1e6 * 3.5, 6) ELSE 0.0 END AS saved FROM p)
SELECT provider, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, round_even(sum(saved), 6) AS savings_usd,
round_even(coalesce(CAST(sum(cached_tokens) AS DOUBLE) / nullif(sum(cached_tokens) + sum(prompt_tokens), 0), 0.0), 6) AS hit_rate FROM v GROUP BY ROLLUP (provider)""")
def token_totals(spark, d):  # A20 J8
    return summary.token_totals(indexed(spark, d, "submissions"), costs.cache_rates(rates(spark), spark.createDataFrame(MODELS, "provider string, model string")))


# ---- sampling ------------------------------------------------------------------------------------------------------


def _sample_units(spark, d) -> DataFrame:
    return indexed(spark, d, "units").select(F.col("unit").alias("eval_unit_id"), "unit_type", "gold_label")


_SU = f"{_UNITS}, u AS (SELECT unit AS eval_unit_id, unit_type, gold_label, md5('{SEED}|' || unit) AS h FROM un), r AS (SELECT *, row_number() OVER (PARTITION BY unit_type, gold_label ORDER BY h, eval_unit_id) AS rank FROM u)"
_DENSE = "dense AS (SELECT * FROM (VALUES ('pair_timeline'), ('host_egress')) a(unit_type), (VALUES ('benign'), ('malicious'), ('mixed')) c(gold_label))"


@query(f"WITH {_UNITS}, {_DENSE} SELECT unit_type, gold_label, count(unit) AS available FROM dense LEFT JOIN un USING (unit_type, gold_label) GROUP BY ALL")
def strata_available(spark, d):  # A23
    return strata.available(_sample_units(spark, d))


@query(f"WITH {_SU} SELECT eval_unit_id, unit_type, gold_label, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def sample_hash_ranked(spark, d):  # W3 D5
    return strata.select(_sample_units(spark, d), SEED, 20).drop("_h")


@query(f"WITH {_SU}, p AS (SELECT * FROM r WHERE rank <= 5), t AS (SELECT * FROM r WHERE rank > 5 ORDER BY h, eval_unit_id LIMIT greatest(0, 60 - (SELECT count(*) FROM p))) SELECT eval_unit_id, unit_type, gold_label FROM p UNION ALL SELECT eval_unit_id, unit_type, gold_label FROM t")
def sample_topup(spark, d):  # W4 J12
    return strata.select(_sample_units(spark, d), SEED, 5, min_total=60).select("eval_unit_id", "unit_type", "gold_label")


@query(f"WITH {_SU} SELECT eval_unit_id, unit_type, gold_label FROM r WHERE rank <= 20 ORDER BY h, eval_unit_id LIMIT 50")
def sample_cap(spark, d):  # W4
    return strata.select(_sample_units(spark, d), SEED, 20, cap=50).select("eval_unit_id", "unit_type", "gold_label")


@query(f"""WITH {_SU}, p AS (SELECT *, (CASE unit_type WHEN 'pair_timeline' THEN 0 ELSE 3 END) + (CASE gold_label WHEN 'benign' THEN 0 WHEN 'malicious' THEN 1 ELSE 2 END) AS s FROM r WHERE rank <= 20)
SELECT eval_unit_id, CAST(row_number() OVER (ORDER BY rank, s) AS INTEGER) AS place FROM p""")
def sample_round_robin(spark, d):  # W5
    return strata.rotation(strata.select(_sample_units(spark, d), SEED, 20)).select("eval_unit_id", "place")


_COUNTS = "SELECT unit_type || ':' || gold_label AS k, count(eval_unit_id) AS n FROM dense LEFT JOIN {} USING (unit_type, gold_label) GROUP BY ALL"
_SHOWN = "string_agg(k || '=' || n, ',' ORDER BY k)"


@query(f"""WITH {_SU}, {_DENSE}, q AS (SELECT * FROM r WHERE rank <= 20 ORDER BY h, eval_unit_id LIMIT 50), a AS ({_COUNTS.format('u')}), c AS ({_COUNTS.format('q')})
SELECT (SELECT count(*) FROM q) AS total_selected, (SELECT {_SHOWN} FROM a) AS available, (SELECT {_SHOWN} FROM c) AS selected, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM a WHERE n < 20) AS undersampled,
(SELECT count(*) FROM r WHERE rank <= 20) > 50 AS capped""")
def sample_report(spark, d):  # D5 A23
    u = _sample_units(spark, d)
    whole, chosen = strata.select(u, SEED, 20), strata.select(u, SEED, 20, cap=50)
    shown = lambda c: F.concat_ws(",", F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))))
    r = strata.report(u, chosen, 20, whole.agg(F.count(F.lit(1)).alias("n")).scalar() > 50)
    return r.select("total_selected", shown("per_stratum_available").alias("available"), shown("per_stratum_selected").alias("selected"), F.concat_ws(",", F.array_sort("undersampled_strata")).alias("undersampled"), "capped")


# ---- runner and runs -----------------------------------------------------------------------------------------------

_TURN_CAPS = {"one": 12.0, "bytes": 400_000.0}


@query(f"""WITH {CANON}, t AS (SELECT src_ip, dst_ip, flow_id, sum(1) OVER w AS one, sum(coalesce(bytes_in, 0)) OVER w AS bytes FROM b WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY flow_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN one >= 12 THEN 'one' WHEN bytes >= 400000 THEN 'bytes' END AS reason FROM t)
SELECT src_ip, dst_ip, min(flow_id) AS stopped_at, arg_min(reason, flow_id) AS reason FROM s WHERE reason IS NOT NULL GROUP BY ALL""")
def cap_reason(spark, d):  # W9 P21
    turns = flows(spark, d).select("src_ip", "dst_ip", "flow_id", F.lit(1).alias("one"), F.coalesce("bytes_in", F.lit(0.0)).alias("bytes"))
    return summary.running_caps(turns, ["src_ip", "dst_ip"], "flow_id", _TURN_CAPS)


@query(f"""WITH {CANON}, i AS (SELECT src_ip, flow_id, is_malicious, sum(CASE WHEN NOT is_malicious THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY flow_id) AS island FROM b),
n AS (SELECT src_ip, flow_id, row_number() OVER (PARTITION BY src_ip, island ORDER BY flow_id) AS n FROM i WHERE is_malicious) SELECT src_ip, min(flow_id) AS tripped_at FROM n WHERE n = 4 GROUP BY 1""")
def failure_streaks(spark, d):  # W8
    return summary.streaks(flows(spark, d).select("src_ip", "flow_id", (~F.col("is_malicious")).alias("ok")), "src_ip", "flow_id", "ok", 4)


@query(f"""WITH {CANON}, t AS (SELECT flow_id, coalesce(bytes_in, 0) AS cost, sum(coalesce(bytes_in, 0)) OVER (ORDER BY flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) SELECT flow_id, cost FROM t WHERE coalesce(before, 0) < 5000000""")
def budget_stop(spark, d):  # W7 T26
    return summary.budget_stop(flows(spark, d).select("flow_id", F.coalesce("bytes_in", F.lit(0.0)).alias("cost")), "flow_id", "cost", 5_000_000)


@query(f"""WITH {CANON}, t AS (SELECT src_ip, dst_ip, flow_id, tcp_flags = 'FA' AS done, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY flow_id) - 1 AS used FROM b),
c AS (SELECT src_ip, dst_ip, min(flow_id) FILTER (used >= 12) AS capped, min(flow_id) FILTER (done) AS done, max(flow_id) AS last FROM t GROUP BY ALL)
SELECT src_ip, dst_ip, CASE WHEN done < coalesce(capped, done + 1) THEN done ELSE coalesce(capped, last) END AS ended_at, CASE WHEN done < coalesce(capped, done + 1) THEN 'submitted' WHEN capped IS NOT NULL THEN 'one' ELSE 'exhausted' END AS reason FROM c""")
def scripted_loop(spark, d):  # G1 G4
    turns = flows(spark, d).select("src_ip", "dst_ip", "flow_id", F.lit(1).alias("one"), (F.col("tcp_flags") == "FA").alias("done"))
    return summary.ended(turns, ["src_ip", "dst_ip"], "flow_id", {"one": 12.0}, "done")


_WRAPPED = """'{"items":[' || payload || ',{"flow_id":' || record_id || ',"x":{"dst_ip":"d' || line_no || '","flow_id":true}}],"flow_id":{"flow_id":' || line_no || '},"t":"\\\\"flow_id\\\\":5"}'"""


@query(f"""WITH o AS (SELECT record_id, line_no, payload AS p FROM raw_records WHERE json_valid(payload))
SELECT DISTINCT record_id, CAST(NULL AS BIGINT) AS flow_id, json_extract_string(p, '$.dst_ip') AS dst_ip FROM o WHERE json_type(p, '$.dst_ip') = 'VARCHAR'
UNION SELECT record_id, record_id, NULL FROM o UNION SELECT record_id, line_no, NULL FROM o UNION SELECT record_id, NULL, 'd' || line_no FROM o""")
def observed_harvest(spark, d):  # D14
    nested = table(spark, d, "raw_records").select("record_id", F.expr(_WRAPPED).alias("payload"))
    return scoring.harvested(nested, "record_id")


_ALLOWED = {"soc_analyst": ["list_pairs", "get_flows"], "adversary_hunter": ["rarity_stats", "list_pairs", "pair_stats"], "threat_analyst": ["get_flows"], "detection_engineer": []}
_TOOL_OF = ["list_pairs", "get_flows", "rarity_stats", "pair_stats", "no_such_tool"]


@query(f"""WITH c AS (SELECT persona, list_extract({_TOOL_OF}, CAST(doc_id % 5 AS INTEGER) + 1) AS tool FROM documents), a AS (SELECT * FROM (VALUES {', '.join(str((p, t)) for p, ts in _ALLOWED.items() for t in ts)}) t(persona, tool))
SELECT c.persona, c.tool, a.tool IS NOT NULL AS allowed, count(*) AS n FROM c LEFT JOIN a ON c.persona = a.persona AND c.tool = a.tool GROUP BY ALL""")
def allowlist_join(spark, d):  # J7 G3
    r = tools.registry()
    for persona, names in _ALLOWED.items():
        r.allow(persona, names)
    named = F.element_at(F.array(*map(F.lit, _TOOL_OF)), (F.col("doc_id") % 5).cast("int") + 1)
    calls = table(spark, d, "documents").select("persona", named.alias("tool"))
    return tools.checked_calls(calls, r).groupBy("persona", "tool", "allowed").agg(F.count(F.lit(1)).alias("n"))


_TAG_OF = "CASE plan_id WHEN 1 THEN 'main' WHEN 2 THEN 'tools_off' WHEN 3 THEN 'playbooks_off' WHEN 4 THEN 'strange' ELSE 'single_shot_baseline' END"
_META = [
    f"{_TAG_OF} AS ablation", "concat('r', right(concat('0000', CAST(report_id AS VARCHAR(9))), 4)) AS run_id", "CASE WHEN report_id % 4 = 0 THEN 'other' ELSE 'h' END AS dataset_hash", "CASE WHEN report_id % 5 = 0 THEN 8 ELSE 7 END AS sample_seed",
]


@query(f"SELECT ablation, max(run_id) AS run_id FROM (SELECT {', '.join(_META)}, total_selected FROM sample_reports) WHERE dataset_hash = 'h' AND sample_seed = 7 AND total_selected IS NOT NULL AND ablation <> 'strange' GROUP BY 1")
def latest_run(spark, d):  # A22 J11
    m = table(spark, d, "sample_reports").selectExpr(*_META, "total_selected")
    return summary.comparable_runs(m.drop("total_selected"), m.where("total_selected is not null").select("run_id"), "h", 7)


def _keyed(spark, d) -> DataFrame:
    """Scores of runs by tag, made of the sample reports: the mode is the provider, capped or whole the persona."""
    s = table(spark, d, "sample_reports").select(
        F.expr(_TAG_OF).alias("ablation"), F.col("mode").alias("provider"), F.when(F.col("capped"), "capped").otherwise("whole").alias("persona"),
        (F.col("total_selected") / 7.0).alias("total"), (F.col("per_stratum_selected").getItem("pair_timeline:benign") / 3.0).alias("pair_benign"),
    )
    return s.groupBy("ablation", "provider", "persona").agg(F.max("total").alias("total"), F.max("pair_benign").alias("pair_benign"))


_TAGGED = f"""t AS (SELECT {_TAG_OF} AS ablation, mode AS provider, CASE WHEN capped THEN 'capped' ELSE 'whole' END AS persona, total_selected / 7.0 AS total, element_at(per_stratum_selected, 'pair_timeline:benign')[1] / 3.0 AS pair_benign FROM sample_reports),
k AS (SELECT ablation, provider, persona, max(total) AS total, max(pair_benign) AS pair_benign FROM t GROUP BY ALL)"""


@query(f"""WITH {_TAGGED}, v AS (SELECT ablation, provider, persona, 'total' AS metric, total AS value FROM k UNION ALL SELECT ablation, provider, persona, 'pair_benign', pair_benign FROM k)
SELECT o.ablation, o.provider, o.persona, o.metric, round_even(m.value - o.value, 6) AS delta FROM v o JOIN v m USING (provider, persona, metric) WHERE m.ablation = 'main' AND o.ablation <> 'main' AND m.value IS NOT NULL AND o.value IS NOT NULL""")
def ablation_delta(spark, d):  # A21 J9 D13 U6
    return summary.ablation_delta(_keyed(spark, d), ["total", "pair_benign"])


@query(f"WITH {_TAGGED}, g AS (SELECT DISTINCT ablation FROM k WHERE ablation <> 'main') SELECT g.ablation, m.provider, m.persona FROM g, k m WHERE m.ablation = 'main' AND NOT EXISTS (SELECT 1 FROM k o WHERE o.ablation = g.ablation AND o.provider = m.provider AND o.persona = m.persona)")
def missing_ablations(spark, d):  # J9
    return summary.missing_keys(_keyed(spark, d))


# ---- files ---------------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN _flow_id % 2 = 0 THEN 'even' ELSE 'odd' END AS part, count(*) AS n, count(dst_port) AS ports, CAST(sum(dst_port) AS BIGINT) AS port_sum FROM flows WHERE _flow_id IS NOT NULL GROUP BY 1")
def multi_file_scan(spark, d):  # S1 K1
    """Two tables with the same columns in another order, scanned as one by name."""
    f, at = table(spark, d, "flows").select("_flow_id", "dst_port").where("_flow_id is not null"), work_folder(spark)
    tables.write_parquet(f.where("_flow_id % 2 = 0"), f"{at}/a")
    tables.write_parquet(f.where("_flow_id % 2 <> 0").select("dst_port", "_flow_id"), f"{at}/b")
    both = tables.parquet_files(spark, [f"{at}/a", f"{at}/b"])
    return both.groupBy(F.when(F.col("_flow_id") % 2 == 0, "even").otherwise("odd").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count("dst_port").alias("ports"), F.sum("dst_port").alias("port_sum"))


@query(f"WITH {_UNITS} SELECT unit AS eval_unit_id, unit_type, src_ip, dst_ip, flow_count, gold_label, ts_start_min FROM un")
def units_jsonl(spark, d):  # K2 S4 S5 S7
    """Units written as canonical JSON lines, read back under a schema, mirrored as parquet."""
    u = indexed(spark, d, "units").select(F.col("unit").alias("eval_unit_id"), "unit_type", "src_ip", "dst_ip", "flow_count", "gold_label", "ts_start_min")
    at = work_folder(spark)
    tables.write_jsonl(u, f"{at}/lines")
    tables.jsonl(spark, f"{at}/lines", u.schema, "eval_unit_id", ["eval_unit_id", "unit_type"]).write.format("noop").mode("overwrite").save()
    tables.mirror_parquet(spark, f"{at}/lines", f"{at}/mirror")
    return spark.read.parquet(f"{at}/mirror").select(u.columns)


@query("SELECT report_id, plan_id, mode, total_selected FROM sample_reports")
def report_documents(spark, d):  # S6 K5 K7
    """Reports as JSON documents in run folders, and one that is broken, read back."""
    at = work_folder(spark)
    rows = table(spark, d, "sample_reports").select("report_id", "plan_id", "mode", "total_selected").limit(10_001).collect()  # a report a run
    if len(rows) > 10_000:
        raise ValueError("more than 10 000 reports")
    for r in rows:
        artifacts.write_json(spark, artifacts.run_files(at, f"run{r.report_id}")["summary_json"], r.asDict())
    artifacts.write_text(spark, artifacts.run_files(at, "broken")["summary_json"], "{")
    found = tables.json_documents(spark, f"{at}/*/summary.json")
    return found.select(F.from_json("value", "report_id long, plan_id long, mode string, total_selected long").alias("r")).select("r.*")


@query("SELECT count(*) AS flows, count(DISTINCT (src_ip, dst_ip)) AS pairs, count(DISTINCT src_ip) + max(CASE WHEN src_ip IS NULL THEN 1 ELSE 0 END) AS hosts FROM flows")
def index_counts(spark, d):  # D1 D2 D4 K3 H7 H8
    """The index of the raw flows, built, found complete and opened: what its manifest counts."""
    raw = f"{work_folder(spark)}/raw"
    tables.write_parquet(_raw(spark, d), raw)
    out = f"{work_folder(spark)}/index"
    path = build.build_index(spark, [raw], out, _config(spark, d), build.Args("d", K, WINDOW_MIN, MAX_FLOWS))
    if build.build_index(spark, [raw], out, _config(spark, d), build.Args("d", K, WINDOW_MIN, MAX_FLOWS)) != path:
        raise AssertionError("the same flows must give the same index")
    counts = build.manifest(spark, path)["counts"]
    return spark.createDataFrame([(counts["flows"], counts["pairs"], counts["hosts"])], "flows long, pairs long, hosts long")


_SUBMITTED = [
    "CASE WHEN flow_count % 7 = 0 THEN 'unsure' ELSE 'malicious' END AS verdict", "coalesce(malicious_flow_count, 0) / 10.0 AS confidence",
    "CASE WHEN flow_count % 11 = 0 THEN '' ELSE repeat('r', CAST(coalesce(flow_count, 0) AS INT) * 100 + 1) END AS rationale",
]


@query(f"""WITH s AS (SELECT eval_unit_id, {', '.join(_SUBMITTED)}, CASE WHEN distinct_destinations % 5 = 0 THEN list_transform(flow_ids, lambda x: -x) ELSE flow_ids END AS indices, CASE WHEN src_ip = dst_ip OR flow_count % 2 = 0 THEN [src_ip, src_ip] ELSE [src_ip] END AS destinations FROM eval_units)
SELECT eval_unit_id, CASE WHEN verdict <> 'malicious' THEN 'verdict' WHEN confidence > 1 THEN 'confidence' WHEN length(rationale) NOT BETWEEN 1 AND 8000 THEN 'rationale' WHEN list_min(indices) < 0 THEN 'negative index'
WHEN len(list_distinct(indices)) <> len(indices) THEN 'repeated index' WHEN len(destinations) = 2 THEN 'repeated destination' END AS fault FROM s""")
def submission_faults(spark, d):  # U7 D23 G4
    e = table(spark, d, "eval_units")
    ids = F.when(F.col("distinct_destinations") % 5 == 0, F.transform("flow_ids", lambda x: -x)).otherwise(F.col("flow_ids")).alias("indices")
    dst = F.when((F.col("src_ip") == F.col("dst_ip")) | (F.col("flow_count") % 2 == 0), F.array("src_ip", "src_ip")).otherwise(F.array("src_ip")).alias("destinations")
    s = e.select("eval_unit_id", *map(F.expr, _SUBMITTED), ids, dst)
    return scoring.checked_submissions(s).select("eval_unit_id", "fault")


# ---- sampling of raw flows, lint -----------------------------------------------------------------------------------


_BAD = "coalesce(lower(CAST(_attack_label AS VARCHAR(99))), '') NOT IN ('', 'benign')"


@query(f"""WITH f AS (SELECT _flow_id, any_value(_attack_label) AS _attack_label, any_value(bytes_in) AS bytes_in FROM flows WHERE _flow_id IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY {_BAD} ORDER BY md5('{SEED}|' || _flow_id), _flow_id) AS rn FROM f) SELECT _flow_id, _attack_label, bytes_in FROM r WHERE rn <= CASE WHEN {_BAD} THEN 400 ELSE 600 END""")
def class_balanced_sample(spark, d):  # D25 P15 P16 O11 U1
    f = table(spark, d, "flows").select("_flow_id", "_attack_label", "bytes_in").where("_flow_id is not null").dropDuplicates(["_flow_id"])
    return strata.class_balanced(f, F.expr(_BAD), 1000, 0.4, SEED, "_flow_id")


def _lint_sql() -> str:
    rules = lint.patterns([*tools.GROUND_TRUTH, *lint.LABELS], lint.FAMILIES)
    pick = lambda f: " ".join(f"WHEN regexp_matches(text, '{p}') THEN {f(n, p)}" for n, p in rules)
    name, match, at = pick(lambda n, p: f"'{n}'"), pick(lambda n, p: f"regexp_extract(text, '{p}')"), pick(lambda n, p: f"length(regexp_extract(text, '(?s)^(.*?)(?:{p})', 1))")
    return f"SELECT * FROM (SELECT doc_id, CASE {name} END AS pattern, CASE {match} END AS matched, CAST(CASE {at} END AS INTEGER) AS at FROM documents) WHERE pattern IS NOT NULL"


@query(_lint_sql())
def forbidden_tokens(spark, d):  # G7
    return lint.forbidden(table(spark, d, "documents"), families=lint.FAMILIES)


@query(f"WITH {CANON} SELECT src_ip, CAST(floor(ts_start / 300) * 300000000 AS BIGINT) AS window_us, count(*) AS flow_count, count(DISTINCT dst_ip) AS distinct_destinations FROM b GROUP BY ALL")
def fanout_windows(spark, d):  # batch side of the streaming fan-out monitor
    f = flows(spark, d).withColumn("window_us", F.floor(epoch_us(F.col("ts_start")) / 300_000_000) * 300_000_000)
    by = f.groupBy("src_ip", "window_us", "dst_ip").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("src_ip", "window_us").agg(F.sum("n").alias("flow_count"), F.count(F.lit(1)).alias("distinct_destinations"))
