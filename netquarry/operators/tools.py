"""The read-only investigative queries, as table functions over an index.

A tool takes validated arguments and returns a lazy DataFrame. Its schema is
checked for label-derived columns before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions.hashing import hash_obj

#: Fixed value: columns that would give the ground truth away.
GROUND_TRUTH = frozenset({
    "_is_malicious", "is_malicious", "attack_label", "_attack_label", "attack_type", "_numeric_label", "numeric_label", "malicious_flow_count", "distinct_malicious_destinations", "gold_label",
})
#: How pairs can be listed: column and direction by sort key.
PAIR_ORDER = {
    "flow_count": ("flow_count", "desc"), "bytes_total": ("bytes_total", "desc"), "pkts_total": ("pkts_total", "desc"), "distinct_dst_ports": ("distinct_dst_ports", "desc"), "ts_start": ("ts_start_min", "asc"),
}


class LeakError(RuntimeError):
    pass


class ToolError(ValueError):
    pass


class Index:
    """The tables that the tools read: flows (flow_id, src_ip, dst_ip, ... is_malicious), pair_stats and hosts_rollup, each given as a table or as what makes it when it is first asked for."""

    def __init__(self, flows: DataFrame | Callable[[], DataFrame], pair_stats: DataFrame | Callable[[], DataFrame], hosts_rollup: DataFrame | Callable[[], DataFrame]):
        self._tables: dict[str, DataFrame | Callable[[], DataFrame]] = {"flows": flows, "pair_stats": pair_stats, "hosts_rollup": hosts_rollup}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found


def assert_no_leak(schema: T.DataType, path: str = "$") -> None:
    """Raises LeakError if a field of the schema, however nested, bears a ground-truth name."""
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            if f.name in GROUND_TRUTH:
                raise LeakError(f"label-derived column at {path}.{f.name}")
            assert_no_leak(f.dataType, f"{path}.{f.name}")
    elif isinstance(schema, T.ArrayType):
        assert_no_leak(schema.elementType, f"{path}[]")
    elif isinstance(schema, T.MapType):
        assert_no_leak(schema.valueType, f"{path}{{}}")


def clamp(asked: int | None, default: int, cap: int) -> int:
    return max(1, min(default if asked is None else asked, cap))


def _last(c: str, way: str):
    return F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last()


def _where(df: DataFrame, **equal: str | None) -> DataFrame:
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def list_pairs(ix: Index, src_ip=None, dst_ip=None, sort="flow_count", limit=None) -> DataFrame:
    cols = ["src_ip", "dst_ip", "flow_count", "ts_start_min", "ts_start_max", "bytes_total", "pkts_total", "distinct_dst_ports", "distinct_src_ports", "distinct_protocols"]
    return _where(ix.pair_stats, src_ip=src_ip, dst_ip=dst_ip).select(cols).orderBy(_last(*PAIR_ORDER[sort]), _last("src_ip", "asc"), _last("dst_ip", "asc")).limit(clamp(limit, 20, 200))


def get_pair_timeline(ix: Index, src_ip, dst_ip, offset=0, limit=None) -> DataFrame:
    cols = ["flow_id", "ts_start", "protocol", "src_port", "dst_port", "bytes_in", "bytes_out", "pkts_in", "pkts_out", "tcp_flags", "flow_duration_ms"]
    return _where(ix.flows, src_ip=src_ip, dst_ip=dst_ip).select(cols).orderBy("ts_start", "flow_id").offset(offset).limit(clamp(limit, 50, 500))


def pair_timeline_total(ix: Index, src_ip, dst_ip) -> DataFrame:
    return _where(ix.flows, src_ip=src_ip, dst_ip=dst_ip).agg(F.count(F.lit(1)).alias("total_flows_in_pair"))


def get_flows(ix: Index, flow_ids) -> DataFrame:
    cols = ["flow_id", "src_ip", "dst_ip", "ts_start", "protocol", "src_port", "dst_port", "bytes_in", "bytes_out", "pkts_in", "pkts_out", "tcp_flags", "flow_duration_ms"]
    return ix.flows.where(F.col("flow_id").isin([int(i) for i in flow_ids])).select(cols).orderBy("flow_id")


def missing_flow_ids(ix: Index, flow_ids) -> DataFrame:
    """(position, flow_id) of requested ids that are not there, in request order, repeats kept."""
    asked = ix.flows.sparkSession.createDataFrame([(i, int(f)) for i, f in enumerate(flow_ids)], "position int, flow_id long")
    there = ix.flows.where(F.col("flow_id").isin([int(i) for i in flow_ids])).select("flow_id")
    return asked.join(there, "flow_id", "left_anti").select("position", "flow_id").orderBy("position")


def host_rollup(ix: Index, host) -> DataFrame:
    cols = ["flow_count", "distinct_destinations", "bytes_out_total", "bytes_in_total", "pkts_out_total", "pkts_in_total", "ts_start_min", "ts_start_max", "distinct_dst_ports", "distinct_protocols"]
    return ix.hosts_rollup.where(F.col("host") == host).select("host", *cols)


def pair_stats(ix: Index, src_ip, dst_ip) -> DataFrame:
    cols = ["flow_count", "bytes_total", "pkts_total", "distinct_dst_ports", "distinct_src_ports", "distinct_protocols", "ts_start_min", "ts_start_max"]
    return _where(ix.pair_stats, src_ip=src_ip, dst_ip=dst_ip).select("src_ip", "dst_ip", *cols)


def top_destinations(ix: Index, host, limit=None) -> DataFrame:
    cols = ["dst_ip", "flow_count", "bytes_total", "pkts_total", "distinct_dst_ports", "distinct_protocols", "ts_start_min", "ts_start_max"]
    return _where(ix.pair_stats, src_ip=host).select(cols).orderBy(_last("flow_count", "desc"), _last("dst_ip", "asc")).limit(clamp(limit, 10, 100))


def port_proto_matrix(ix: Index, scope=None, limit=None) -> DataFrame:
    m = _where(ix.flows, **(scope or {})).groupBy("dst_port", "protocol").agg(F.count(F.lit(1)).alias("flow_count"), F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("bytes_total"))
    return m.orderBy(_last("flow_count", "desc"), _last("dst_port", "asc"), _last("protocol", "asc")).limit(clamp(limit, 50, 500))


def rarity_stats(ix: Index, scope=None, limit=None) -> DataFrame:
    """(kind, value, flow_count): the rarest destination ports and the rarest destinations of a scope, `limit` of each; values as text, ports in numeric order among equals."""
    f, n = _where(ix.flows, **(scope or {})), clamp(limit, 20, 200)

    def tail(column: str, kind: str) -> DataFrame:
        r = f.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("flow_count")).orderBy("flow_count", _last("value", "asc")).limit(n)
        return r.select(F.lit(kind).alias("kind"), F.col("value").cast("string").alias("value"), "flow_count")

    return tail("dst_port", "rarest_dst_ports").unionByName(tail("dst_ip", "rarest_dst_ips"))


def submit_assessment(ix: Index, verdict, confidence, rationale, malicious_flow_indices=(), malicious_destinations=()) -> DataFrame:
    """The submission as a row, if it is valid; nothing is repaired."""
    if verdict not in ("malicious", "benign") or not 0 <= confidence <= 1:
        raise ToolError("verdict or confidence out of range")
    if not 1 <= len(rationale) <= 8000:
        raise ToolError("the rationale must have 1 to 8 000 characters")
    for name, v in (("malicious_flow_indices", malicious_flow_indices), ("malicious_destinations", malicious_destinations)):
        if len(set(v)) != len(v):
            raise ToolError(f"{name} repeats a value")
    row = (verdict, float(confidence), [int(i) for i in malicious_flow_indices], list(malicious_destinations), rationale)
    return ix.flows.sparkSession.createDataFrame([row], "verdict string, confidence double, malicious_flow_indices array<long>, malicious_destinations array<string>, rationale string")


#: Kinds of arguments. Indices are flow ids without a bound on their number; a scope holds some of the named addresses.
TEXT, COUNT, LIMIT, IDS, INDICES, NAMES, SHARE, SCOPE_SRC, SCOPE_PAIR = "text", "count", "limit", "ids", "indices", "names", "share", "scope of src_ip", "scope of src_ip, dst_ip"


@dataclass(frozen=True)
class Tool:
    name: str
    call: Callable[..., DataFrame]
    needs: dict[str, str]
    takes: dict[str, object]


def _is(value, kind) -> bool:
    if isinstance(kind, (tuple, frozenset)):
        return value in kind
    number = isinstance(value, int) and not isinstance(value, bool)
    ids = isinstance(value, (list, tuple)) and all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in value)
    scope = lambda names: isinstance(value, dict) and set(value) <= names and all(isinstance(v, str) for v in value.values())
    return {
        TEXT: isinstance(value, str),
        COUNT: number and value >= 0,
        LIMIT: number and value >= 1,
        SHARE: (number or isinstance(value, float)) and 0 <= value <= 1,
        IDS: ids and 1 <= len(value) <= 500,
        INDICES: ids,
        NAMES: isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value),
        SCOPE_SRC: scope({"src_ip"}),
        SCOPE_PAIR: scope({"src_ip", "dst_ip"}),
    }[kind]


def _plain(kind) -> object:
    return sorted(kind) if isinstance(kind, (tuple, frozenset)) else kind


class Registry:
    def __init__(self):
        self._tools: dict[str, Tool] = {}
        self._allowed: dict[str, frozenset[str]] = {}

    def add(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ToolError(f"{tool.name} is registered twice")
        self._tools[tool.name] = tool

    def names(self) -> list[str]:
        return list(self._tools)

    def allow(self, persona: str, names: list[str]) -> None:
        if unknown := sorted(set(names) - set(self._tools)):
            raise ToolError(f"no such tools: {unknown}")
        self._allowed[persona] = frozenset(names)

    def allowed(self, persona: str) -> frozenset[str]:
        if persona not in self._allowed:
            raise RuntimeError(f"{persona} has no allowlist")
        return self._allowed[persona]

    def manifest_hash(self) -> str:
        """Hash of every tool's arguments and of who may use which tool; any change of either changes it."""
        shown = {n: {"needs": {k: _plain(v) for k, v in t.needs.items()}, "takes": {k: _plain(v) for k, v in t.takes.items()}} for n, t in self._tools.items()}
        return hash_obj({"tools": shown, "persona_allowlist": {p: sorted(names) for p, names in self._allowed.items()}})

    def allowlist(self, spark: SparkSession) -> DataFrame:
        """(persona, tool) of every permission."""
        return spark.createDataFrame(sorted((p, n) for p, names in self._allowed.items() for n in names), "persona string, tool string")

    def call(self, ix: Index, name: str, persona: str | None = None, **args) -> DataFrame:
        tool = self._tools.get(name)
        if tool is None or persona is not None and name not in self.allowed(persona):
            raise ToolError(f"{name} is not to be had")
        kinds = tool.needs | tool.takes
        if bad := sorted(set(args) - set(kinds)) + sorted(set(tool.needs) - set(args)):
            raise ToolError(f"{name}: unknown or missing {bad}")
        for k, v in args.items():
            if not _is(v, kinds[k]):
                raise ToolError(f"{name}: {k} is not {kinds[k]}")
        out = tool.call(ix, **args)
        assert_no_leak(out.schema)
        return out

    def smoke(self, ix: Index, persona: str) -> dict[str, str]:
        """Runs each allowed tool once on the busiest pair; tells what failed and never halts."""
        top = list_pairs(ix, limit=1).first()
        if top is None:
            return {}
        ids = [r.flow_id for r in ix.flows.select("flow_id").orderBy("flow_id").limit(5).collect()]
        known = {"src_ip": top.src_ip, "dst_ip": top.dst_ip, "host": top.src_ip, "flow_ids": ids, "verdict": "benign", "confidence": 0.3, "rationale": "smoke"}
        said = {}
        for name in sorted(self.allowed(persona)):
            try:
                self.call(ix, name, persona, **{k: known[k] for k in self._tools[name].needs}).limit(1).collect()
                said[name] = "ok"
            except Exception as e:
                said[name] = f"{type(e).__name__}: {e}"
        return said


def registry() -> Registry:
    r = Registry()
    for t in (
        Tool("list_pairs", list_pairs, {}, {"src_ip": TEXT, "dst_ip": TEXT, "sort": tuple(PAIR_ORDER), "limit": LIMIT}),
        Tool("get_pair_timeline", get_pair_timeline, {"src_ip": TEXT, "dst_ip": TEXT}, {"offset": COUNT, "limit": LIMIT}),
        Tool("get_flows", get_flows, {"flow_ids": IDS}, {}),
        Tool("host_rollup", host_rollup, {"host": TEXT}, {}),
        Tool("pair_stats", pair_stats, {"src_ip": TEXT, "dst_ip": TEXT}, {}),
        Tool("top_destinations", top_destinations, {"host": TEXT}, {"limit": LIMIT}),
        Tool("port_proto_matrix", port_proto_matrix, {}, {"scope": SCOPE_PAIR, "limit": LIMIT}),
        Tool("rarity_stats", rarity_stats, {}, {"scope": SCOPE_SRC, "limit": LIMIT}),
        Tool("submit_assessment", submit_assessment, {"verdict": ("malicious", "benign"), "confidence": SHARE, "rationale": TEXT}, {"malicious_flow_indices": INDICES, "malicious_destinations": NAMES}),
    ):
        r.add(t)
    return r


def checked_calls(calls: DataFrame, r: Registry) -> DataFrame:
    """calls(persona, tool, ...) with `allowed`: whether the persona may use the tool. Unknown tools and personas, and nulls, may not."""
    permitted = r.allowlist(calls.sparkSession).withColumn("_ok", F.lit(True))
    return calls.join(F.broadcast(permitted), ["persona", "tool"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")
