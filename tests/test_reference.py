"""Hand-computed cases of the index, tool, scoring, sampling and rollup operators."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from netquarry.functions import hashing
from netquarry.functions.columns import gold_label, n_unique, sum0
from netquarry.operators import costs, index, lint, normalize, scoring, strata, summary, tools
from netquarry.plans import reference
from netquarry.sources import tables
from netquarry.streaming import monitor

FLOW = "flow_id long, src_ip string, dst_ip string, ts_start double, protocol string, src_port long, dst_port long, bytes_in double, bytes_out double, pkts_in double, pkts_out double, tcp_flags string, flow_duration_ms double, is_malicious boolean"


def scanner_flows(spark):
    """8 quiet pairs, 2 single-target attacks and one scanner with 12 destinations: 72 flows, 22 pairs, 11 hosts."""
    r = random.Random(7)
    rows, ts = [], 1_700_000_000.0

    def add(src, dst, step, bad):
        nonlocal ts
        rows.append((len(rows), src, dst, ts, "TCP" if r.random() < 0.7 else "UDP", r.randrange(1024, 60000), r.choice([80, 443, 22]), float(r.randrange(80, 5000)), 7.0, 1.0, 2.0, "S", 5.0, bad))
        ts += step

    for i in range(8):
        for _ in range(5):
            add(f"10.0.0.{i}", f"10.0.1.{i}", 1.0, False)
    for i in range(2):
        for _ in range(4):
            add(f"10.0.10.{i}", f"10.0.20.{i}", 1.0, True)
    for i in range(12):
        for _ in range(2):
            add("10.0.99.99", f"10.0.30.{i}", 0.5, True)
    return spark.createDataFrame(rows, FLOW)


def test_index_shape(spark):
    f = scanner_flows(spark)
    assert (f.count(), index.pair_stats(f).count(), index.hosts(f).count()) == (72, 22, 11)
    wide = index.units(index.unit_bridge(f, 10, 5, 1000)).collect()
    assert sorted((u.unit_type, u.gold_label) for u in wide) == [("host_egress", "malicious")] + [("pair_timeline", "benign")] * 8 + [("pair_timeline", "malicious")] * 2
    assert next(u for u in wide if u.unit_type == "host_egress").distinct_destinations == 12
    none = index.units(index.unit_bridge(f, 100, 5, 1000))
    assert none.where("unit_type = 'host_egress'").count() == 0 and none.count() == 22


def test_chunks_keep_every_flow_once(spark):
    f = scanner_flows(spark)
    u = index.units(index.unit_bridge(f, 10, 5, 3, partitions=4)).collect()
    ids = [i for x in u for i in x.flow_ids]
    assert sorted(ids) == list(range(72)) and max(len(x.flow_ids) for x in u) == 3
    assert index.units(index.unit_bridge(f, 10, 5, 0)).count() == 11
    named = index.with_unit_ids(index.units(index.unit_bridge(f, 10, 5, 0))).collect()
    assert len({x.eval_unit_id for x in named}) == 11 and {x.eval_unit_id[:3] for x in named} == {"pt-", "he-"}


def test_flow_ids_are_contiguous(spark):
    f = scanner_flows(spark).drop("flow_id")
    got = index.assign_flow_ids(f.unionByName(f.limit(3)), partitions=4).orderBy("flow_id").collect()
    assert [r.flow_id for r in got] == list(range(75))
    assert [r.ts_start for r in got] == sorted(r.ts_start for r in got)


def test_hosts_agree_with_the_wide_rollup(spark):
    f = scanner_flows(spark)
    a = {r.host: (r.flow_count, r.distinct_destinations, r.bytes_in_total) for r in index.hosts(f).collect()}
    b = {r.host: (r.flow_count, r.distinct_destinations, r.bytes_in_total) for r in index.hosts_rollup(f).collect()}
    assert a == b and sum(v[0] for v in a.values()) == 72


def test_null_conventions(spark):
    df = spark.createDataFrame([(2, None), (None, None), (2, None)], "a int, b double")
    r = df.agg(n_unique(F.col("a")).alias("n"), sum0(F.col("b")).alias("s")).first()
    assert (r.n, r.s) == (2, 0.0)
    rows = spark.createDataFrame([(0, 5), (4, 5), (3, 5), (5, 5)], "m long, n long")
    assert [r.g for r in rows.select(gold_label(F.col("m"), F.col("n")).alias("g")).collect()] == ["benign", "malicious", "mixed", "malicious"]


# ---- normalisation

COLUMNS = {"IPV4_SRC_ADDR": "a", "IPV4_DST_ADDR": "b", "timestamp": 1_700_000_000_000, "PROTOCOL": "TCP", "L4_SRC_PORT": 1.5, "l4_dst_port": 2.5, "IN_BYTES": 1, "OUT_BYTES": 2, "IN_PKTS": 3, "OUT_PKTS": 4, "dur": 9.0, "rate": None}
CONFIG = normalize.Config(aliases={"src_ip": ("src_ip", "IPV4_SRC_ADDR"), "dst_ip": ("IPV4_DST_ADDR",), "ts_start": ("ts_start", "timestamp"), "protocol": ("protocol",), "src_port": ("L4_SRC_PORT",), "dst_port": ("L4_DST_PORT",), "bytes_in": ("IN_BYTES",), "bytes_out": ("OUT_BYTES",), "pkts_in": ("IN_PKTS",), "pkts_out": ("OUT_PKTS",), "tcp_flags": ("flags",), "flow_duration_ms": ("dur",), "sampling_rate": ("rate",)})


def raw(spark, **extra):
    cols = COLUMNS | extra
    df = spark.createDataFrame([(1,)], "x int")
    types = {int: "long", float: "double", str: "string", bool: "boolean", type(None): "long"}
    return df.select(*[F.lit(v).cast(types[type(v)]).alias(k) for k, v in cols.items()])


@pytest.mark.parametrize("extra,label,bad,number", [
    ({}, "benign", False, None),
    ({"Label": 1}, "malicious", True, 1),
    ({"Attack": "Benign", "Label": 1}, "Benign", False, 1),
    ({"Attack": "   "}, "benign", True, None),
    ({"attack": " Scan "}, "Scan", True, None),
    ({"Attack": ""}, "benign", False, None),
])
def test_labels(spark, extra, label, bad, number):
    r = normalize.normalize(raw(spark, **extra), CONFIG).first()
    assert (r._attack_label, r._is_malicious, r._numeric_label) == (label, bad, number)
    assert (r.ts_start, r.src_port, r.dst_port, r.tcp_flags, r.sampling_rate) == (1_700_000_000.0, 2, 2, "", 1)


def test_missing_and_clashing_columns(spark):
    with pytest.raises(ValueError, match="src_ip"):
        normalize.normalize(raw(spark).drop("IPV4_SRC_ADDR"), CONFIG)
    assert normalize.resolve(["a", "B", "b"], ("x", "b")) == 2
    r = normalize.normalize(raw(spark, c0=5, _attack_label=1), CONFIG).first()
    assert r.src_ip == "a" and r._attack_label == "benign"


def test_seconds_by_median(spark):
    df = raw(spark).withColumn("ts_start", F.lit(1_700_000_000.0))
    assert normalize.normalize(df, CONFIG).first().ts_start == 1_700_000_000.0


# ---- tools


@pytest.fixture(scope="module")
def ix(spark):
    f = scanner_flows(spark)
    return tools.Index(f, index.pair_stats(f), index.hosts_rollup(f))


def test_registry(ix):
    r = tools.registry()
    r.allow("analyst", ["list_pairs", "get_flows", "submit_assessment", "host_rollup", "rarity_stats"])
    assert set(r.smoke(ix, "analyst").values()) == {"ok"}
    for call in (
        lambda: r.call(ix, "pair_stats", "analyst", src_ip="a", dst_ip="b"),
        lambda: r.call(ix, "list_pairs", sort="gold_label"),
        lambda: r.call(ix, "list_pairs", surprise=1),
        lambda: r.call(ix, "get_pair_timeline", src_ip="a"),
        lambda: r.call(ix, "get_flows", flow_ids=[True]),
        lambda: r.add(tools.Tool("list_pairs", tools.list_pairs, {}, {})),
        lambda: r.allow("x", ["nothing"]),
        lambda: r.call(ix, "get_flows", flow_ids=[]),
        lambda: r.call(ix, "get_flows", flow_ids=list(range(501))),
        lambda: r.call(ix, "get_flows", flow_ids=[-1]),
        lambda: r.call(ix, "list_pairs", limit=0),
        lambda: r.call(ix, "rarity_stats", scope={"dst_ip": "x"}),
        lambda: r.call(ix, "submit_assessment", verdict="benign", confidence=0.5, rationale="r", malicious_flow_indices=[1, 1]),
        lambda: r.call(ix, "submit_assessment", verdict="benign", confidence=0.5, rationale=""),
        lambda: r.call(ix, "submit_assessment", verdict="benign", confidence=0.5, rationale="x" * 8001),
        lambda: r.call(ix, "submit_assessment", verdict="benign", confidence=0.5),
    ):
        with pytest.raises(tools.ToolError):
            call()
    with pytest.raises(RuntimeError):
        r.allowed("stranger")
    assert r.call(ix, "submit_assessment", verdict="malicious", confidence=1, rationale="r", malicious_flow_indices=list(range(600))).count() == 1
    before = r.manifest_hash()
    r.allow("other", ["get_flows"])
    assert before != r.manifest_hash() and {tuple(x) for x in r.allowlist(ix.flows.sparkSession).where("persona = 'other'").collect()} == {("other", "get_flows")}


def test_tools_never_leak(ix):
    r = tools.registry()
    r.add(tools.Tool("open_book", lambda ix: ix.pair_stats, {}, {}))
    with pytest.raises(tools.LeakError, match="malicious_flow_count"):
        r.call(ix, "open_book")
    nested = ix.flows.select(F.array(F.struct(F.lit(1).alias("gold_label"))).alias("x"))
    with pytest.raises(tools.LeakError, match=r"\$\.x\[\]\.gold_label"):
        tools.assert_no_leak(nested.schema)


def test_tool_results(ix):
    assert [r.flow_id for r in tools.get_flows(ix, [3, 1, 500]).collect()] == [1, 3]
    assert [tuple(r) for r in tools.missing_flow_ids(ix, [900, 1, 900]).collect()] == [(0, 900), (2, 900)]
    assert tools.pair_timeline_total(ix, "10.0.0.1", "10.0.1.1").first()[0] == 5
    assert [r.flow_id for r in tools.get_pair_timeline(ix, "10.0.0.1", "10.0.1.1", 3, 50).collect()] == [8, 9]
    assert tools.top_destinations(ix, "10.0.99.99", 3).count() == 3
    assert tools.host_rollup(ix, "nowhere").count() == 0
    assert tools.clamp(None, 20, 200) == 20 and tools.clamp(0, 20, 200) == 1 and tools.clamp(999, 20, 200) == 200


# ---- scoring

SUB = "provider string, persona string, unit string, verdict string, indices array<long>, destinations array<string>, observed_ids array<long>, observed_dsts array<string>"
BRIDGE = "unit string, flow_id long, src_ip string, dst_ip string, is_malicious boolean"


@pytest.mark.parametrize("flows,ids,dsts,seen,seen_dst,verdict,want", [
    ([(0, "A", "X", True), (1, "A", "X", False), (2, "A", "Y", True)], [0, 2], [], None, None, "malicious", ([0, 2], 1.0, 1.0, 1.0, None)),
    ([(0, "A", "X", True), (1, "A", "X", False), (2, "A", "Y", True)], [0], [], None, None, "malicious", ([0], 2 / 3, 2 / 3, 1.0, None)),
    ([(0, "A", "X", True), (1, "A", "X", False)], [0, 999], [], None, None, "malicious", ([0], 1.0, 1.0, 1.0, None)),
    ([(0, "A", "X", False)], [], [], None, None, "benign", ([], 1.0, 1.0, 1.0, None)),
    ([(0, "A", "X", False), (1, "A", "Y", False)], [0], [], None, None, "benign", ([0], 0.0, 0.0, 0.0, "verdict_indices_mismatch")),
    ([(0, "A", "X", False), (1, "A", "X", False), (2, "A", "Y", True), (3, "A", "Y", True)], [], ["Y"], None, None, "malicious", ([2, 3], 1.0, 1.0, 1.0, None)),
    ([(0, "A", "X", True), (1, "A", "Y", True), (2, "A", "Y", True)], [0], ["Y"], None, None, "malicious", ([0, 1, 2], 1.0, 1.0, 1.0, None)),
    ([(2, "A", "Y", True)], [2], [], [0, 1], None, "malicious", ([], 0.0, 0.0, 0.0, "verdict_indices_mismatch")),
    ([(2, "A", "Y", True)], [2], [], [0, 1, 2], None, "malicious", ([2], 1.0, 1.0, 1.0, None)),
    ([(2, "A", "Y", True)], [], ["Y"], None, [], None, ([], 0.0, 0.0, 0.0, None)),
    ([(2, "A", "Y", True)], [], ["Y"], [], ["Y"], "malicious", ([2], 1.0, 1.0, 1.0, None)),
])
def test_scores(spark, flows, ids, dsts, seen, seen_dst, verdict, want):
    b = scoring.unit_sets(spark.createDataFrame([("u", *f) for f in flows] + [("other", 999, "A", "Y", True)], BRIDGE))
    s = spark.createDataFrame([("p", "q", "u", verdict, ids, dsts, seen, seen_dst)], SUB)
    assert sorted(r.flow_id for r in scoring.resolved(s, b).collect()) == want[0]
    r = scoring.scored(s, b).first()
    assert (pytest.approx(r.per_flow_f1), pytest.approx(r.per_pair_f1), pytest.approx(r.per_host_f1), r.defect) == want[1:]


SCORED = "provider string, persona string, unit_type string, gold_label string, valid boolean, verdict string, confidence double, per_flow_f1 double, per_pair_f1 double, per_host_f1 double, per_flow_precision double, per_flow_recall double, defect string, wall_time_ms long"


def test_rollups(spark):
    row = lambda t, g, ok, v, c, f, h: ("p", "q", t, g, ok, v, c, f, f, h, f, f, None, 10)
    s = spark.createDataFrame([row("host_egress", "malicious", True, "malicious", 0.9, 0.0, 1.0), row("pair_timeline", "mixed", True, "benign", 0.6, 0.4, 0.0), row("pair_timeline", "malicious", False, None, None, 0.0, 0.0), row("pair_timeline", "benign", True, "malicious", 0.5, 0.0, 0.0), row("pair_timeline", "benign", True, "benign", 0.8, 1.0, 1.0)], SCORED)
    v = summary.verdict_confusion(s).first()
    assert (v.tp, v.fp, v.tn, v.fn) == (1, 1, 1, 1) and v.coverage_adjusted_recall == pytest.approx(1 / 3) and v.f1 == 0.5
    c = summary.confidence(s).first()
    assert (c.n, pytest.approx(c.mean), pytest.approx(c.mean_correct), pytest.approx(c.mean_incorrect)) == (4, 0.7, 0.85, 0.55)
    e = summary.score_entry(s).first()
    assert e.units == 5 and e.units_scored == 4 and e.native_lens_f1 == pytest.approx((1.0 + 0.4 + 0 + 1) / 4) and e.first_pass_valid_rate == 0.8
    none = summary.verdict_confusion(s.where("gold_label = 'benign' and verdict = 'benign'")).first()
    assert (none.precision, none.recall, none.f1, none.coverage_adjusted_recall, none.accuracy) == (None, None, None, None, 1.0)


def test_latency_is_nearest_rank(spark):
    df = spark.createDataFrame([("p", "q", v) for v in [5, 1, 1, 9, 3, None]] + [("p", "r", 4)], "provider string, persona string, wall_time_ms long")
    got = {r.persona: (r["count"], r.mean, r.p50, r.p95, r["max"]) for r in summary.latency(df).collect()}
    assert got == {"q": (5, 3, 1, 9, 9), "r": (1, 4, 4, 4, 4)}


def test_runs(spark):
    meta = spark.createDataFrame(
        [("r1", "h", 7, "main"), ("r3", "h", 7, "main"), ("r4", "other", 7, "main"), ("r5", "h", 8, "main"), ("r6", "h", 7, "strange"), ("r7", "h", 7, "main"), ("r2", "h", 7, "tools_off"), (None, "h", 7, "main")],
        "run_id string, dataset_hash string, sample_seed long, ablation string",
    )
    summaries = spark.createDataFrame([(f"r{i}",) for i in range(1, 7)], "run_id string")
    runs = summary.comparable_runs(meta, summaries, "h", 7)
    assert {tuple(r) for r in runs.collect()} == {("main", "r3"), ("tools_off", "r2")}
    assert {r.ablation for r in summary.missing_tags(runs).collect()} == {"playbooks_off", "single_shot_baseline"}
    s = spark.createDataFrame([("main", "p", "q", 0.8, None), ("x", "p", "q", 0.5000004, 1.0), ("main", "p", "z", 1.0, 1.0)], "ablation string, provider string, persona string, f double, g double")
    assert [tuple(r) for r in summary.ablation_delta(s, ["f", "g"]).collect()] == [("x", "p", "q", "f", 0.3)]
    assert [tuple(r) for r in summary.missing_keys(s).collect()] == [("x", "p", "z")]
    with pytest.raises(LookupError, match="main"):
        summary.ablation_delta(s.where("ablation = 'x'"), ["f"])


def test_costs(spark):
    calls = spark.createDataFrame(
        [("openai", "m", 1000, 400, 500, 100), ("gemini", "m", 10, 400, 5, 1), ("anthropic", "m", 1000, 400, 500, 100), ("openai", "unknown", 1000, None, 500, 100)],
        "provider string, model string, prompt_tokens long, cached_tokens long, output_tokens long, reasoning_tokens long",
    )
    clean = {(r.provider, r.model): tuple(r[c] for c in costs.CLASSES) for r in costs.normalized_tokens(calls).collect()}
    assert clean[("openai", "m")] == (600, 400, 400, 100) and clean[("gemini", "m")] == (0, 400, 5, 1) and clean[("anthropic", "m")] == (1000, 400, 500, 100)
    rates = spark.createDataFrame([("openai", "m", 5.0, 0.5, 20.0, 40.0), ("openai", "m", 4.0, 0.5, 20.0, 40.0), ("anthropic", "m", 1.0, None, 1.0, 1.0)], "provider string, model string, input double, cached_input double, output double, reasoning double")
    cost = {(r.provider, r.model): r.cost_usd for r in costs.priced(costs.normalized_tokens(calls), rates).collect()}
    assert cost[("openai", "m")] == pytest.approx((600 * 5 + 400 * 0.5 + 400 * 20 + 100 * 40) / 1e6) and cost[("openai", "unknown")] == cost[("gemini", "m")] == 0.0
    models = spark.createDataFrame([("openai", "m"), ("gemini", "m")], "provider string, model string")
    got = {r.provider: (r.savings_usd, r.hit_rate) for r in summary.token_totals(calls.where("model = 'm'"), costs.cache_rates(rates, models)).collect()}
    assert got["openai"] == (0.0018, round(400 / 1400, 6)) and got["gemini"][0] == 0.0 and got[None] == (0.0018, round(1200 / 3210, 6))
    p = spark.createDataFrame([("a", 5, 1, 2.0)], "persona string, turns long, calls long, cap double")
    assert {r.provider: (r.turns, r.calls, r.cap) for r in costs.scaled_budgets(p, {"x": 1, "y": 0.5, "z": 0.1}, ("turns", "calls"), "cap").collect()} == {"x": (5, 1, 2.0), "y": (2, 1, 1.0), "z": (1, 1, 0.2)}
    roll = spark.createDataFrame([("x", "a", 2.0, 4), ("x", "b", 1.0, 2), ("y", "a", 1.0, 0)], "provider string, persona string, cost_usd double, renderings long")
    assert {(r.provider, r.persona): r.cost_per_alert for r in costs.cost_per_alert(roll).collect()} == {("x", "a"): 0.5, ("x", "b"): 0.5, ("x", None): 0.5, ("y", "a"): None, ("y", None): None}


def test_unit_order_and_choice(spark):
    u = index.with_unit_ids(index.units(index.unit_bridge(scanner_flows(spark), 10, 5, 3)))
    placed = index.ordered_units(u, 3).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(len(placed)))
    keys = [(r.unit_type, r.src_ip, r.dst_ip or "", r.ts_start_min) for r in placed]
    assert keys == sorted(keys)
    first = [r.eval_unit_id for r in index.chosen_units(u, limit=3).collect()]
    assert first == sorted(r.eval_unit_id for r in placed)[:3] and index.chosen_units(u, unit_id=first[0]).count() == 1
    for bad in ({}, {"unit_id": "x", "limit": 1}, {"limit": 0}):
        with pytest.raises(ValueError):
            index.chosen_units(u, **bad)
    with pytest.raises(LookupError):
        index.chosen_units(u, unit_id="x")
    r = index.assignment_report(u).first()
    assert r.host_egress_hosts == 1 and r.pair_timeline_count + r.host_egress_count == len(placed) == r.benign_units + r.mixed_units + r.malicious_units


def test_scripted_endings(spark):
    rows = [("a", i, 1, i == 3) for i in range(5)] + [("b", i, 1, False) for i in range(9)] + [("c", i, 1, False) for i in range(2)]
    t = spark.createDataFrame(rows, "k string, o int, turns int, submits boolean")
    assert {tuple(r) for r in summary.ended(t, ["k"], "o", {"turns": 4}, "submits").collect()} == {("a", 3, "submitted"), ("b", 4, "turns"), ("c", 1, "exhausted")}


def test_running_totals_and_streaks(spark):
    t = spark.createDataFrame([("a", i, 1, 10.0) for i in range(5)], "k string, o int, turns int, cost double")
    assert tuple(summary.running_caps(t, ["k"], "o", {"turns": 4, "cost": 40.0}).first()) == ("a", 3, "turns")
    e = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, False, False, True, False, False, False])] + [("b", 0, False)], "k string, o int, ok boolean")
    assert [tuple(r) for r in summary.streaks(e, "k", "o", "ok", 3).collect()] == [("a", 6)]
    assert summary.streaks(e, "k", "o", "ok", 0).count() == 0


# ---- sampling


def test_selection(spark):
    rows = [(f"u{i}", *strata.STRATA[i % 5]) for i in range(20)]
    u = spark.createDataFrame(rows, "eval_unit_id string, unit_type string, gold_label string")
    assert strata.select(u, 1, 1).count() == 5
    assert strata.select(u, 1, 1, min_total=8).count() == 8
    capped = strata.select(u, 1, 3, cap=10)
    assert capped.count() == 10
    order = [(r.unit_type, r.gold_label) for r in strata.rotation(strata.select(u, 1, 3)).orderBy("place").collect()]
    assert order == strata.STRATA[:5] * 3
    counts = {(r.unit_type, r.gold_label): (r.available, r.selected) for r in strata.available(u, capped).collect()}
    assert counts[strata.STRATA[5]] == (0, 0) and sum(c for _, c in counts.values()) == 10


def test_sample_report(spark):
    rows = [(f"u{i}", *strata.STRATA[i % 5]) for i in range(20)]
    u = spark.createDataFrame(rows, "eval_unit_id string, unit_type string, gold_label string")
    r = strata.report(u, strata.select(u, 1, 6, cap=10), 6, True).first()
    assert (r.total_selected, r.capped, sum(r.per_stratum_selected.values()), set(r.per_stratum_available.values())) == (10, True, 10, {0, 4})
    assert r.undersampled_strata == [":".join(s) for s in strata.STRATA]
    assert strata.report(u.limit(0), u.limit(0), 1).first().total_selected == 0


# ---- text, hashes, files, streams


def test_lint(spark):
    texts = ["see 10.0.0.1/24", "fe80:0:0:1", "a" * 32, "the gold_label is", "a ddos came", "clean", None, "Gold_Label", "\U0001f600 C++(x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.pattern, r.matched, r.at) for r in lint.forbidden(df, families=["DDoS", "C++(x"]).collect()}
    assert got == {0: ("ipv4_literal", "10.0.0.1/24", 4), 1: ("ipv6_literal", "fe80:0:0:1", 0), 2: ("hex_hash", "a" * 32, 0), 3: ("label_column", "gold_label", 4), 4: ("attack_family", "ddos", 2), 8: ("attack_family", "C++(x", 2)}


def test_too_many_aliases_are_an_error(spark, tmp_path):
    rows = spark.range(10_001).select(F.lit("bytes_in").alias("canonical_name"), F.concat(F.lit("a"), F.col("id")).alias("alias_name"), F.col("id").alias("alias_rank"))
    rows.write.parquet(f"{tmp_path}/over/column_aliases.parquet")
    rows.where("id < 10000").write.parquet(f"{tmp_path}/full/column_aliases.parquet")
    assert len(reference._config(spark, f"{tmp_path}/full").aliases["bytes_in"]) == 10_000
    with pytest.raises(ValueError, match="aliases"):
        reference._config(spark, f"{tmp_path}/over")


def test_forbidden_tokens_has_the_families(spark, tmp_path):
    texts = ["a mirai infection", "SQL injection seen", "ssh-bruteforce", "robots", "gold_label of Mirai"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.pattern, r.matched) for r in reference.forbidden_tokens(spark, str(tmp_path)).collect()}
    assert got == {0: ("attack_family", "mirai"), 1: ("attack_family", "SQL injection"), 2: ("attack_family", "ssh-bruteforce"), 4: ("label_column", "gold_label")}
    assert lint.patterns([], ["a.b"])[-1][1].endswith(r"(?:a\.b)\b")


def test_hashes(tmp_path):
    assert hashing.canonical_json({"b": 1, "a": ["é"]}) == '{"a":["\\u00e9"],"b":1}'
    assert len(hashing.hash_obj([1])) == 32 and hashing.hash_flow_ids([3, 1]) == hashing.hash_flow_ids((1, 3))
    with pytest.raises(TypeError):
        hashing.canonical_json({1, 2})
    parts = {"b": [1], "a": "x"}
    assert hashing.manifest_hash(parts) == hashing.hash_obj({"a": hashing.hash_obj("x"), "b": hashing.hash_obj([1])})
    assert hashing.short_hash("abc") == hashing.digest(b"abc")[:8] and hashing.short_hash([1]) == hashing.hash_obj([1])[:8]
    assert hashing.seed_of("h", 7, "full") == int(hashing.hash_obj({"mode": "full", "sample_seed": 7, "dataset_hash": "h"})[:16], 16)
    at = datetime(2026, 6, 4, 1, 19, 42, tzinfo=UTC)
    assert hashing.run_id(at, "full", "main", ["b", "a"], "0123456789", "ffffff") == "20260604T011942Z_full_main_a+b_01234567_ffffff"
    assert hashing.playbooks_hash({"p": "x"}, "playbooks_off") == hashing.playbooks_hash({}) != hashing.playbooks_hash({"p": "x"})
    p = tmp_path / "x"
    p.write_bytes(b"abc" * 1000)
    assert hashing.hash_file(p, block=7) == hashing.digest(b"abc" * 1000)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, None, 2.5)], "b int, a string, c double")
    tables.write_jsonl(df, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"a":"\\u00e9","b":1,"c":null}', '{"a":null,"b":2,"c":2.5}']
    assert tables.jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    tables.mirror_parquet(spark, str(tmp_path / "j"), str(tmp_path / "p"))
    tables.write_parquet(df, str(tmp_path / "q"))
    assert tables.parquet_files(spark, [str(tmp_path / "q")] * 2).count() == 4
    tables.write_parquet(df.drop("c"), str(tmp_path / "r"))
    with pytest.raises(ValueError, match="'c'"):
        tables.parquet_files(spark, [str(tmp_path / "q"), str(tmp_path / "r")])
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text('{"x":\n1}')
    (tmp_path / "d/b.json").write_text("{broken")
    assert tables.json_documents(spark, str(tmp_path / "d/*.json")).count() == 1


def test_streaming_monitor(spark, tmp_path):
    rows = [(i, "A " if i % 2 else "a", f"d{i % 7}", 1000.0 + i) for i in range(100)] + [(5, "a", "d1", 1005.0), (None, None, None, None), (900, "a", "z", 90_000.0)]
    spark.createDataFrame(rows, "_flow_id long, src_ip string, dst_ip string, ts_start double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("_flow_id long, src_ip string, dst_ip string, ts_start double").parquet(str(tmp_path / "in"))
    q = monitor.to_jsonl(monitor.fanout(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.src_ip, r.flow_count, r.distinct_destinations) for r in got] == [("a", 100, 7)]
    s = monitor.live_sessions(stream, "10 minutes").writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert [r.flow_count for r in spark.table("live").collect()] == [100]


@pytest.mark.parametrize("values", [[], [None], [1.0], [1.0, 2.0], [5.0, 1.0, None, 3.0, float("nan")], [2.0] * 50 + [7.0] * 50, [float(i * i % 97) for i in range(1001)]])
def test_exact_median(spark, values):
    from statistics import median

    df = spark.createDataFrame([(v,) for v in values], "x double")
    clean = [v for v in values if v is not None and v == v]
    for at_once in (1_000_000, 3):
        assert normalize.exact_median(df, F.col("x"), 100, at_once).first().median == (median(clean) if clean else None)
    for bound in (0.5, 1.5, 4.5):
        assert normalize.median_above(df, F.col("x"), bound) == (bool(clean) and median(clean) > bound)


def test_build_index(spark, tmp_path):
    from netquarry.plans import build

    f = scanner_flows(spark).withColumns({"Attack": F.when(F.col("is_malicious"), "Scan").otherwise("benign"), "sampling_rate": F.lit(1)}).drop("flow_id", "is_malicious")
    for i, part in enumerate(f.randomSplit([0.5, 0.5], 3)):
        part.write.parquet(str(tmp_path / f"raw{i}"))
    raw = [str(tmp_path / "raw0"), str(tmp_path / "raw1")]
    config = normalize.Config(aliases={})
    a = build.build_index(spark, raw, str(tmp_path / "ix"), config, build.Args("d", k=10))
    m = build.manifest(spark, a)
    assert m["counts"] == {"flows": 72, "pairs": 22, "hosts": 11, "eval_units": 11}
    assert build.build_index(spark, raw[::-1], str(tmp_path / "ix"), config, build.Args("d", k=10)) == a
    assert build.build_index(spark, raw, str(tmp_path / "ix"), config, build.Args("d", k=100)) != a
    pair = spark.read.parquet(f"{a}/pairs").where("src_ip = '10.0.0.1'").first()
    assert pair.pair_id == hashing.hash_obj([pair.src_ip, pair.dst_ip])[:16] and a.endswith(m["dataset_hash"]) and m["args"]["host_egress_fanout_K"] == 10
    ix = build.open_index(spark, a)
    assert tools.registry().call(ix, "list_pairs", limit=100).count() == 22
    with pytest.raises(FileNotFoundError):
        build.open_index(spark, str(tmp_path / "nothing"))


def test_harvest(spark):
    df = spark.createDataFrame([(1, '{"items":[{"flow_id":3,"dst_ip":"x"},{"flow_id":true,"deep":{"dst_ip":"y","flow_id":3}}]}'), (2, "{no"), (3, None), (4, '{"dst_ip":{"dst_ip":"z"}}'), (5, '{"t":"\\"flow_id\\":9,","flow_id" : -7, "x":["flow_id",{"flow_id":5.5,"dst_ip":"a\\u0062\\"c"}]}'), (6, '{"flow_id":"3","dst_ip":7}')], "k long, payload string")
    assert {tuple(r) for r in scoring.harvested(df, "k").collect()} == {(1, 3, None), (1, None, "x"), (1, None, "y"), (4, None, "z"), (5, -7, None), (5, None, 'ab"c')}


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from netquarry import session

    context = SimpleNamespace(master="spark://x:7077", applicationId="a", getConf=lambda: SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_scratch_removes_what_was_cut(spark):
    from pathlib import Path

    from netquarry import session

    with session.scratch():
        path = Path(session.cut(spark.range(3)).inputFiles()[0].removeprefix("file://")).parent
        assert path.exists()
    assert not path.exists()


def test_lookup_of_a_large_dimension_is_dealt(spark, monkeypatch):
    from netquarry import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 2)
    facts = spark.range(40).select("id", (F.col("id") % 5).alias("k"))
    dim = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = {(r.id, r.v) for r in session.looked_up(facts, dim, ["k"], "id").collect()}
    assert got == {(i, i % 5 * 10 if i % 5 < 4 else None) for i in range(40)}


def test_only_a_missing_llm_package_is_forgiven(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, missing):
        def load(n, *a, **k):
            if n == name:
                raise ModuleNotFoundError(f"no {missing}", name=missing)
            return real(n, *a, **k)

        return load

    monkeypatch.setattr(builtins, "__import__", without("netquarry.llm", "ahocorasick"))
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(entry)
    monkeypatch.setattr(builtins, "__import__", without("netquarry.llm", "netquarry.llm"))
    assert not importlib.reload(entry).llm_queries
    monkeypatch.undo()
    importlib.reload(entry)


# ---- runs, prompts, files beside the tables


def test_run_folders_and_json(spark, tmp_path):
    from netquarry.sources import artifacts

    paths = artifacts.prepare_run(spark, str(tmp_path), "r1")
    assert len(paths) == 11 and all(p.startswith(f"{tmp_path}/r1") for p in paths.values()) and artifacts.exists(spark, paths["prompts_used_dir"])
    with pytest.raises(ValueError):
        artifacts.run_files(str(tmp_path), "../x")
    artifacts.write_json(spark, paths["summary_json"], {"b": 1, "a": "é"})
    assert artifacts.read_text(spark, paths["summary_json"]) == '{\n  "a": "\\u00e9",\n  "b": 1\n}'
    for _ in range(2):
        artifacts.append_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), paths["renderings_jsonl"])
    assert [r.value for r in spark.read.text(paths["renderings_jsonl"]).collect()] == ['{"a":1,"b":null}'] * 2


def test_few_splits_are_spread(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "uuid() as u").coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(one).rdd.getNumPartitions() == cores > one.rdd.getNumPartitions()
    assert tables.spread(one, 1 << 40).rdd.getNumPartitions() == one.rdd.getNumPartitions()
    spark.range(200_000).selectExpr("id", "uuid() as u").repartition(8).write.parquet(f"{tmp_path}/many")
    many = spark.read.option("maxPartitionBytes", 1).parquet(f"{tmp_path}/many")
    assert tables.spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()


def test_sample_file(spark, tmp_path):
    import hashlib

    from netquarry.sources import artifacts

    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("id"), (F.col("id") % 5 == 0).alias("bad"))
    s = strata.class_balanced(rows, F.col("bad"), 2000, 0.25, 1, "id")
    assert {r.bad: r["count"] for r in s.groupBy("bad").count().collect()} == {True: 500, False: 1500}
    told = artifacts.write_sample(s, f"{tmp_path}/s.parquet", {"seed": 1})
    data = (tmp_path / "s.parquet").read_bytes()
    assert told["sha256"] == hashlib.sha256(data).hexdigest() and told["bytes"] == len(data)
    import pyarrow.parquet as pq

    f = pq.ParquetFile(tmp_path / "s.parquet")
    assert f.metadata.num_rows == 2000 and f.metadata.num_row_groups == 2
    ids = f.read().column("id").to_pylist()
    assert ids == sorted(ids)
    with pytest.raises(ValueError, match="bytes"):
        artifacts.write_sample(s, f"{tmp_path}/t.parquet", {}, most_bytes=10)


def test_strict_configuration(spark, tmp_path):
    from netquarry.plans import runs

    good = {"personas": {"a": {"max_turns": 4, "max_tool_calls": 6, "wall_clock_seconds": 60, "tools": ["x"]}}, "provider_models": {"p": "m"}, "cost_cap": 2, "schema_path": "s.json", "unit_cap": None}
    (tmp_path / "c.json").write_text(__import__("json").dumps(good))
    c = runs.load_config(spark, f"{tmp_path}/c.json")
    assert c.personas["a"].max_turns == 4 and c.cost_cap == 2.0 and c.schema_path == f"{tmp_path}/s.json" and c.unit_cap is None
    for change, place in (({"extra": 1}, "extra"), ({"personas": {"a": {"max_turns": 1}}}, "personas.a"), ({"cost_cap": "x"}, "cost_cap"), ({"units_per_stratum": True}, "units_per_stratum"), ({"provider_models": [1]}, "provider_models")):
        with pytest.raises(ValueError, match=place):
            runs.built(runs.RunConfig, good | change)


def test_prompts(spark, tmp_path):
    from netquarry.functions import prompts

    for d in ("personas", "playbooks"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.md").write_text(f"the {d} of a")
    (tmp_path / "playbook_common.md").write_text("common")
    p = prompts.load(spark, str(tmp_path))
    tools_ = [{"name": "list_pairs"}, {"name": "submit_assessment"}]
    text = prompts.compose(p, "a", "main", "scaffold", {}, tools_, ["DDoS"])
    assert [text.index(x) for x in ("scaffold", "Output", "personas of", "common", "playbooks of", "list_pairs")] == sorted(text.index(x) for x in ("scaffold", "Output", "personas of", "common", "playbooks of", "list_pairs"))
    assert "playbooks of" not in prompts.compose(p, "a", "playbooks_off", "s", {}, tools_, []) and "list_pairs" not in prompts.compose(p, "a", "tools_off", "s", {}, tools_, [])
    with pytest.raises(prompts.ForbiddenToken, match="attack_family at"):
        prompts.compose(p, "a", "main", "a ddos", {}, tools_, ["DDoS"])
    with pytest.raises(LookupError):
        prompts.compose(p, "b", "main", "s", {}, tools_, [])
    (tmp_path / "playbooks/b.md").write_text("x")
    with pytest.raises(ValueError, match="b"):
        prompts.load(spark, str(tmp_path))


def test_runs_are_compared(spark, tmp_path):
    import json

    from netquarry.plans import runs

    def run(name, ablation, f1, acc, cost, seed=7, broken=False):
        d = tmp_path / "runs" / name
        d.mkdir(parents=True)
        (d / "run_metadata.json").write_text(json.dumps({"dataset_hash": "h", "sample_seed": seed, "ablation": ablation}))
        s = {"scoring": {"p/q": {"per_flow_f1_macro": f1, "units": 3, "verdict": {"accuracy": acc, "f1": None}}, "p/z": {"per_flow_f1_macro": 1.0}}, "per_provider_persona": {"p/q": {"cost_usd": cost}}}
        (d / "summary.json").write_text("{" if broken else json.dumps(s))

    run("r0", "tools_off", 0.25, 0.5, 1.0)
    out = lambda: runs.compare_runs(spark, f"{tmp_path}/runs", f"{tmp_path}/out", "h", 7)
    with pytest.raises(FileNotFoundError, match="main"):
        out()
    assert (tmp_path / "out/h/7/tools_off_run_id.txt").read_text() == "r0\n"
    run("r1", "main", 0.1, 0.1, 9.0)
    run("r2", "main", 0.75, 0.9, 3.5)
    run("r3", "main", 0.0, 0.0, 0.0, seed=8)
    run("r4", "main", 0.0, 0.0, 0.0, broken=True)
    told = json.loads((tmp_path / "out/h/7/ablation_summary.json").read_text()) if out() else None
    assert told["runs"] == {"main": "r2", "tools_off": "r0"} and told["missing_ablations"] == ["playbooks_off", "single_shot_baseline"]
    assert told["deltas"]["tools_off_to_main"] == {"p/q": {"per_flow_f1": 0.5, "verdict_accuracy": 0.4, "cost_usd": 2.5}, "p/z": {"per_flow_f1": 0.0}}


def test_scripted_renderings_are_scored(spark):
    from netquarry.plans import runs

    b = index.unit_bridge(scanner_flows(spark), 10, 5, 1000).withColumn("unit", reference.unit_key()).withColumn("dst_ip", F.col("flow_dst"))
    u = index.units(index.unit_bridge(scanner_flows(spark), 10, 5, 1000)).withColumn("unit", reference.unit_key())
    s = scoring.scored(runs.scripted(u, "mock", ["a", "b"]), scoring.unit_sets(b))
    e = {r.persona: (r.units, r.per_flow_f1_macro) for r in summary.score_entry(s).collect()}
    assert e == {p: (11, round(8 / 11, 6)) for p in ("a", "b")}


def test_log_lines():
    import json
    import logging

    from netquarry.plans import runs

    told = json.loads(runs.JsonLines().format(logging.makeLogRecord({"msg": "x %s", "args": ("y",), "levelname": "INFO", "name": "n", "rows": 3})))
    assert (told["message"], told["level"], told["logger"], told["rows"]) == ("x y", "INFO", "n", 3)


def test_command_line(spark, tmp_path, capsys):
    from netquarry.__main__ import main

    f = scanner_flows(spark).withColumns({"Attack": F.when(F.col("is_malicious"), "Scan").otherwise("benign"), "sampling_rate": F.lit(1)}).drop("flow_id", "is_malicious")
    f.write.parquet(str(tmp_path / "raw"))
    assert main(["build-index", str(tmp_path / "raw"), "--out", str(tmp_path / "ix"), "--dataset", "d"]) == 0
    path = capsys.readouterr().out.strip().splitlines()[-1]
    assert main(["tools-smoke", path]) == 0
