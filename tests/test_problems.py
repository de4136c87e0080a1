"""Operators of the general problems against brute force, and on the awkward cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.operators import drift, features, heavy_keys, instants, schema_tree, sessions
from netquarry.operators.bitslice import Sliced, TypedState
from netquarry.operators.scan import numbered, running_max

FLOW = "_flow_id long, index_id string, src_ip string, dst_ip string, ts_start double, protocol string, dst_port long, bytes_out double, bytes_in double, flow_duration_ms double, _is_malicious boolean"


def make_flows(spark, rows):
    return spark.createDataFrame(rows, FLOW)


def random_flows(seed, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        src = r.choice(["A", "a ", "a", "a", "a", "b", "C", None, " "])
        ts = None if r.random() < 0.03 else 1000 + r.randrange(0, 64 * 4000) / 64
        dur = r.choice([None, 0.0, 500.0, 20_000.0, float("nan"), -5.0])
        fid = None if r.random() < 0.02 else i
        row = (fid, r.choice(["x", "y"]), src, r.choice(["p", "q"]), ts, r.choice(["TCP", " tcp", "6", "udp", None]), r.choice([80, 53, None]), r.choice([None, 5.0, 7.0, -3.0]), 1.0, dur, r.random() < 0.3)
        rows.append(row)
        if fid is not None and r.random() < 0.2:
            rows.append(row)
    r.shuffle(rows)
    return rows


def distinct(rows):
    seen, out = set(), []
    for x in rows:
        if x[0] is None or x[0] not in seen:
            seen.add(x[0])
            out.append(x)
    return out


def ident(s):
    return (s or "").strip().lower() or None


def naive_sessions(rows, gap):
    by = {}
    for x in distinct(rows):
        if ident(x[2]) and x[4] is not None:
            d = x[9]
            by.setdefault(ident(x[2]), []).append((round(x[4] * 1e6), round(max(0.0, d if d is not None and d == d else 0.0) * 1000)))
    out = []
    for k, v in by.items():
        end = None
        for s, d in sorted(v):
            if end is None or s > end + gap * 1e6:
                out.append([k, s, s + d, 1])
                end = s + d
            else:
                end = max(end, s + d)
                out[-1][2], out[-1][3] = end, out[-1][3] + 1
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed,partitions,gap", [(1, 1, 5), (2, 7, 5), (3, 13, 2), (4, 5, 60)])
def test_sessions_match_a_plain_scan(spark, seed, partitions, gap):
    rows = random_flows(seed)
    got = sessions.sessions(make_flows(spark, rows), gap, partitions).collect()
    assert sorted(map(tuple, got)) == naive_sessions(rows, gap)


def test_a_long_flow_reaches_over_later_partitions(spark):
    rows = [(0, "x", "a", "p", 0.0, "TCP", 1, 1.0, 1.0, 3_000_000.0, False)] + [(i, "x", "a", "p", i * 10.0, "TCP", 1, 1.0, 1.0, 0.0, False) for i in range(1, 290)] + [(900, "x", "a", "p", 9000.0, "TCP", 1, 1.0, 1.0, None, False)]
    got = sorted(map(tuple, sessions.sessions(make_flows(spark, rows), 2, 16).collect()))
    assert got == [("a", 0, 3_000_000_000, 290), ("a", 9_000_000_000, 9_000_000_000, 1)]


def test_empty_tables(spark):
    none = make_flows(spark, [])
    assert sessions.sessions(none).count() == 0
    assert heavy_keys.heavy_sources(none).count() == 0
    services = spark.createDataFrame([], "service_id long, dst_port long, protocol string, service_name string")
    assert features.entity_features(features.service_events(none, services)).count() == 0


def test_scan_out_flushes_keep_edges():
    from netquarry.operators.sessions import _Out

    o = _Out(3, piece=4)
    for i in range(5):
        o.add("a" if i < 3 else "b", i, i, 1, i < 3)
    parts = list(o.full())
    assert parts[0].num_rows == 3 and not any(parts[0].column("last_key").to_pylist())
    assert next(o.rest()).column("last_key").to_pylist() == [True, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 10**12)), max_size=60), st.lists(st.tuples(st.integers(0, 300), st.integers(1, 10**12)), max_size=60))
def test_bit_sliced_addition(a, b):
    a, b = dict(a), dict(b)
    make = lambda m: Sliced.of(np.array(sorted(m), np.int64), np.array([m[k] for k in sorted(m)], np.uint64))
    total = make(a) + make(b)
    at = np.array(sorted(a.keys() | b.keys()), np.int64)
    assert total.positions().tolist() == at.tolist()
    assert total.at(at).tolist() == [a.get(int(k), 0) + b.get(int(k), 0) for k in at]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(-50, 50), st.integers(0, 99)), max_size=80), st.integers(0, 80))
def test_typed_state_merges(rows, split):
    def state(r):
        return TypedState.of_rows(*(np.array([x[i] for x in r], np.int64) for i in range(3)))

    s = state(rows[:split]) + state(rows[split:])
    counts, totals = s.numbers()
    want = {p: [v for q, v, _ in rows if q == p] for p, _, _ in rows}
    assert s.at.tolist() == sorted(want)
    assert counts.tolist() == [len(want[p]) for p in sorted(want)]
    assert totals.tolist() == [sum(want[p]) for p in sorted(want)]
    assert s.first.tolist() == [min(t for q, _, t in rows if q == p) for p in sorted(want)]


def test_rounds_of_states():
    assert features.rounds_of(8, 64) == (1, 8) and features.rounds_of(64, 64) == (1, 64) and features.rounds_of(1, 64) == (1, 1)
    for n in (65, 200, 4097, 10_000):
        rounds, f = features.rounds_of(n, 64)
        assert f <= 64 and f**rounds >= n > 64 ** (rounds - 1)


@pytest.mark.parametrize("seed,parts,fan_in", [(5, 3, 64), (6, 8, 2), (7, 9, 3)])
def test_features_match_a_plain_loop(spark, seed, parts, fan_in):
    rows = random_flows(seed)
    services = spark.createDataFrame([(1, 80, "TCP", "a"), (2, 53, "udp ", "b"), (3, 80, "17", "c")], "service_id long, dst_port long, protocol string, service_name string")
    events = features.service_events(make_flows(spark, rows), services)
    names = {"TCP": "TCP", "6": "TCP", "UDP": "UDP", "17": "UDP"}
    kinds = {(80, "TCP"): 1, (53, "UDP"): 2, (80, "UDP"): 3}
    want = {}
    for x in distinct(rows):
        s = kinds.get((x[6], names.get((x[5] or "").strip().upper())))
        if s and ident(x[2]) and x[4] is not None:
            w = want.setdefault((x[1], ident(x[2]), s), [0, 0, 1 << 62, -1])
            t = round(x[4] * 1e6)
            w[0], w[1], w[2], w[3] = w[0] + 1, w[1] + int(x[7] or 0), min(w[2], t), max(w[3], t)
    got = {tuple(r)[:3]: list(r)[3:] for r in features.entity_features(events, parts, fan_in).collect()}
    assert got == want
    hosts = spark.createDataFrame([("x", "A", 1, 0, 1, 0, 0.0, 1.0, None, 2.0, "2020"), ("x", "a", 9, 0, 1, 0, 0.0, 1.0, 3.0, 2.0, "2021"), ("z", "q", 9, 0, 1, 0, 0.0, 1.0, 3.0, 2.0, "2021")], "index_id string, host string, flow_count long, malicious_flow_count long, distinct_destinations long, distinct_malicious_destinations long, ts_start_min double, ts_start_max double, bytes_out_total double, bytes_in_total double, built_at string")
    wide = {(r.index_id, r.host): r for r in features.feature_table(features.entity_features(events), hosts).collect()}
    assert wide["x", "a"].flow_count == 9 and wide["z", "q"].services == {}
    assert wide["y", "b"].flow_count is None and wide["y", "b"].services[1].flow_count == want["y", "b", 1][0]


@pytest.mark.parametrize("chunks,fan_in", [(1, 2), (9, 2), (16, 4)])
def test_tree_aggregation(spark, chunks, fan_in):
    rows = random_flows(8)
    got = {r.src_ip: (r.flow_count, r.malicious_flow_count, r.bytes_out_total) for r in heavy_keys.host_states(make_flows(spark, rows), chunks, fan_in).collect()}
    want = {}
    for x in distinct(rows):
        a = want.setdefault(ident(x[2]), [0, 0, 0])
        a[0], a[1], a[2] = a[0] + 1, a[1] + x[10], a[2] + int(x[7] or 0)
    assert got == {k: tuple(v) for k, v in want.items()}
    heavy = {r.src_ip for r in heavy_keys.heavy_sources(make_flows(spark, rows), 0.2, chunks, fan_in).collect()}
    total = sum(v[0] for v in want.values())
    assert heavy == {k for k, v in want.items() if k and v[0] * 5 >= total}
    with pytest.raises(ValueError):
        heavy_keys.host_states(make_flows(spark, rows), chunks, 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-(2**62), 2**62)), min_size=1, max_size=40))
def test_running_max(rows):
    rows.sort(key=lambda x: x[0])
    got = running_max(np.array([v for _, v in rows]), np.array([g for g, _ in rows])).tolist()
    assert got == [max(v for g2, v in rows[: i + 1] if g2 == g) for i, (g, _) in enumerate(rows)]


def test_numbered_places(spark):
    rows = [("a" if i % 3 else None if i % 2 else "b", i * 7 % 101) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {(r.k, r.v): r._pos for r in numbered(df, "k", ["v"], 6).collect()}
    for k in ("a", "b", None):
        vs = sorted(v for x, v in rows if x == k)
        assert [got[k, v] for v in vs] == list(range(len(vs)))
    whole = [r._pos for r in numbered(df, None, ["v", "k"], 4).orderBy("v").collect()]
    assert whole == list(range(100))


# ---- instants


def us(text):
    return int((datetime.fromisoformat(text) - datetime(1970, 1, 1)) / timedelta(microseconds=1))


AB = {"CEST": 120, "EST": -300, "UTC": 0}


def read(text, at, zone=None, order=None):
    """The possible readings of a text: notation -> instant."""
    r = instants.read(pa.array([text]), np.array([us(at)]), [instants.Zone(zone) if zone else None], np.zeros(1, int), np.array([order or ""]), AB)
    return {instants.COMPONENTS[c - 1][0]: v for c, d, v in zip(*(x[0].tolist() for x in (r.component, r.delay, r.instant))) if d}


@pytest.mark.parametrize("text,at,zone,order,want", [
    ("1702638828", "2023-12-18T10:33:35", None, None, "2023-12-15T11:13:48"),
    (" 1734231044594201\t", "2024-12-15T02:51:21", None, None, "2024-12-15T02:50:44.594201"),
    ("1721503648920473036", "2024-07-20T19:28:19", None, None, "2024-07-20T19:27:28.920473"),
    ("1.698838647e9", "2023-11-01T11:38:12", None, None, "2023-11-01T11:37:27"),
    ("20230326024004", "2023-03-26T01:40:27", "Europe/Berlin", None, "2023-03-26T01:40:04"),  # skipped: the offset before
    ("2023-10-29 02:30:00", "2023-10-29T00:45:00", "Europe/Berlin", None, "2023-10-29T00:30:00"),  # twice: the first has not passed the second
    ("2023-10-29 02:30:00", "2023-10-29T01:45:00", "Europe/Berlin", None, "2023-10-29T01:30:00"),
    ("Dec 31 23:59:59", "2024-01-01T00:00:30", "UTC", None, "2023-12-31T23:59:59"),
    ("Feb 29 10:00:00", "2024-03-01T00:00:00", "UTC", None, "2024-02-29T10:00:00"),
    ("03/04/2024 1:02:03 PM", "2024-04-03T14:00:00", "UTC", "dmy", "2024-04-03T13:02:03"),
    ("03/04/2024 12:02:03 AM", "2024-03-04T14:00:00", "UTC", "mdy", "2024-03-04T00:02:03"),
    ("09.10.2024 02:25:29,5", "2024-10-10T11:00:00", "UTC", "mdy", "2024-10-09T02:25:29.5"),
    ("Sun, 12 Mar 2023 00:39:42 -0500", "2023-03-12T05:39:54", None, None, "2023-03-12T05:39:42"),
    ("06/Oct/2023:21:15:14 +0530", "2023-10-06T15:46:12", None, None, "2023-10-06T15:45:14"),
    ("2024-09-03T07:24:54,031+0200", "2024-09-03T05:26:57", "Asia/Tokyo", None, "2024-09-03T05:24:54.031"),
    ("2025-04-29 17:10:00.659960 CEST", "2025-04-29T15:12:28", None, None, "2025-04-29T15:10:00.659960"),
    ("12 may 2023 02:40", "2023-05-14T05:28:17", "UTC", None, "2023-05-12T02:40:00"),
    ("20230720T154252Z", "2023-07-20T15:43:54", None, None, "2023-07-20T15:42:52"),
])
def test_readings(text, at, zone, order, want):
    assert list(read(text, at, zone, order).values()) == [us(want)]


@pytest.mark.parametrize("text", ["", "-", "N/A", "unknown", "0", "-1", "2024-02-30 10:00:00", "2024-12-24T15:", "2023-10-29 25:03:07", "2024-13-01T00:00:00Z", "2024-01-01 10:00:00 XYZ", "2020-01-01T00:00:00Z", "20/13/2024 1:00:00 PM", "2024-05-01"])
def test_no_instant(text):
    assert read(text, "2024-06-01T00:00:00", "UTC", "dmy") == {}


def test_readings_at_the_ends_of_the_calendar_do_not_fail():
    texts = ["0001-01-01 00:00:00", "9999-12-31 23:59:59", "0000-01-01 00:00:00", "1" * 500, "9" * 19, "1e999", "-1e30", "Jan 1 00:00:00"]
    at = np.array([us("0001-01-02T00:00:00"), us("9999-12-31T00:00:00")] + [us("2024-06-01T00:00:00")] * 6)
    r = instants.read(pa.array(texts), at, [instants.Zone("Asia/Tokyo")], np.zeros(8, int), np.array([""] * 8), AB)
    assert r.delay.any(1).tolist() == [True, True, False, False, False, False, False, True]


def test_local_time_without_zone_names_nothing():
    assert read("2024-05-31 10:00:00", "2024-06-01T00:00:00") == {}


def test_em_finds_the_date_order(spark):
    """A source without a declared order: its clear dates decide its unclear ones, and one with no evidence is marked."""
    at = datetime(2024, 8, 1)
    raw = [(i, 1, at, f"{d:02d}/07/2024 10:00:00") for i, d in enumerate(range(13, 29))] + [(90, 1, at, "03/04/2024 10:00:00"), (91, 2, at, "03/04/2024 10:00:00"), (92, None, at, "1722400000"), (93, 1, None, "1722400000"), (94, 9, at, "2024-07-31T00:00:00Z")]
    df = spark.createDataFrame(raw, "record_id long, exporter_id long, received_at timestamp_ntz, start_text string")
    ex = spark.createDataFrame([(1, "UTC", None), (2, "UTC", None)], "exporter_id long, time_zone string, date_order string")
    ab = spark.createDataFrame([("UTC", 0)], "abbreviation string, offset_minutes long")
    got = {r.record_id: r for r in instants.normalized(df, ex, ab).collect()}
    assert got[90].notation == "dmy" and not got[90].ambiguous and got[90].epoch_us == us("2024-04-03T10:00:00")
    assert got[91].ambiguous and got[91].readings == got[91].possible == 2
    assert got[92].readings == 4 and got[92].possible == 1 and got[92].posterior == 1
    assert got[92].notation == "epoch_s" and got[94].exporter_id == 9 and 93 not in got
    assert instants.normalized(df.limit(0), ex, ab).count() == 0


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "Africa/Casablanca", "UTC"])
def test_zone_offsets_are_those_of_the_database(name):
    from zoneinfo import ZoneInfo

    walls = np.arange(us("2023-01-01T00:00:00"), us("2025-07-01T00:00:00"), 23 * 60 * 1_000_000 + 7)
    one, two, twice = instants.Zone(name).instants(walls)
    for w, a, b, t in list(zip(walls.tolist(), one.tolist(), two.tolist(), twice.tolist()))[::7] + [x for x in zip(walls.tolist(), one.tolist(), two.tolist(), twice.tolist()) if x[3]]:
        local = (datetime(1970, 1, 1) + timedelta(microseconds=w)).replace(tzinfo=ZoneInfo(name))
        early, late = (round(local.replace(fold=k).utcoffset() / timedelta(microseconds=1)) for k in (0, 1))
        assert w - a == early and t == (late < early) and (not t or w - b == late)


def test_dates_exist_as_in_the_calendar():
    parts = np.array([(y, m, d, 23, 59, 58) for y in (0, 1, 1900, 2000, 2023, 2024) for m in range(14) for d in range(33)]).T
    value, exists = instants.wall_us(*parts, np.zeros(parts.shape[1], np.int64))
    for row, v, e in zip(parts.T.tolist(), value.tolist(), exists.tolist()):
        try:
            want = (datetime(*row) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        except ValueError:
            want = None
        assert (v if e else None) == want


def test_the_mixture_decides_against_the_first_reading(spark):
    """Declared orders withheld, two sources write the same open dates and their clear ones decide differently."""
    at = datetime(2024, 8, 1)
    clear = [(1, f"{d}/07/2024 10:00:00") for d in range(13, 29)] + [(2, f"07/{d}/2024 10:00:00") for d in range(13, 29)]
    rows = [(i, e, at, t) for i, (e, t) in enumerate(clear + [(e, f"0{d}/06/2024 10:00:00") for e in (1, 2) for d in range(1, 6)])]
    df = spark.createDataFrame(rows, "record_id long, exporter_id long, received_at timestamp_ntz, start_text string")
    ex = spark.createDataFrame([(1, "UTC", "mdy"), (2, "UTC", "dmy")], "exporter_id long, time_zone string, date_order string")
    got = instants.inferred_orders(df, ex, spark.createDataFrame([("UTC", 0)], "abbreviation string, offset_minutes long"))
    assert {tuple(r)[:5] for r in got.collect()} == {(1, 16, 0, 5, 0), (2, 0, 16, 0, 5)}


# ---- drift

ALIASES = {"src_ip": ("src_ip", 0), "srcip": ("src_ip", 2), "bytes_in": ("bytes_in", 0), "ibyt": ("bytes_in", 3)}


def script(a, b):
    side = lambda m: drift.tree(sorted(m.items()), ALIASES)
    cost, edits = drift.edit_script(side(a), side(b))
    return cost, drift._listed(edits)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_has_the_greatest_gain(n, m, seed):
    from itertools import permutations

    gain = np.random.default_rng(seed).integers(0, 5, (n, m)).astype(float)
    pairs = schema_tree.assignment(gain)
    assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    wide = gain if n <= m else gain.T
    best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
    assert sum(gain[r, c] for r, c in pairs) == best


def test_nested_scripts_are_of_least_cost():
    O, N, s = drift.OBJECT, drift.NUMBER, drift.SEP
    under = lambda top, names: {top: O, **{f"{top}{s}{n}": N for n in names}}
    # A renamed object keeps its fields: one relabelling, not six edits.
    assert script(under("meta", "abc"), under("info", "abd")) == (4.0, [("info", "added"), (f"info{s}d", "added"), ("meta", "removed"), (f"meta{s}c", "removed")])
    # Two objects that swapped names are matched crosswise, but for fields of the payload itself.
    swapped = [under("x", a) | under("y", b) for a, b in (("abcd", "pqrs"), ("pqrs", "abcd"))]
    inner = [{"p": O, **{f"p{s}{k}": v for k, v in fields.items()}} for fields in swapped]
    assert script(*inner)[0] == 2 * schema_tree.RELABEL
    assert {e for e in script(*swapped)[1] if s not in e[0]} == set()
    # Flattening: two moves and a removal.
    assert script(under("meta", "ab"), {"a": N, "b": N}) == (2 * schema_tree.MOVE + 1, [("a", "added"), ("b", "added"), ("meta", "removed"), (f"meta{s}a", "moved"), (f"meta{s}b", "moved")])
    deep = {s.join("n" * k): O for k in range(1, 300)}
    assert script(deep, deep | {s.join("n" * 300): N}) == (1.0, [(s.join("n" * 300), "added")])


def test_projections_are_compiled_from_scripts():
    O, N, T, s = drift.OBJECT, drift.NUMBER, drift.TEXT, drift.SEP
    p = lambda fields: drift.projection(sorted(fields.items()), ALIASES)
    assert p({"srcip": T, "x": N, "ibyt": N, "bytes_in": N}) == {"srcip": "src_ip", "bytes_in": "bytes_in"}
    assert p({"flow": O, f"flow{s}srcip": T, f"flow{s}n": O, f"flow{s}n{s}ibyt": N}) == {f"flow{s}srcip": "src_ip", f"flow{s}n{s}ibyt": "bytes_in"}
    assert p({"src_ip": T, "flow": O, f"flow{s}srcip": T}) == {"src_ip": "src_ip"}
    assert p({"protocol": T}) == {} == p({})


def test_edit_scripts():
    T, N, B = drift.TEXT, drift.NUMBER, drift.TRUTH
    assert script({"srcip": T, "x": N}, {"src_ip": T, "y": N}) == (2.5, [("src_ip", "renamed"), ("x", "removed"), ("y", "added")])
    assert script({"ibyt": N}, {"bytes_in": T})[1] == [("bytes_in", "renamed"), ("bytes_in", "retyped")]
    assert script({"ibyt": 0}, {"ibyt": T})[1] == []
    assert script({"srcip": T, "src_ip": T}, {"src_ip": B})[1] == [("src_ip", "retyped")]
    s = drift.SEP
    assert script({"a": 8, f"a{s}k": N, "b": 8}, {"a": 8, "b": 8, f"b{s}k": N})[1] == [(f"a{s}k", "moved"), (f"b{s}k", "moved")]


def test_top_level_ends_of_a_move_are_added_and_removed(spark):
    s = drift.SEP
    nested, flat = {"meta": drift.OBJECT, f"meta{s}x": drift.NUMBER}, {"meta": drift.OBJECT, "x": drift.NUMBER}
    assert script(nested, flat) == (schema_tree.MOVE, [(f"meta{s}x", "moved"), ("x", "added")])
    assert script(flat, nested) == (schema_tree.MOVE, [(f"meta{s}x", "moved"), ("x", "removed")])
    files = spark.createDataFrame([(i, 7, i) for i in (1, 2, 3)], "file_id long, feed_id long, file_seq long")
    texts = ['{"meta":{"x":1}}', '{"meta":{},"x":1}', '{"meta":{"x":1}}']
    records = spark.createDataFrame([(i, i, 1, t) for i, t in enumerate(texts, 1)], "record_id long, file_id long, line_no long, payload string")
    aliases = spark.createDataFrame([(c, a, r) for a, (c, r) in ALIASES.items()], "canonical_name string, alias_name string, alias_rank long")
    got = {(r.file_id, r.field_name, r.change_kind) for r in drift.changes(files, records, aliases).where("top").collect()}
    assert got == {(2, "x", "added"), (3, "x", "removed")}


def test_changes_and_table(spark):
    files = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 3), (4, 8, 1), (5, None, 1)], "file_id long, feed_id long, file_seq long")
    rows = [(1, 1, 1, '{"SrcIP":"h","ibyt":5,"flag":true}'), (2, 2, 1, '{"src_ip":"h","ibyt":"6","Extra":{"k":1}}'), (3, 2, 2, '{"src_ip":"h", broken'), (4, 2, 3, None), (5, 2, 4, "[1]"), (6, 4, 1, '{"src_ip":null}'), (7, 2, 5, '{"src_ip":"i","ibyt":"x"}')]
    records = spark.createDataFrame(rows, "record_id long, file_id long, line_no long, payload string")
    aliases = spark.createDataFrame([(c, a, r) for a, (c, r) in ALIASES.items()], "canonical_name string, alias_name string, alias_rank long")
    got = {(r.file_id, r.field_name, r.change_kind) for r in drift.changes(files, records, aliases).where("top").collect()}
    assert got == {(2, "src_ip", "renamed"), (2, "bytes_in", "retyped"), (2, "flag", "removed"), (2, "extra", "added"), (3, "src_ip", "removed"), (3, "bytes_in", "removed"), (3, "extra", "removed")}
    table = {r.record_id: r for r in drift.unified(files, records, aliases).collect()}
    assert set(table) == {1, 2, 6, 7}
    assert table[1].src_ip == "h" and table[1].bytes_in == 5.0 and table[1].extras == {"flag": "true"}
    assert table[2].bytes_in == 6.0 and table[7].bytes_in is None and table[7].extras == {"ibyt": "x"}
    assert drift.changes(files, records.limit(0), aliases).count() == 0
    nested = spark.createDataFrame([(1, 1, 1, '{"flow":{"SrcIP":"n","deep":{"ibyt":"7"}},"flag":1}')], records.schema)
    row = drift.unified(files, nested, aliases).first()
    assert (row.src_ip, row.bytes_in, sorted(row.extras)) == ("n", 7.0, ["flag", "flow"])


def test_table_in_one_unit_and_one_notation(spark):
    aliases = [("ts_start", "ts_start", 0), ("ts_start", "FLOW_START_MILLISECONDS", 2), ("src_ip", "src_ip", 0), ("dst_ip", "da", 5)]
    rows = [
        (1, 1, '{"ts_start":"2023-03-20T05:06:01Z","src_ip":182644091,"da":"10.1.2.3"}', 1679288761.0, "10.226.237.123", "10.1.2.3", {}),
        (2, 1, '{"TS_START":"2023-03-20 07:06:01.5+02:00","src_ip":"182644091","da":"fd7a::1"}', 1679288761.5, "10.226.237.123", "fd7a::1", {}),
        (3, 1, '{"ts_start":"2023-03-20T05:06:01","da":4294967296}', 1679288761.0, None, "4294967296", {}),
        (4, 1, '{"ts_start":"2023-13-20T05:06:01Z","da":true}', None, None, "true", {"ts_start": "2023-13-20T05:06:01Z"}),
        (5, 2, '{"FLOW_START_MILLISECONDS":1679776221000}', 1679776221.0, None, None, {}),
        (6, 2, '{"flow_start_milliseconds":"1679776650500"}', 1679776650.5, None, None, {}),
        (7, 3, '{"FLOW_START_MILLISECONDS":1679776221.25}', 1679776221.25, None, None, {}),
        (8, 4, '{"ts_start":1679776221000}', 1679776221.0, None, None, {}),
        (9, 4, '{"ts_start":1679776223000}', 1679776223.0, None, None, {}),
        (10, 4, '{"ts_start":5}', 0.005, None, None, {}),
        (11, 5, '{"ts_start":1999999999999}', 1999999999.999, None, None, {}),
        (12, 5, '{"ts_start":4}', 0.004, None, None, {}),
        (13, 6, '{"ts_start":1999999999990}', 1999999999990.0, None, None, {}),
        (14, 6, '{"ts_start":4}', 4.0, None, None, {}),
        (15, 7, '{"ts_start":null}', None, None, None, {}),
    ]
    files = spark.createDataFrame([(i, 1, i) for i in range(1, 8)], "file_id long, feed_id long, file_seq long")
    records = spark.createDataFrame([(r, f, r, p) for r, f, p, *_ in rows], "record_id long, file_id long, line_no long, payload string").repartition(4)
    table = drift.unified(files, records, spark.createDataFrame(aliases, "canonical_name string, alias_name string, alias_rank long"))
    got = {r.record_id: (r.ts_start, r.src_ip, r.dst_ip, r.extras) for r in table.collect()}
    assert got == {r: tuple(want) for r, _, _, *want in rows}


def test_previous_over_blocks(spark):
    rows = [(k, i * 3, f"{k}{i}") for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o long, v string")
    got = {(r.k, r.o): (r.has_before, r.before) for r in drift.previous(df, "k", "o", "v", width=7).collect()}
    assert all(got[k, i * 3] == ((True, f"{k}{i - 1}") if i else (False, None)) for k in "ab" for i in range(50))


def test_extra_columns_do_not_clash(spark):
    rows = random_flows(9, 100)
    f = make_flows(spark, rows).withColumns({"start_us": F.lit("x"), "src": F.lit(1), "_chunk": F.lit(2), "pid": F.lit(3), "block": F.lit(4), "flow": F.lit(5)})
    assert sorted(map(tuple, sessions.sessions(f, 5).collect())) == naive_sessions(rows, 5)
    assert heavy_keys.host_states(f).count() == heavy_keys.host_states(make_flows(spark, rows)).count()


def test_running_sums_cross_partitions(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1.0, 2.0]), r.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v double, w int")
    got = {(x.k, x.o): (x._sum_v, x._sum_w) for x in numbered(df, "k", ["o"], 7, ("v", "w")).collect()}
    for k in ("a", "b", None):
        v = w = 0.0
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            v, w = v + (x[2] or 0), w + x[3]
            assert got[k, x[1]] == (v, w)
