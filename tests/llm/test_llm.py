"""Operators of the language-model problems against brute force, and on the awkward cases."""

import base64
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.llm import encode, leaks, sample, spans, split

UNIT = "eval_unit_id string, unit_type string, gold_label string, flow_ids array<long>"
FLOW = "_flow_id long, src_ip string, ts_start double"


# ---- splitting


def units_and_flows(spark, seed):
    r = random.Random(seed)
    flows = [(i, "a", 1000 + r.randrange(0, 3000) / 64 + 100 * r.randrange(0, 40)) for i in range(700)]
    units = [("big", "t", "l", r.sample(range(700), 500)), ("small", "t", "l", list(range(12))), ("none", "t", "l", None), ("even", "t", "l", r.sample(range(700), 13) * 2), ("bare", "t", "l", [None])]
    units.append(units[0])
    u = spark.createDataFrame(units, UNIT)
    f = spark.createDataFrame(flows + flows[::3] + [(None, "a", 5.0), (9999, None, 1.0)], FLOW)
    order = {k: sorted({i for i in ids if i is not None}, key=lambda i: (flows[i][2], i)) for k, _, _, ids in units if ids}
    return u, f, {i: t for i, _, t in flows}, order


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 9), (3, 17)])
def test_segment_starts(spark, seed, partitions):
    u, f, ts, order = units_and_flows(spark, seed)
    want = set()
    for k in ("big", "even"):
        o = order[k]
        want |= {(k, o[0])} | {(k, b) for a, b in zip(o, o[1:]) if ts[b] - ts[a] >= 10}
    got = [tuple(r) for r in split.segments(u, f, limit=12, silence_s=10, partitions=partitions).select("eval_unit_id", "flow_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed,partitions,block", [(1, 1, 10_000), (2, 7, 64), (4, 5, 20)])
def test_pieces_cover_with_overlap(spark, seed, partitions, block):
    u, f, ts, order = units_and_flows(spark, seed)
    rows = split.pieces(u, f, limit=12, overlap=3, silence_s=10, block=block, partitions=partitions).collect()
    assert {r.eval_unit_id for r in rows} == {"big", "even"}
    for k in ("big", "even"):
        parts = sorted((r for r in rows if r.eval_unit_id == k), key=lambda r: r.piece_start)
        told = list(parts[0].flow_ids)
        for a, b in zip(parts, parts[1:]):
            assert b.flow_ids[:3] == a.flow_ids[-3:]
            told += b.flow_ids[3:]
        assert told == order[k]
        assert max(len(p.flow_ids) for p in parts) <= 12
        for p in parts:
            at = p.piece_start
            assert p.natural == (at == 0 or ts[order[k][at]] - ts[order[k][at - 1]] >= 10) or not p.natural


def whole_unit_pieces(starts, limit, overlap, silence):
    """(first flow, natural) of the pieces of a whole unit, merged as defined."""
    atoms, gaps, natural = [], [], []
    for i, t in enumerate(starts):
        silent = i == 0 or t - starts[i - 1] >= silence
        if silent or len(atoms[-1]) == (limit if atoms[-1][0] == 0 else limit - overlap):
            atoms.append([]), gaps.append(t - starts[i - 1] if i else 0), natural.append(silent)
        atoms[-1].append(i)
    tell = {a[0]: n for a, n in zip(atoms, natural)}
    groups = [(g, a) for g, a in zip(gaps, atoms)]
    while True:
        fit = [(g, b[0], k) for k, ((_, a), (g, b)) in enumerate(zip(groups, groups[1:])) if len(a) + len(b) <= (limit if a[0] == 0 else limit - overlap)]
        if not fit:
            return [(a[0], tell[a[0]]) for _, a in groups]
        k = min(fit)[2]
        groups[k : k + 2] = [(groups[k][0], groups[k][1] + groups[k + 1][1])]


@pytest.mark.parametrize("seed,partitions,block", [(1, 1, 10_000), (2, 7, 64), (4, 5, 20), (5, 9, 12)])
def test_pieces_do_not_depend_on_blocks(spark, seed, partitions, block):
    r = random.Random(seed)
    times, t = [], 1000.0
    for i in range(900):
        t += r.choice((1, 1, 1, 10, 12, 15, 40)) if i % 300 < 250 else 1
        times.append(t)
    u = spark.createDataFrame([("big", "t", "l", r.sample(range(900), 900)), ("even", "t", "l", list(range(13)))], UNIT)
    f = spark.createDataFrame([(i, "a", x) for i, x in enumerate(times)], FLOW)
    rows = split.pieces(u, f, limit=12, overlap=3, silence_s=10, block=block, partitions=partitions).collect()
    for k, n in (("big", 900), ("even", 13)):
        want = whole_unit_pieces(times[:n], 12, 3, 10)
        ends = [a for a, _ in want[1:]] + [n]
        got = sorted((p.piece_start, p.natural, p.flow_ids, p.start_us, p.end_us) for p in rows if p.eval_unit_id == k)
        assert got == [(a, nat, list(range(max(0, a - 3), e)), round(times[max(0, a - 3)] * 1e6), round(times[e - 1] * 1e6)) for (a, nat), e in zip(want, ends)]


def test_segments_are_what_was_merged(spark):
    u, f, ts, order = units_and_flows(spark, 6)
    segments = split.segments(u, f, limit=12, overlap=3, silence_s=10, partitions=4).collect()
    rows = split.pieces(u, f, limit=12, overlap=3, silence_s=10, partitions=4).collect()
    for k in ("big", "even"):
        silent = [i for i, x in enumerate(order[k]) if i == 0 or ts[x] - ts[order[k][i - 1]] >= 10]
        own = sorted((r.place, r.flow_id, r.gap_us, r.piece_start) for r in segments if r.eval_unit_id == k)
        assert [x[:3] for x in own] == [(i, order[k][i], round((ts[order[k][i]] - ts[order[k][i - 1]]) * 1e6) if i else 0) for i in silent]
        begins = sorted(p.piece_start for p in rows if p.eval_unit_id == k)
        assert [x[3] for x in own] == [max(b for b in begins if b <= i) for i in silent]
        assert {p.piece_start for p in rows if p.eval_unit_id == k and p.natural} == {x[0] for x in own if x[0] == x[3]}
    assert {r.eval_unit_id for r in segments} == {"big", "even"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([1, 1, 1, 10, 11, 30]), min_size=1, max_size=80))
def test_units_are_taken_apart_only_where_pieces_part(steps):
    starts = np.cumsum(steps)
    gaps = np.diff(starts, prepend=starts[0])
    at = np.flatnonzero(np.append(True, gaps[1:] >= 10))
    begin, natural = split.cut_points(at, gaps[at], len(starts), 12, 3)
    assert list(zip(begin.tolist(), natural.tolist())) == whole_unit_pieces(starts.tolist(), 12, 3, 10)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 100)), min_size=1, max_size=30))
def test_merging_is_greedy_by_weakest_boundary(segments):
    sizes, gaps = [s for s, _ in segments], [g for _, g in segments]
    groups = [[i] for i in range(len(sizes))]
    while True:
        fit = [(gaps[b[0]], b[0], k) for k, (a, b) in enumerate(zip(groups, groups[1:])) if sum(sizes[i] for i in a + b) <= (10 if a[0] == 0 else 8)]
        if not fit:
            break
        k = min(fit)[2]
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    assert split.merge_segments(sizes, gaps, 10, 2) == [g[0] for g in groups]


# ---- sampling

TARGET = "plan_id long, sample_share double, unit_type string, gold_label string, target_share double, min_units long"


def test_sample(spark):
    rows = [(f"u{i}", " Pair-Timeline" if i % 2 else "pair_timeline\t", "BENIGN" if i % 10 else "mixed", None) for i in range(400)] + [("n1", None, "mixed", None), ("n2", "x", "", None)]
    units = spark.createDataFrame(rows + rows[:50], UNIT)
    targets = spark.createDataFrame([(1, 0.5, "pair_timeline", "benign", 0.9, 1), (1, 0.5, "pair_timeline", "mixed", 0.2, 3), (1, 0.5, "pair_timeline", "malicious", 0.0, 2), (2, 0.2, "pair_timeline", "mixed", 0.5, 1), (3, None, "Pair Timeline", "mixed", None, None)], TARGET)
    # N = 400: plan 1 wants 180 benign, 40 of 40 mixed, 2 of no malicious; plan 2 wants exactly the 40 mixed.
    for slices in (1, 7, 4096):
        assert {tuple(r) for r in sample.exhausted_strata(units, targets, slices=slices).collect()} == {(1, "pair_timeline", "malicious")}
        got = sample.draw(units, targets, seed=3, slices=slices).collect()
        count = {}
        for r in got:
            count[r.plan_id, r.gold_label] = count.get((r.plan_id, r.gold_label), 0) + 1
        assert count == {(1, "benign"): 180, (1, "mixed"): 40, (2, "mixed"): 40}
        assert len({(r.plan_id, r.eval_unit_id) for r in got}) == len(got)
    one = {r.eval_unit_id for r in sample.draw(units, targets, 3, 7).collect() if r.plan_id == 1}
    assert one == {r.eval_unit_id for r in sample.draw(units, targets, 3, 4096).collect() if r.plan_id == 1}
    rep = {r.plan_id: r for r in sample.report(units, targets).collect()}
    assert rep[1].per_stratum_selected["pair_timeline:benign"] == 180 and rep[1].undersampled_strata == ["pair_timeline:malicious"]
    assert rep[3].total_selected == 0
    assert sample.draw(units.limit(0), targets).count() == 0
    # Reservoirs of any number of tasks and fills hold the same and are drawn from alike.
    sample.ROWS_AT_ONCE, usual = 20, sample.ROWS_AT_ONCE
    again = {r.eval_unit_id for r in sample.draw(units.repartition(6), targets, 3, 7).collect() if r.plan_id == 1}
    sample.ROWS_AT_ONCE = usual
    assert again == one
    assert sample.exhausted_strata(units.limit(0), targets).count() == 4  # all but the one that wants nothing


# ---- encoding

VOCAB = Path(encode.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCAB.exists(), reason="no public tokenizer")
ODD = ["", " ", "\n\n  \t x", "don't we'll THEY'RE", "a" * 5000, "ab" * 3000 + "é" * 999, "<|endoftext|> plain", "数据流 🙂🙂 ​­ ñ", "10.0.0.1:443 -> 172.16.0.9\r\n" * 20, " " * 3000 + "z", "!!!???" * 300, "\x00\x01�", "a b  c \td e\u00a0f 's ' s it's 'll x", "one, (two) 3.4  five;\nsix \u2009seven \x1f eight \x85 nine", " lead and trail "]


@needs_vocabulary
def test_ids_agree_with_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCAB.read_bytes().splitlines())}
    lib = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "x"), (1, " ")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = encode.encode(docs).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r.ids for r in got}
    assert by[99] == [] and by[None] == lib.encode_ordinary("x")
    for i, t in enumerate(ODD):
        assert by[i] == lib.encode_ordinary(t), t[:40]


def toy(merges):
    lines, have = [], [bytes([i]) for i in range(256)] + merges
    for i, t in enumerate(have):
        lines.append(base64.b64encode(t) + b" " + str(i).encode())
    return encode.Encoder(b"\n".join(lines))


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=30))
def test_dynamic_programme_against_merging(text):
    e = toy([b"ab", b"aa", b"aba", b"bb", b"abab", b"aab", b"bbb"])
    parts = list(text.encode())
    while len(parts) > 1:
        ranks = [e.id_of.get(e.token[x] + e.token[y], 1 << 60) for x, y in zip(parts, parts[1:])]
        if min(ranks) == 1 << 60:
            break
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [ranks[i]]
    assert e.piece(text.encode()) == parts


# ---- leaks


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for t in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != t), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 12), st.integers(0, 25), st.integers(1, 6), st.integers(0, 10**6))
def test_myers(m, n, rows, seed):
    r = np.random.default_rng(seed)
    patterns, texts = r.integers(1, 4, (rows, m)), r.integers(0, 4, (rows, n))
    assert leaks.myers(patterns, texts).tolist() == [plain_distance(p, t) for p, t in zip(patterns.tolist(), texts.tolist())]


def test_words():
    assert leaks.words("Ab­c​D, é1_x—数据!") == ["abcd", "é1", "x", "数据"]
    assert leaks.words(None) == leaks.words("…") == []


def test_leaks(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    item = {i: [r.choice(vocabulary) for _ in range(r.choice([8, 12, 30]))] for i in range(20)}
    docs = {}
    for k in range(120):
        words = [r.choice(vocabulary) for _ in range(30)]
        src = item[r.randrange(20)]
        take = src[r.randrange(3) :][: r.choice([6, 11, 12, 13, 25])]
        if r.random() < 0.3 and len(take) > 6:
            take[5] = "changed"
        at = r.randrange(30)
        docs[k] = words[:at] + take + words[at:]
    d = spark.createDataFrame([(k, " ,".join(v).upper()) for k, v in docs.items()] + [(500, None), (501, ""), (None, " ".join(item[2])), (0, " ,".join(docs[0]))], "doc_id long, text string")
    i = spark.createDataFrame([(k, "; ".join(v)) for k, v in item.items()] + [(None, "x"), (77, None)], "item_id long, text string")
    grams = lambda v: {tuple(v[a : a + 12]) for a in range(len(v) - 11)}
    want = {(k, j) for k, v in docs.items() for j, w in item.items() if grams(v) & grams(w)}
    for at_once in (20_000, 3):
        got = [tuple(x) for x in leaks.leaks(d, i, items_at_once=at_once).where("distance = 0").select("doc_id", "item_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    near = {(x.doc_id, x.item_id) for x in leaks.leaks(d, i).collect()}

    def close(v, w):
        return any(plain_distance(w[a : a + 12], v) <= 1 for a in range(len(w) - 11))

    assert near == {(k, j) for k, v in docs.items() for j, w in item.items() if len(w) >= 12 and close(v, w)}
    assert leaks.held(d.limit(0), i).count() == 0 and leaks.held(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("window,budget", [(12, 1), (12, 2), (13, 1), (5, 0), (9, 2)])
def test_matching_of_repetitive_texts(window, budget, monkeypatch):
    monkeypatch.setattr(leaks, "CANDIDATES", 50)
    r = random.Random(window * 10 + budget)
    item = {i: [r.choice("abc") for _ in range(r.choice([window - 1, window, window + 9]))] for i in range(12)}
    texts = [[r.choice("abcd") for _ in range(r.randrange(0, 40))] for _ in range(30)]
    found = {}
    for no, ids, d in leaks.Matcher([(i, " ".join(w)) for i, w in item.items()], window, budget).search([" ".join(t) for t in texts]):
        for key, v in zip(zip(no.tolist(), ids.tolist()), d.tolist()):
            assert key not in found
            found[key] = v
    best = {(n, i): min(plain_distance(w[a : a + window], t) for a in range(len(w) - window + 1)) for n, t in enumerate(texts) for i, w in item.items() if len(w) >= window}
    assert found == {k: v for k, v in best.items() if v <= budget}


# ---- shared spans


def brute_shared(texts, span):
    own = {}
    for i, t in texts.items():
        for k in range(len(t) - span + 1):
            own.setdefault(t[k : k + span], set()).add(i)
    out = {}
    for i, t in texts.items():
        cover = set()
        for k in range(len(t) - span + 1):
            if len(own[t[k : k + span]]) > 1:
                cover |= set(range(k, k + span))
        if cover:
            out[i] = len(cover)
    return out


@pytest.mark.parametrize("seed,gram,chunk", [(1, 5, 3), (2, 1, 1), (3, 12, 4), (4, 7, 16)])
def test_shared_spans_are_exact(spark, seed, gram, chunk):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé\U0001f642") for _ in range(r.choice([9, 13, 30, 60]))) for _ in range(12)]
    footer = "-- the common foot of all --"
    texts = {}
    for i in range(150):
        parts = [r.choice(pool)[r.randrange(4) :] if r.random() < 0.6 else "".join(r.choice("xyz ") for _ in range(r.randrange(20))) for _ in range(r.randrange(1, 6))]
        texts[i] = "".join(parts) + (footer[: r.randrange(10, 28)] if r.random() < 0.5 else "")
    texts[150] = texts[3] + texts[3]
    texts[151] = "q" * 200
    texts[152] = "q" * 90
    rows = [(i, t) for i, t in texts.items()] + [(900, None), (901, ""), (None, texts[3]), (5, texts[5])]
    got = {x.doc_id: x.shared_chars for x in spans.shared_chars(spark.createDataFrame(rows, "doc_id long, text string"), 12, gram, chunk).collect()}
    assert got == brute_shared(texts, 12)


def test_long_texts_in_parts(spark, monkeypatch):
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh") for _ in range(5000))
    texts = {1: base, 2: "zz" + base[1000:4100], 3: base[4000:4011]}
    monkeypatch.setattr(spans, "AT_ONCE", 700)
    rows = list(spans._run_rows(iter([pa.RecordBatch.from_pydict({"d": [1], "t": [base]})]), 12, 5, 700))
    starts = sorted((a, b) for x in rows for a, b in zip(x.column(6).to_pylist(), x.column(7).to_pylist()))
    assert starts[0][0] == 0 and starts[-1][1] == len(base) - 12 and all(b[0] == a[1] + 1 for a, b in zip(starts, starts[1:]))
    whole = spans.run_places(spans.code_points(base), np.zeros(len(base), int), 12, 5)
    assert starts == sorted(zip(whole[1].tolist(), whole[2].tolist()))
    got = {x.doc_id: x.shared_chars for x in spans.shared_chars(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 12, 5, 4).collect()}
    assert got == brute_shared(texts, 12)


def test_clusters_are_components(spark):
    r = random.Random(3)
    links = [(i, i - r.choice([1, 1, 2, 7])) for i in range(8, 60) if r.random() < 0.7] + [(100 + i, 100 + i - 1) for i in range(1, 40)] + [(5, 5), (9, 8), (9, 8)]
    parent = {x: x for p in links for x in p if p[0] != p[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {x.doc_id: x.cluster_id for x in spans.components(spark.createDataFrame(links, "doc_id long, low long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_filters_let_every_key_through(spark, monkeypatch):
    monkeypatch.setattr(spans, "FILTER_BITS", 128)
    rows = spark.range(300).withColumnRenamed("id", "k")
    kept = {x.k for x in spans.passing(rows, spans.filter_of(rows.where("k < 40"), "k"), "k").collect()}
    assert set(range(40)) <= kept and len(kept) < 300


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_clusters_of_spans(spark, bits, monkeypatch):
    monkeypatch.setattr(spans, "FILTER_BITS", bits)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    a, b, c = word(40), word(40), word(40)
    texts = {1: word(30) + a, 2: a + word(9) + b, 3: word(5) + b[3:] + word(20), 7: c, 8: c + word(3), 9: word(50)}
    got = {x.doc_id: (x.shared_chars, x.cluster_id) for x in spans.clusters(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 12, 5, 4).collect()}
    assert {k: v[0] for k, v in got.items()} == brute_shared(texts, 12)
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_no_documents(spark):
    assert spans.shared_chars(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_window_minima():
    v = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert spans.window_minima(v, 3).tolist() == [2, 2, 4, 5, 5]


def test_spans_at_the_edge_of_a_hashed_part(spark):
    edge, span, gram, chunk = spans.AT_ONCE, spans.SPAN, spans.GRAM, spans.CHUNK
    for seed in range(50):  # a text in which one run and one chunk lie on both sides of the edge, two windows deep
        text = np.random.default_rng(seed).integers(0x4E00, 0x9000, edge + 2000, dtype=np.uint32)
        r = spans.run_places(text[edge - 1000 : edge + 1000], np.zeros(2000, np.int64), span, gram)
        a, first, last = next((int(a), int(f), int(l)) for a, f, l in zip(*r) if f <= 1000 <= l)
        if first <= 998 and last >= 1001 and (a - 998) // chunk == (a - 1001) // chunk:
            break
    else:
        raise AssertionError("no such text")
    read = lambda codes: codes.tobytes().decode("utf-32-le")
    docs = [(1, read(text)), (2, read(text[edge - 700 : edge + 700])), (3, "<" + read(text[edge - 2 : edge - 2 + span]) + ">"), (4, "[" + read(text[edge + 1 : edge + 1 + span]) + "]")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    assert {r.doc_id: r.shared_chars for r in spans.shared_chars(df).collect()} == {1: 1400, 2: 1400, 3: 300, 4: 300}
