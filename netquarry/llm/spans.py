"""Long exact spans shared between documents (problem 10).

A character counts if a window of `span` characters around it stands in another
document too. Fixed paragraphs would miss spans that cross or part paragraphs, so
the blocks that are banded are all windows, overlapping by all but one character:
the MinHash of a window over its `gram`-character grams (one band of one row) is
its anchor. Equal windows have equal anchors, so this band has a recall of
exactly 1. Consecutive windows with one anchor form a run. Runs whose anchor
stands in two documents collide and are verified by 128-bit fingerprints of the
whole content (a Jaccard similarity of 1 and an edit distance of 0), coarse to fine:

1. a run's whole text stands in another document: all its windows do;
2. else, chunks of `CHUNK` neighbouring windows: if the text common to them
   stands nowhere else, none does; if the text they span does, all do;
3. else each window of the chunk by itself.

Every step is a grouped count of distinct documents (least and greatest id), so
nothing is ever paired within a group, and a group of any size is pre-aggregated.
A class of equal texts that is settled sends one representative to the next step,
so that the open members of its group can still meet it. Of the texts themselves
only the snippets around open runs are carried on, cut out when these meet their
documents, of which a filter of fixed size lets few others through.

Documents that share a class are linked to its least document; the components of
these links are the clusters among which removals would be decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.session import cut

SPAN, GRAM, CHUNK = 300, 96, 16
#: Characters a task hashes at once; longer texts are taken in overlapping parts.
AT_ONCE = 1_000_000
#: Bits of a filter that goes to all tasks: 2^18 words, 4 MB, whatever the data. What it lets through by chance costs time, never rows.
FILTER_BITS = 1 << 24
_U = np.uint64
#: Odd bases and seeds of the two independent polynomial fingerprints.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEEDS = (0x1234567, 0x89ABCDEF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        have = _powers[which, inverse] = np.cumprod(steps, dtype=_U)
    return have[:n]


class Prints:
    """Prefix sums of a text's characters, from which any window's fingerprint follows."""

    def __init__(self, codes: np.ndarray, both: bool = True):
        self.sums = []
        for i in range(2 if both else 1):
            terms = _mix(codes.astype(_U) + _U(_SEEDS[i])) * _power(i, len(codes))
            self.sums.append(np.concatenate([np.zeros(1, _U), np.cumsum(terms, dtype=_U)]))

    def window(self, i: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[i]
        raw = (s[end] - s[start]) * _power(i, len(s), inverse=True)[start]
        return _mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value (the rightmost of equals) in each window of `width` values."""
    best, n = np.arange(len(values)), 1
    while n < width:
        step = min(n, width - n)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] <= values[a], b, a)
        n += step
    return best


def run_places(codes: np.ndarray, owner: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of the runs of a stretch of texts laid end to end; owner numbers the text of each character. first and last are a run's first and last window start."""
    none = np.zeros(0, np.int64)
    if len(codes) < span:
        return none, none, none
    p = Prints(codes, both=False)
    at = np.arange(len(codes) - gram + 1)
    best = window_minima(p.window(0, at, at + gram), span - gram + 1)
    starts = np.flatnonzero(owner[: len(codes) - span + 1] == owner[span - 1 :])
    anchor = best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    return anchor[heads], starts[heads], starts[np.append(heads[1:], len(starts)) - 1] if len(heads) else none


def _long_places(codes: np.ndarray, span: int, gram: int, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of one long text, found in overlapping parts; a run that crosses parts is put together again."""
    found = []
    for s in range(0, len(codes) - span + 1, at_once):
        part = codes[s : s + at_once + span - 1]
        found.append([x + s for x in run_places(part, np.zeros(len(part), np.int8), span, gram)])
    anchor, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    heads = np.flatnonzero(new)
    return anchor[heads], first[heads], last[np.append(heads[1:], len(anchor)) - 1]


def fingerprints(codes: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Both fingerprints of windows of one text or of texts laid end to end, in parts if they are long."""
    out = np.zeros((2, len(start)), _U)
    part = start // at_once
    for k in np.unique(part):
        which = np.flatnonzero(part == k)
        lo, hi = int(start[which].min()), int(end[which].max())
        p = Prints(codes[lo:hi])
        for i in (0, 1):
            out[i, which] = p.window(i, start[which] - lo, end[which] - lo)
    return out[0].view(np.int64), out[1].view(np.int64)


_RUN = "doc_id long, g1 long, g2 long, c1 long, c2 long, anchor long, first long, last long, multi boolean"


def _rows(doc, g, c, anchor, first, last, multi) -> pa.RecordBatch:
    cols = [doc, *g, *c, anchor, first, last]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(multi, pa.bool_())], [f.split()[0] for f in _RUN.split(", ")])


def _run_rows(batches: Iterator[pa.RecordBatch], span: int, gram: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """The runs of texts, grouped by the fingerprint of the anchor's gram and classed by those of the whole run."""

    def told(ids, codes, owner, begin) -> pa.RecordBatch:
        anchor, first, last = run_places(codes, owner, span, gram) if len(codes) <= at_once + span else _long_places(codes, span, gram, at_once)
        own = owner[first]
        g, c = fingerprints(codes, anchor, anchor + gram, at_once)[0], fingerprints(codes, first, last + span, at_once)
        shift = begin[own]
        return _rows(ids[own], (g, np.zeros(len(own), np.int64)), c, anchor - shift, first - shift, last - shift, np.zeros(len(own), bool))

    for b in batches:
        ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        lo, held = 0, 0
        for i in range(len(ids) + 1):
            if i < len(ids) and held + int(length[i]) <= at_once:
                held += int(length[i])
                continue
            if lo < i:
                yield told(*_laid(ids[lo:i], texts.slice(lo, i - lo)))
            lo, held = i, 0
            if i < len(ids):
                if length[i] > at_once:
                    yield told(*_laid(ids[i : i + 1], texts.slice(i, 1)))
                    lo = i + 1
                else:
                    held = int(length[i])


def _laid(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end: (ids, code points, number of each one's text, first place of each text)."""
    each = [code_points(t) for t in texts.to_pylist()]
    lengths = [len(c) for c in each]
    return ids, np.concatenate(each), np.repeat(np.arange(len(each)), lengths), np.cumsum([0, *lengths])[:-1]


def _counted(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): for each row its start, start + 1, ... for as many as its count."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _few(batches: Iterator[pa.RecordBatch], column: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a column have about at_once characters together."""
    for b in batches:
        upto = np.cumsum(pc.utf8_length(b.column(column)).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.searchsorted(upto, np.arange(at_once, int(upto[-1]) if len(upto) else 0, at_once), "right"))
        bounds = [0, *(int(c) for c in cuts if 0 < c < b.num_rows), b.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _chunk_rows(batches: Iterator[pa.RecordBatch], span: int, gram: int, chunk: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Chunks of the runs in snippets (doc_id, anchor, first, last, multi, base, snippet), grouped by the text common to their windows and classed by the text they span."""
    most = span - gram
    for b in _few(batches, 6, at_once):
        doc, anchor, first, last, multi, base = _columns(b, "doc_id", "anchor", "first", "last", "multi", "base")
        _, codes, _, begin = _laid(doc, b.column(6))
        ends = np.append(begin[1:], len(codes))
        low, high = (anchor - last) // chunk, (anchor - first) // chunk
        row, c = _counted(low, high - low + 1)
        a, o1 = anchor[row], c * chunk
        o2 = np.minimum(o1 + chunk - 1, most)
        to = begin[row] - base[row]  # from places in the text to places in the codes
        g = fingerprints(codes, a - o1 + to, a - o2 + span + to, at_once)
        # A chunk that begins or ends outside the text has no class of its own: 0.
        fits = (a - o2 + to >= begin[row]) & (a - o1 + span + to <= ends[row])
        f = np.zeros((2, len(a)), np.int64)
        f[:, fits] = fingerprints(codes, (a - o2 + to)[fits], (a - o1 + span + to)[fits], at_once)
        yield _rows(doc[row], g, f, a, np.maximum(a - o2, first[row]), np.minimum(a - o1, last[row]), multi[row])


def _window_rows(batches: Iterator[pa.RecordBatch], span: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Each window of pieces (doc_id, first, last, multi, piece), the piece being the text from the first window's start to the last one's end."""
    for b in _few(batches, 4, at_once):
        doc, first, last, multi = _columns(b, "doc_id", "first", "last", "multi")
        _, codes, _, begin = _laid(doc, b.column(4))
        row, x = _counted(first, last - first + 1)
        at = begin[row] + x - first[row]
        k1, k2 = fingerprints(codes, at, at + span, at_once)
        yield pa.RecordBatch.from_pydict({"doc_id": doc[row], "k1": k1, "k2": k2, "first": x, "multi": multi[row]})


def _spot(*keys: str):
    """Word and bit of a key in a filter."""
    h = f"xxhash64({', '.join(keys)})"
    return F.expr(f"cast(pmod({h}, {FILTER_BITS >> 6}) as int)").alias("_word"), F.expr(f"cast(pmod(shiftright({h}, 40), 64) as int)").alias("_bit")


def filter_of(rows: DataFrame, *keys: str) -> DataFrame:
    """A filter of FILTER_BITS that lets every key of rows through: (word, bits), a row a word with a bit."""
    word, bit = _spot(*keys)
    return rows.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))


def passing(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """The rows that a filter lets through, in one pass over them."""
    word, bit = _spot(*keys)
    return rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(seen), "_word").where("_bits & shiftleft(1L, _bit) != 0").select(*rows.columns)


GROUP, CLASS = ["g1", "g2"], ["g1", "g2", "c1", "c2"]
PLACE = ["doc_id", "anchor", "first", "last"]


def _decided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of rows grouped by g and classed by c.

    settled, with the least document of its class as `low`: the class stands in two
    documents. open: the class does not, but its group does; with them goes one
    row, marked multi, for each settled class of a group that has open members.
    Rows with c1 = 0 have no class of their own. Classes are aggregated before
    groups, so a group of any size arrives as its classes.
    """
    settled = (F.col("c1") != 0) & ((F.col("low") != F.col("high")) | F.col("any"))
    classes = rows.groupBy(*CLASS).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bool_or("multi").alias("any"), *[F.first(c).alias(c) for c in PLACE]).withColumn("settled", settled)
    groups = classes.groupBy(*GROUP).agg(F.min("low").alias("_l"), F.max("high").alias("_h"), F.bool_or("any").alias("_m"), F.bool_or(~F.col("settled")).alias("asked"))
    known = cut(classes.join(groups.where("_l != _h or _m").select(*GROUP, "asked"), GROUP))
    told = cut(rows.join(known.select(*CLASS, "low", "settled"), CLASS))
    again = known.where("settled and asked").select(*PLACE, F.lit(True).alias("multi"))
    return told.where("settled"), told.where("not settled").select(*PLACE, "multi").unionByName(again)


def shared_starts(documents: DataFrame, span: int = SPAN, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, first, last, low): ranges of window starts of each text; every window of `span` characters that stands in another document begins in one of them. low is the least document of a class that holds these windows. Ranges of one text are disjoint or equal."""
    if not 0 < gram <= span or chunk < 1:
        raise ValueError("0 < gram <= span and chunk > 0 must hold")
    at_once = AT_ONCE
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.char_length("text") >= span)
    runs = cut(docs.mapInArrow(lambda it: _run_rows(it, span, gram, at_once), _RUN))
    # Collisions: anchors that stand in two documents. The filter keeps all of them, and some runs that go nowhere in what follows.
    collided = runs.groupBy("g1").agg(F.min("doc_id").alias("l"), F.max("doc_id").alias("h")).where("l != h")
    settled, left = _decided(passing(runs, filter_of(collided, "g1"), "g1"))
    found = [settled.where("not multi").select("doc_id", "first", "last", "low")]

    left = cut(left)
    texts = passing(docs, filter_of(left, "doc_id"), "doc_id")
    base = F.greatest(F.lit(0), F.col("first") - (chunk - 1)).cast("long")
    snippet = F.substring("text", (F.col("base") + 1).cast("int"), (F.col("last") - F.col("base") + chunk - 1 + span).cast("int"))
    snippets = cut(left.withColumn("base", base).join(texts, "doc_id").select(*PLACE, "multi", "base", snippet.alias("snippet")).dropDuplicates(["doc_id", "anchor"]))
    settled, left = _decided(cut(snippets.mapInArrow(lambda it: _chunk_rows(it, span, gram, chunk, at_once), _RUN)))
    found.append(settled.where("not multi").select("doc_id", "first", "last", "low"))

    piece = F.substring("snippet", (F.col("first") - F.col("base") + 1).cast("int"), (F.col("last") - F.col("first") + span).cast("int"))
    pieces = left.join(snippets.select("doc_id", "anchor", "base", "snippet"), ["doc_id", "anchor"]).select("doc_id", "first", "last", "multi", piece.alias("piece"))
    windows = cut(pieces.mapInArrow(lambda it: _window_rows(it, span, at_once), "doc_id long, k1 long, k2 long, first long, multi boolean"))
    keys = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("h"), F.bool_or("multi").alias("m")).where("low != h or m").select("k1", "k2", "low")
    found.append(windows.where("not multi").join(keys, ["k1", "k2"]).select("doc_id", "first", F.col("first").alias("last"), "low"))
    return reduce(DataFrame.unionByName, found)


def covered(starts: DataFrame, span: int) -> DataFrame:
    """(doc_id, shared_chars): length of the union of the windows that begin in each document's ranges. A range counts up to where the next one begins, so one look at the next is enough."""
    after = F.lead("first").over(Window.partitionBy("doc_id").orderBy("first"))
    own = F.least(F.col("last") + span, F.coalesce(after, F.col("last") + span)) - F.col("first")
    return starts.select("doc_id", own.alias("n")).groupBy("doc_id").agg(F.sum("n").alias("shared_chars"))


def shared_chars(documents: DataFrame, span: int = SPAN, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, shared_chars): each document with a character inside a span of `span` or more code points that stands verbatim in another document, and how many such characters it has.

    Null and short texts and null ids have none. Rows that repeat a doc_id hold
    the same text and are one document; copies under other ids share everything.
    """
    return covered(shared_starts(documents, span, gram, chunk), span)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, cluster_id) of each end of links(doc_id, low): the least id that the links lead to.

    Every round each document takes the least label at the other ends of its links,
    and then its label's label; rounds end when nothing changes. Links of one hub
    are many rows of one key, whose minimum is taken before they meet.
    """
    links = cut(links.where("doc_id != low").distinct())
    both = cut(links.select("doc_id", "low").unionByName(links.select(F.col("low").alias("doc_id"), F.col("doc_id").alias("low"))))
    labels = cut(both.groupBy("doc_id").agg(F.min("low").alias("m")).select("doc_id", F.least("doc_id", "m").alias("cluster_id")))
    while True:
        far = both.join(labels.withColumnRenamed("doc_id", "low"), "low").groupBy("doc_id").agg(F.min("cluster_id").alias("m"))
        near = labels.join(far, "doc_id").select("doc_id", F.least("cluster_id", "m").alias("c"), F.col("cluster_id").alias("was"))
        jump = labels.select(F.col("doc_id").alias("c"), F.col("cluster_id").alias("j"))
        new = cut(near.join(jump, "c", "left").select("doc_id", F.coalesce("j", "c").alias("cluster_id"), "was"))
        if new.where("cluster_id != was").isEmpty():
            return new.select("doc_id", "cluster_id")
        labels = new.select("doc_id", "cluster_id")


def clusters(documents: DataFrame, span: int = SPAN, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, shared_chars, cluster_id): the documents of shared_chars with the component of documents that shared spans link, named by its least document."""
    starts = cut(shared_starts(documents, span, gram, chunk))
    found = components(starts.select("doc_id", "low"))
    return covered(starts, span).join(found, "doc_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "doc_id"))
