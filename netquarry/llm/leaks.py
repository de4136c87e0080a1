"""Evaluation texts in training text (problem 9).

Pigeonhole edit matching: every window of `words` consecutive words of an item
is split into budget + 1 pieces, so that a passage with at most `budget` word
edits keeps one piece whole. Exact hits of the pieces in a document give places,
and Myers' bit-parallel distance over words verifies the window there. A passage
that stands in full is a window at distance 0. Equal windows are one class, and
candidates are looked at in bounded numbers, so a passage that many items and
many texts share costs no more memory than one.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, BUDGET = 12, 1
#: Items a task holds at once; more of them are searched block by block.
ITEMS_AT_ONCE = 20_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_HIDDEN = {0x200B: None, 0xAD: None}


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits in lower case, after U+200B and U+00AD are removed."""
    if not text:
        return []
    if "\u200b" in text or "\xad" in text:
        text = text.translate(_HIDDEN)
    found = _WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else []


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each row's pattern (1 to 63 symbols above 0) to any stretch of the row's text, by bit-parallel columns over all rows at once; 0 in a text equals nothing."""
    n, m = patterns.shape
    if not 0 < m < 64:
        raise ValueError("a pattern must have 1 to 63 symbols")
    u = np.uint64
    bits = u(1) << np.arange(m, dtype=u)
    mask, top, one = u((1 << m) - 1), u(m - 1), u(1)
    vp, vn = np.full(n, mask), np.zeros(n, u)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for j in range(texts.shape[1]):
        eq = (patterns == texts[:, j : j + 1]) @ bits
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, vp & d0
        score += ((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64)
        hp, hn = hp << one, hn << one  # row 0 stays 0: a match may begin anywhere
        vp, vn = (hn | ~(d0 | hp)) & mask, hp & d0 & mask
        np.minimum(best, score, out=best)
    return best


def _piece_codes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit code of each stretch of `length` symbols. Equal stretches have equal codes; what collides besides is settled by the verification."""
    out = np.zeros(max(0, len(codes) - length + 1), np.uint64)
    for i in range(length):
        out = (out ^ codes[i : i + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] numbers, then the same for the next."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Matcher:
    """Pieces of the windows of a set of items, and the search for them in texts.

    Equal windows, in whatever items, are one class, which is searched and verified
    once; its items are put in at the end.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WORDS, budget: int = BUDGET):
        if window // (budget + 1) < 1 or window > 63:
            raise ValueError("each of the budget + 1 pieces needs a word, and a window has at most 63")
        self.window, self.budget, self.piece = window, budget, window // (budget + 1)
        self.number: dict[str, int] = {}
        codes, item_of, start_of, owners = array("i"), array("q"), array("q"), []
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if len(own) >= window:
                start_of.append(len(codes))
                item_of.append(item)
                owners.append(len(own))
                codes.extend(own)
        self.codes = np.array(codes, np.int32)
        whose = np.repeat(np.arange(len(owners)), owners)
        first, length = np.array(start_of, np.int64), np.array(owners, np.int64)
        at = _ranges(first, length - window + 1) if len(owners) else np.zeros(0, np.int64)
        hashed = _piece_codes(self.codes, window)[at]
        _, rep, cls = np.unique(hashed, return_index=True, return_inverse=True)
        same = np.ones(len(at), bool)
        for k in range(window):
            same &= self.codes[at + k] == self.codes[at[rep[cls]] + k]
        lone = np.flatnonzero(~same)  # another window's code by chance: a class of its own
        cls[lone] = len(rep) + np.arange(len(lone))
        #: Place of one window of each class.
        self.at = np.concatenate([at[rep], at[lone]]).astype(np.int64)
        numbers = np.array(item_of, np.int64)[whose[at]] if len(at) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([cls, numbers], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(self.at) + 1))
        # Pieces: hash -> (class, which piece of the window), by hash.
        pieces = _piece_codes(self.codes, self.piece)
        j = np.repeat(np.arange(budget + 1), len(self.at))
        hashed = pieces[np.tile(self.at, budget + 1) + j * self.piece] if len(self.at) else np.zeros(0, np.uint64)
        order = np.argsort(hashed, kind="stable")
        self.cls, self.nth = np.tile(np.arange(len(self.at)), budget + 1)[order], j[order]
        self.known, begin = np.unique(hashed[order], return_index=True)
        self.bounds = np.append(begin, len(order))

    def search(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of texts, items, least distances of any window of the item there), each text and item once, some texts at a time."""
        w, b = self.window, self.budget
        pad = [0] * (w + b)
        codes, owner = array("i", pad), array("i", [-1] * len(pad))
        get = self.number.get
        for i, t in enumerate(texts):
            own = [get(x, 0) for x in words(t)]
            codes.extend(own + pad)
            owner.extend([i] * (len(own) + len(pad)))
        codes, owner = np.array(codes, np.int32), np.array(owner, np.int32)
        if not len(self.known) or len(codes) < 2 * len(pad):
            return
        hashed = _piece_codes(codes, self.piece)
        slot = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        hits = np.flatnonzero((self.known[slot] == hashed) & (codes[: len(hashed)] > 0))
        slot = slot[hits]
        count = self.bounds[slot + 1] - self.bounds[slot]
        upto = np.concatenate([[0], np.cumsum(count)])
        # Texts are taken together up to CANDIDATES, so what is held of results is bounded by the items of a few texts.
        ends = np.flatnonzero(np.diff(owner[hits], append=-1))
        lo = 0
        while lo < len(hits):
            fits = ends[(ends >= lo) & (upto[ends + 1] - upto[lo] <= CANDIDATES)]
            hi = int(fits[-1] if len(fits) else ends[np.searchsorted(ends, lo)]) + 1
            found = [self._verified(codes, hits[lo:hi], slot[lo:hi], owner, c, min(c + CANDIDATES, int(upto[hi] - upto[lo]))) for c in range(0, int(upto[hi] - upto[lo]), CANDIDATES)]
            if found:
                yield from self._expanded(np.concatenate(found))
            lo = hi

    def _verified(self, codes, hits, slot, owner, lo: int, hi: int) -> np.ndarray:
        """Distinct (text, class, distance) within the budget among the candidates lo to hi of some hits."""
        count = self.bounds[slot + 1] - self.bounds[slot]
        upto = np.cumsum(count)
        flat = np.arange(lo, hi)
        row = np.searchsorted(upto, flat, "right")
        entry = self.bounds[slot[row]] + flat - (upto[row] - count[row])
        cls, nth = self.cls[entry], self.nth[entry]
        place = hits[row] - nth * self.piece
        if self.budget == 1 and self.window == 2 * self.piece:  # the other half is the same up to one edit, seen from the piece that was hit
            keep = np.flatnonzero(self._near(codes, self.at[cls], place, nth))
            row, cls, place = row[keep], cls[keep], place[keep]
        reach = np.arange(-self.budget, self.window + self.budget)
        around = codes[np.clip(place[:, None] + reach, 0, len(codes) - 1)]  # both ends are 0
        # Equal stretches of text against one class are verified once.
        key = np.zeros(len(place), np.uint64)
        for k in range(len(reach)):
            key = (key ^ around[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        order = np.lexsort((key, cls))
        new = np.ones(len(order), bool)
        new[1:] = (cls[order[1:]] != cls[order[:-1]]) | (around[order[1:]] != around[order[:-1]]).any(1)
        one = order[new]
        d = np.concatenate([np.zeros(0, np.int64), *(myers(self.codes[self.at[cls[x]][:, None] + np.arange(self.window)], around[x]) for x in np.split(one, range(50_000, len(one), 50_000)) if len(x))])
        distance = np.empty(len(order), np.int64)
        distance[order] = d[np.cumsum(new) - 1] if len(order) else d
        ok = distance <= self.budget
        return np.unique(np.stack([owner[hits[row[ok]]].astype(np.int64), cls[ok], distance[ok]], 1), axis=0)

    def _near(self, codes: np.ndarray, at: np.ndarray, place: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Whether the rest of a window, outwards from the piece that was hit, agrees with the text up to one edit."""
        rest = np.where(nth == 0, self.window - self.piece, self.piece)
        step = np.where(nth == 0, 1, -1)
        own, text = np.where(nth == 0, at + self.piece, at + self.piece - 1), np.where(nth == 0, place + self.piece, place + self.piece - 1)
        good = [np.zeros(len(at), np.int64) for _ in range(3)]  # words matched from the far end back, at shift -1, 0, 1
        top = len(codes) - 1
        for k in range(int(rest.max()) if len(rest) else 0):  # from the far end towards the piece
            i = rest - 1 - k
            live = i >= 0
            mine = self.codes[np.where(live, own + step * i, 0)]
            for s in range(3):
                same = live & (mine == codes[np.clip(text + step * (i + s - 1), 0, top)]) & (good[s] == k)
                good[s] += same
        ahead = np.zeros(len(at), np.int64)
        for k in range(int(rest.max()) if len(rest) else 0):
            same = (k < rest) & (ahead == k) & (self.codes[np.where(k < rest, own + step * k, 0)] == codes[np.clip(text + step * k, 0, top)])
            ahead += same
        return (ahead + good[1] >= rest - 1) | (ahead + good[2] >= rest) | (ahead + good[0] >= rest - 1)

    def _expanded(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Classes replaced by their items, text by text: each item once with its least distance."""
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        for part in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
            if not len(part):
                continue
            begin, count = self.items_from[part[:, 1]], self.items_from[part[:, 1] + 1] - self.items_from[part[:, 1]]
            item, distance = self.items[_ranges(begin, count)], np.repeat(part[:, 2], count)
            order = np.lexsort((distance, item))
            item, distance = item[order], distance[order]
            first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
            yield np.full(len(first), part[0, 0]), item[first], distance[first]


#: Candidates looked at together.
CANDIDATES = 262_144
#: Characters of text searched at once.
AT_ONCE = 2_000_000


def _search(batches: Iterator[pa.RecordBatch], items, window: int, budget: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items.value, window, budget)

    def answer(docs, texts) -> Iterator[pa.RecordBatch]:
        numbers, waiting, held = np.array(docs, np.int64), [], 0
        for found in matcher.search(texts):
            waiting.append(found)
            held += len(found[0])
            if held >= CANDIDATES:
                yield batch(numbers, waiting)
                waiting, held = [], 0
        if waiting:
            yield batch(numbers, waiting)

    def batch(numbers, waiting) -> pa.RecordBatch:
        no, item, distance = (np.concatenate(x) for x in zip(*waiting))
        return pa.RecordBatch.from_arrays([pa.array(numbers[no]), pa.array(item), pa.array(distance)], ["doc_id", "item_id", "distance"])

    for b in batches:
        docs, texts, size = [], [], 0
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            docs.append(doc), texts.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from answer(docs, texts)
                docs, texts, size = [], [], 0
        if docs:
            yield from answer(docs, texts)


def leaks(documents: DataFrame, items: DataFrame, window: int = WORDS, budget: int = BUDGET, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, distance): documents that hold a window of an item with at most `budget` word edits.

    distance is the least of any window, 0 where `window` consecutive words stand
    in full. Items shorter than a window, null ids and null texts find nothing;
    repeated documents count once per doc_id. The held-out set is a stated query
    set: it goes to the tasks in blocks of items_at_once, each against all
    documents.
    """
    spark = documents.sparkSession
    listed = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    last: int | None = None
    while True:
        rows = (listed if last is None else listed.where(F.col("item_id") > last)).orderBy("item_id").limit(items_at_once + 1).collect()
        block = [(r.item_id, r.text) for r in rows]
        if len(block) > items_at_once:  # repeats of the id at the edge go with the next block
            edge = block[-1][0]
            block = [x for x in block if x[0] < edge]
            if not block:
                raise ValueError("one item_id repeats more often than items_at_once")
        sent = spark.sparkContext.broadcast(block)
        part = docs.mapInArrow(lambda it, sent=sent: _search(it, sent, window, budget), "doc_id long, item_id long, distance long")
        out = part if out is None else out.unionByName(part)
        if len(rows) <= items_at_once:
            break
        last = block[-1][0]
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def held(documents: DataFrame, items: DataFrame, window: int = WORDS) -> DataFrame:
    """(doc_id, item_id) with `window` consecutive words in common: the leaks at distance 0."""
    return leaks(documents, items, window).where("distance = 0").select("doc_id", "item_id")
