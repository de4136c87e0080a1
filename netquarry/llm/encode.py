"""Encoding of the corpus with a public byte-level BPE (problem 8).

For every prefix of a piece of text, dynamic programming stores the last token
of its encoding: among the vocabulary entries that end the prefix, found by an
automaton over the vocabulary, the one whose pair with the last token of the
rest is compatible. It is unique. Following the back-pointers gives the ids, in
time linear in the piece however long it is.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts text before merging, of the byte-level BPE with 50 257 ids.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary beyond this is not broadcast.
MAX_VOCABULARY_MB = 64
#: A blank between two printable ASCII characters always begins a piece of the pattern, so a text may be parted there first.
_BLANK = re.compile(r"(?<=[!-~])(?= [!-~])")
#: Stretches, and pieces, whose ids a worker remembers, and the longest remembered.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64


_DIGIT = re.compile("[0-9]")


def _remember(known: dict[str, array], text: str, ids: array) -> None:
    if len(text) <= REMEMBERED_CHARS:
        if len(known) >= REMEMBERED:
            known.clear()
        known[text] = ids


class Encoder:
    """Exact ids of one byte-level BPE whose ids are its merge ranks."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.id_of: dict[bytes, int] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.id_of[base64.b64decode(token)] = int(rank)
        self.token = {i: t for t, i in self.id_of.items()}
        self.parts = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, float]]] = {}
        self.whole: dict[int, bool] = {}
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.known: dict[str, array] = {}  # ids of stretches
        self.pieces: dict[str, array] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; none for single bytes."""
        text = self.token[token]
        if len(text) == 1:
            return None
        if token not in self.halves:
            # Applied in rank order up to its own rank, the merges leave exactly the two halves.
            parts = [self.id_of[text[i : i + 1]] for i in range(len(text))]
            while len(parts) > 2:
                merged = [self.id_of.get(self.token[a] + self.token[b], 1 << 60) for a, b in zip(parts, parts[1:])]
                best = min(merged)
                if best >= token:
                    raise ValueError(f"token {token} is not made of earlier ones")
                i = merged.index(best)
                parts[i : i + 2] = [best]
            self.halves[token] = (parts[0], parts[1])
        return self.halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, float]]:
        """Tokens at one edge over the merging of `token`: (bytes, time it appears, time it is consumed); single bytes appear at -1."""
        out = self.edges.get((token, side))
        if out is None:
            out, gone, at = [], float("inf"), token
            while True:
                halves = self.split(at)
                out.append((self.token[at], -1 if halves is None else at, gone))
                if halves is None:
                    break
                gone, at = at, halves[side]
            self.edges[token, side] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves exactly these two: no merge across the border ever comes first."""
        found = self.pair_ok.get((a, b))
        if found is None:
            found = True
            for u, u_from, u_to in self._edge(a, 1):
                for v, v_from, v_to in self._edge(b, 0):
                    across = self.id_of.get(u + v)
                    # Merges of equal rank go from left to right: at the same rank, u is consumed before the border, v after it.
                    if across is not None and max(u_from, v_from) < across and across < u_to and across <= v_to:
                        found = False
            if len(self.pair_ok) > 2_000_000:
                self.pair_ok.clear()
            self.pair_ok[a, b] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        whole = self.id_of.get(data)
        if whole is not None and self._stands(whole):
            return [whole]
        ends: list[list[tuple[int, int]]] = [[] for _ in data]
        for end, match in self.automaton.iter(data.decode("latin-1")):
            ends[end].append(match)
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            for n, token in sorted(ends[end - 1], reverse=True):
                rest = end - n
                if (rest == 0 or last[rest] >= 0 and self.compatible(last[rest], token)) and self._stands(token):
                    last[end], size[end] = token, n
                    break
        out, end = [], len(data)
        while end:
            if last[end] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _stands(self, token: int) -> bool:
        """Whether the bytes of a token encode to the token itself."""
        found = self.whole.get(token)
        if found is None:
            try:
                self.split(token)
                found = True
            except ValueError:
                found = False
            self.whole[token] = found
        return found

    def stretch(self, text: str) -> array:
        """Ids of a stretch of text that begins and ends at borders of the pattern."""
        out = array("i")
        for part in self.parts.findall(text):
            ids = self.pieces.get(part)
            if ids is None:
                ids = array("i", self.piece(part.encode("utf-8", "replace")))
                _remember(self.pieces, part, ids)
            out += ids
        if len(text) <= 8 or not _DIGIT.search(text):  # addresses and long numbers seldom return
            _remember(self.known, text, out)
        return out

    def encode(self, text: str, out: array) -> None:
        """Adds the ids of a text to out."""
        get = self.known.get
        for part in _BLANK.split(text):
            ids = get(part)
            out += self.stretch(part) if ids is None else ids


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def _encode(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(ranks.value)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            ids, ends = array("i"), [0]
            for text in part.column(1).to_pylist():
                if text:
                    encoder.encode(text, ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; their strings in a text are ordinary text.

    Empty and null texts have the empty list. Repeated rows stay repeated, a null
    doc_id stays null. The vocabulary file is read by the driver and broadcast;
    its size is checked.
    """
    spark: SparkSession = documents.sparkSession
    path = Path(vocabulary)
    if path.stat().st_size > MAX_VOCABULARY_MB * 1_000_000:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_MB} MB")
    ranks = spark.sparkContext.broadcast(path.read_bytes())
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _encode(it, ranks), "doc_id long, ids array<int>")
