"""Bit-sliced counters over sparse, word-aligned bitmaps.

A counter holds one unsigned number a position, stored by binary digit: plane i
is a bitmap of the positions whose number has bit i. Only 64-bit words with a
set bit in some plane are kept. Two counters are added plane by plane with a
carry bitmap, all positions at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64


@dataclass
class Sliced:
    words: np.ndarray  # ascending numbers of the kept 64-bit words
    planes: np.ndarray  # uint64 [digits, len(words)]

    @staticmethod
    def empty() -> Sliced:
        return Sliced(np.zeros(0, np.int64), np.zeros((0, 0), _U))

    @staticmethod
    def of(positions: np.ndarray, values: np.ndarray) -> Sliced:
        """positions ascending and unique; values unsigned."""
        if not len(positions):
            return Sliced.empty()
        words, starts = np.unique(positions >> 6, return_index=True)
        bit = (positions & 63).astype(_U)
        values = values.astype(_U)
        digits = int(values.max()).bit_length()
        planes = np.empty((digits, len(words)), _U)
        for i in range(digits):
            planes[i] = np.bitwise_or.reduceat(((values >> _U(i)) & _U(1)) << bit, starts)
        return Sliced(words, planes)

    def spread(self, words: np.ndarray) -> np.ndarray:
        """The planes over a superset of the words."""
        out = np.zeros((len(self.planes), len(words)), _U)
        out[:, np.searchsorted(words, self.words)] = self.planes
        return out

    def __add__(self, other: Sliced) -> Sliced:
        if not len(self.words) or not len(other.words):
            return other if not len(self.words) else self
        words = np.union1d(self.words, other.words)
        a, b = self.spread(words), other.spread(words)
        if len(a) < len(b):
            a, b = b, a
        carry = np.zeros(len(words), _U)
        for i in range(len(a)):
            x = a[i]
            if i < len(b):
                half = x ^ b[i]
                carry, a[i] = (x & b[i]) | (half & carry), half ^ carry
            elif carry.any():
                carry, a[i] = x & carry, x ^ carry
            else:
                break
        if carry.any():
            a = np.vstack([a, carry])
        return Sliced(words, a)

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The numbers at ascending positions (0 where nothing was counted)."""
        out = np.zeros(len(positions), _U)
        if not len(self.words) or not len(positions):
            return out
        w = np.searchsorted(self.words, positions >> 6)
        w = np.minimum(w, len(self.words) - 1)
        hit = self.words[w] == positions >> 6
        bit = (positions & 63).astype(_U)
        for i in range(len(self.planes)):
            out |= ((self.planes[i][w] >> bit) & _U(1)) << _U(i)
        return np.where(hit, out, _U(0))

    def positions(self) -> np.ndarray:
        """Ascending positions with a number above 0."""
        if not len(self.words) or not len(self.planes):
            return np.zeros(0, np.int64)
        any_ = np.bitwise_or.reduce(self.planes, axis=0)
        bits = np.unpackbits(any_.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, b = np.nonzero(bits)
        return self.words[w] * 64 + b


@dataclass
class TypedState:
    """Count, total and first and last time a (type, entity) position. Times are arrays aligned with the positions of the counter."""

    count: Sliced
    plus: Sliced  # totals of values above 0
    minus: Sliced  # totals of values below 0, sign dropped
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def empty() -> TypedState:
        z = np.zeros(0, np.int64)
        return TypedState(Sliced.empty(), Sliced.empty(), Sliced.empty(), z, z, z)

    @staticmethod
    def of_rows(position: np.ndarray, value: np.ndarray, time: np.ndarray) -> TypedState:
        if not len(position):
            return TypedState.empty()
        order = np.argsort(position, kind="stable")
        position, value, time = position[order], value[order], time[order]
        at, starts = np.unique(position, return_index=True)
        count = np.diff(np.append(starts, len(position)))
        plus = np.add.reduceat(np.maximum(value, 0), starts)
        minus = np.add.reduceat(np.maximum(-value, 0), starts)
        less = minus > 0
        return TypedState(Sliced.of(at, count), Sliced.of(at[plus > 0], plus[plus > 0]), Sliced.of(at[less], minus[less]), at, np.minimum.reduceat(time, starts), np.maximum.reduceat(time, starts))

    def __add__(self, other: TypedState) -> TypedState:
        at = np.concatenate([self.at, other.at])
        order = np.argsort(at, kind="stable")
        at, starts = np.unique(at[order], return_index=True)
        first = np.concatenate([self.first, other.first])[order]
        last = np.concatenate([self.last, other.last])[order]
        if len(at):
            first, last = np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)
        return TypedState(self.count + other.count, self.plus + other.plus, self.minus + other.minus, at, first, last)

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Count and total at each position."""
        return self.count.at(self.at).astype(np.int64), self.plus.at(self.at).astype(np.int64) - self.minus.at(self.at).astype(np.int64)

    def moved(self, to: np.ndarray, chosen: np.ndarray) -> TypedState:
        """The state of the chosen rows (ascending indexes into `at`), each moved to the new position that `to` gives for it."""
        old, new = self.at[chosen], to[chosen]
        order = np.argsort(new, kind="stable")
        new = new[order]
        parts = []
        for s in (self.count, self.plus, self.minus):
            v = s.at(old)[order]
            parts.append(Sliced.of(new[v > 0], v[v > 0]))
        return TypedState(*parts, new, self.first[chosen][order], self.last[chosen][order])
