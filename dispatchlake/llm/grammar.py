"""A run-length grammar of many sequences by recompression, and extension queries on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Odd multipliers deal the symbols of a level to its two sides by their highest bit.
_ODD, _TURN = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_HIGH = np.uint64(63)


@dataclass(frozen=True)
class Level:
    """The symbols of one level, and what becomes of them on the next.

    ``parent`` is the place of the next level's symbol that a symbol goes into,
    ``first`` the place of the first symbol of each of those (and the length at
    the end). ``right`` tells which symbols can only end a pair; it is None where
    runs of equal symbols are compressed.
    """

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    right: np.ndarray | None


class Grammar:
    """Recompression of sequences of non-negative numbers.

    Rounds alternate: every maximal run a…a becomes one symbol (a, length), then
    every a b with a on the left side and b on the right side becomes one symbol.
    Equal symbols stand for equal stretches, and what a stretch becomes depends on
    its own symbols but for its two ends, so two places are compared in a constant
    number of steps a level. A separator that occurs nowhere else stands before
    and behind each sequence; it is never compressed. Rounds go on until each
    sequence is one symbol, in expectation a logarithmic number of them.
    """

    def __init__(self, sequences: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sequences], np.int64)
        low = int(max((int(s.max()) for s in sequences if len(s)), default=-1)) + 1
        #: Where each sequence begins in ``levels[0].symbols``.
        self.offsets = np.cumsum(np.concatenate([[0], sizes + 1]))[:-1] + 1
        symbols = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
        symbols[0] = low
        for i, (at, sequence) in enumerate(zip(self.offsets.tolist(), sequences)):
            symbols[at : at + len(sequence)] = sequence
            symbols[at + len(sequence)] = low + 1 + i
        self._separators = low, low + 1 + len(sizes)
        self._next = self._separators[1]
        self.levels: list[Level] = []
        settled = len(sizes) + 1 + int((sizes > 0).sum())
        mix = _ODD
        while len(symbols) > settled:
            symbols = self._runs(symbols)
            if len(symbols) > settled:
                symbols = self._pairs(symbols, mix)
                mix = mix * _TURN % (1 << 64)
        end = np.arange(len(symbols) + 1)
        self.levels.append(Level(symbols, end[:-1], end, None))

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """New symbols for the distinct keys."""
        found, which = np.unique(keys, return_inverse=True)
        names = which + self._next
        self._next += len(found)
        return names

    def _runs(self, symbols: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        first = np.append(np.flatnonzero(starts), len(symbols))
        lengths = np.diff(first)
        made = symbols[first[:-1]]
        longer = np.flatnonzero(lengths > 1)
        if len(longer):
            made[longer] = self._named(made[longer] * (len(symbols) + 1) + lengths[longer])
        self.levels.append(Level(symbols, np.cumsum(starts) - 1, first, None))
        return made

    def _pairs(self, symbols: np.ndarray, mix: int) -> np.ndarray:
        side = (symbols.astype(np.uint64) * np.uint64(mix) >> _HIGH).astype(bool)
        free = (symbols < self._separators[0]) | (symbols >= self._separators[1])
        right, left = side & free, ~side & free
        pairs, others = left[:-1] & right[1:], right[:-1] & left[1:]
        if others.sum() > pairs.sum():
            right, pairs = left, others
        starts = np.concatenate([[True], ~pairs])
        parent = np.cumsum(starts) - 1
        first = np.append(np.flatnonzero(starts), len(symbols))
        made = symbols[first[:-1]]
        heads = np.flatnonzero(pairs)
        if len(heads):
            made[parent[heads]] = self._named(symbols[heads] * self._next + symbols[heads + 1])
        self.levels.append(Level(symbols, parent, first, right))
        return made

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the stretches that begin at the places x and y (x < y, one sequence) are equal."""
        return self._extend(x, y, 1)

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the stretches that end at the places x and y (themselves included) are equal."""
        return self._extend(x, y, -1)

    def _extend(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """Go up while the symbols are equal, then down to the first words that differ.

        On a level of runs the rest of the run is stepped over; rests of unequal
        length end the way up. On a level of pairs one symbol is stepped over if it
        may be inside a pair whose other half was compared already. On the way down
        at most one symbol or run of each level is equal.
        """

        def rests(level: Level, at: np.ndarray) -> np.ndarray:
            own = level.parent[at]
            return level.first[own + 1] - at if way > 0 else at - level.first[own] + 1

        who, at, to = np.arange(len(x)), np.array(x, np.int64), np.array(y, np.int64)
        stopped = []
        for level in self.levels:
            equal = level.symbols[at] == level.symbols[to]
            halted = [(who[~equal], at[~equal], to[~equal])]
            who, at, to = who[equal], at[equal], to[equal]
            if level.right is None:
                one, other = rests(level, at), rests(level, to)
                step = way * np.minimum(one, other)
                at, to, go = at + step, to + step, one == other
                halted.append((who[~go], at[~go], to[~go]))
                who, at, to = who[go], at[go], to[go]
            else:
                step = np.where(level.right[at] == (way > 0), way, 0)
                at, to = at + step, to + step
            stopped.append(halted)
            if not len(who):
                break
            at, to = level.parent[at], level.parent[to]
        who, at, to = (np.zeros(0, np.int64) for _ in range(3))
        for depth in range(len(stopped) - 1, -1, -1):
            level = self.levels[depth]
            if len(who):
                at, to = (level.first[at], level.first[to]) if way > 0 else (level.first[at + 1] - 1, level.first[to + 1] - 1)
                equal = level.symbols[at] == level.symbols[to]
                step = np.minimum(rests(level, at), rests(level, to)) if level.right is None else 1
                step = way * np.where(equal, step, 0)
                at, to = at + step, to + step
            who, at, to = (np.concatenate(parts) for parts in zip((who, at, to), *stopped[depth]))
        reached = np.empty(len(x), np.int64)
        reached[who] = at
        return (reached - x) * way
