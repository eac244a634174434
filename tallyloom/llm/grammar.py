"""A run-length grammar by recompression, and exact common extensions from it.

Rounds alternate. A block round replaces every maximal run of one symbol by one symbol; a pair round deals the symbols to
two sides and replaces every (left, right) pair by one symbol. What a round does to a stretch depends on that stretch
alone, except at its two ends, so two equal stretches are parsed alike up to a few symbols per level. An extension query
therefore climbs: it compares single symbols only until both places are ends of symbols of the next level, goes up where
symbols are equal, and, once two symbols differ, comes down again level by level. Queries are answered many at a time.

Pairs are chosen by a random side per symbol and round, in the direction that finds more of them, in place of a greedy cut:
about a quarter of all places are a pair, so a sequence is gone after some log(n) / log(4/3) rounds.
"""

from __future__ import annotations

import numpy as np

from tallyloom.llm.textbatch import mix

U64 = np.uint64
#: Parts of this many symbols or fewer are not parsed further; queries compare them one by one.
ENOUGH = 4


class Grammar:
    """The levels of one symbol sequence. Symbols below ``marks`` stay as they are: each stands once, between two parts and
    at both ends, and so ends every extension."""

    def __init__(self, symbols: np.ndarray, marks: int):
        self.marks = marks
        self.symbols = [np.asarray(symbols, np.int64)]
        #: Per round: the place on the next level of each place between symbols, or -1 inside a symbol; and back.
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []
        #: Per round: equal symbols before and behind each place; None in pair rounds, which have no equal neighbours.
        self.runs: list[tuple[np.ndarray, np.ndarray] | None] = []
        self.used = int(self.symbols[0].max(initial=0)) + 1
        draw = 0
        while self._longest() > ENOUGH:
            self._blocks()
            draw += 1
            if self._longest() > ENOUGH:
                self._pairs(U64(draw))

    def _longest(self) -> int:
        places = np.flatnonzero(self.symbols[-1] < self.marks)
        return int(np.diff(places).max(initial=1)) - 1

    def _push(self, starts: np.ndarray, made: np.ndarray, runs: tuple[np.ndarray, np.ndarray] | None) -> None:
        n = len(self.symbols[-1])
        up = np.full(n + 1, -1, np.int32)
        up[starts] = np.arange(len(starts), dtype=np.int32)
        up[n] = len(starts)
        self.up.append(up)
        self.down.append(np.append(starts, n).astype(np.int32))
        self.runs.append(runs)
        self.symbols.append(made)

    def _named(self, codes: np.ndarray) -> np.ndarray:
        """New symbols, one for each distinct code."""
        distinct, number = np.unique(codes, return_inverse=True)
        number = number + self.used
        self.used += len(distinct)
        return number

    def _blocks(self) -> None:
        now = self.symbols[-1]
        n = len(now)
        starts = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1])))
        if len(starts) == n:
            return
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        at = np.arange(n)
        before = np.concatenate(([0], at - first + 1)).astype(np.int32)
        behind = np.append(np.repeat(starts + sizes, sizes) - at, 0).astype(np.int32)
        made = now[starts]
        many = sizes > 1
        made[many] = self._named(made[many] << 32 | sizes[many])
        self._push(starts, made, (before, behind))

    def _pairs(self, draw: U64) -> None:
        now = self.symbols[-1]
        side = (mix(now.astype(U64) ^ mix(np.array([draw]))) & U64(1)).astype(np.int8)
        side[now < self.marks] = 2
        ahead = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
        other = np.flatnonzero((side[:-1] == 1) & (side[1:] == 0))
        first = ahead if len(ahead) >= len(other) else other
        if not len(first):
            return
        kept = np.ones(len(now), bool)
        kept[first + 1] = False
        starts = np.flatnonzero(kept)
        made = now[starts]
        made[np.searchsorted(starts, first)] = self._named(now[first] << 32 | now[first + 1])
        self._push(starts, made, None)

    def _along(self, level: int, x: np.ndarray, y: np.ndarray, back: bool, goal: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Moves pairs of places on while the symbols next to them are equal; with a ``goal``, only until both are ends of
        symbols of the next level. Also tells which pairs stand before unequal symbols."""
        symbols = self.symbols[level]
        runs = self.runs[level][0 if back else 1] if level < len(self.runs) and self.runs[level] else None
        differ = np.zeros(len(x), bool)
        todo = np.arange(len(x)) if goal is None else np.flatnonzero((goal[x] < 0) | (goal[y] < 0))
        while len(todo):
            a, b = x[todo], y[todo]
            same = symbols[a - back] == symbols[b - back]
            differ[todo[~same]] = True
            todo, a, b = todo[same], a[same], b[same]
            step = 1 if runs is None else np.minimum(runs[a], runs[b])
            x[todo] = a = a - step if back else a + step
            y[todo] = b = b - step if back else b + step
            if goal is not None:
                todo = todo[(goal[a] < 0) | (goal[b] < 0)]
        return x, y, differ

    def extend(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """For each pair of different places the number of equal symbols behind them, or before them with ``back``.

        Place i is the one in front of symbol i.
        """
        start = np.asarray(x, np.int64)
        x, y = start.copy(), np.asarray(y, np.int64).copy()
        out = np.zeros(len(x), np.int64)
        climbing, parked = np.arange(len(x)), []
        for level, up in enumerate(self.up):
            if not len(climbing):
                break
            a, b, differ = self._along(level, x[climbing], y[climbing], back, up)
            stopped = climbing[differ]
            x[stopped], y[stopped] = a[differ], b[differ]
            parked.append(stopped)
            climbing = climbing[~differ]
            x[climbing], y[climbing] = up[a[~differ]], up[b[~differ]]
        level = len(parked)
        down = climbing
        if len(down):
            x[down], y[down], _ = self._along(level, x[down], y[down], back, None)
        while level:
            level -= 1
            if len(down):
                to = self.down[level]
                x[down], y[down], _ = self._along(level, to[x[down]].astype(np.int64), to[y[down]].astype(np.int64), back, None)
            down = np.concatenate((down, parked[level]))
        out[:] = start - x if back else x - start
        return out
