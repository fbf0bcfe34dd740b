"""Rows of a key in order of their position, whatever order they arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Positions that share one entry of the state.
SPAN = 256


class GapBuffer:
    """Rows that wait for an earlier position, in keyed state.

    Positions of a key are 0, 1, 2 ... Rows whose turn has come pass straight through. The
    others are kept in a map from ``position // SPAN`` to arrays, so a gap costs a state
    access per ``SPAN`` positions, and only the entry under work is in memory. A position
    that repeats, or was passed already, is ignored.
    """

    def __init__(self, handle, name: str, columns: dict[str, str]):
        """``columns`` are the columns of a row and their types, ``position`` among them."""
        self.columns = list(columns)
        self.waiting = handle.getMapState(name, "span bigint", ", ".join(f"{c} array<{t}>" for c, t in columns.items()))

    @classmethod
    def over(cls, waiting, columns: list[str]) -> GapBuffer:
        """A buffer that keeps its rows in a map that is there already."""
        buffer = cls.__new__(cls)
        buffer.columns, buffer.waiting = columns, waiting
        return buffer

    def pass_on(self, rows: pd.DataFrame, expected: int, first: int | None) -> Iterator[tuple[pd.DataFrame, int, int | None]]:
        """Runs that continue from ``expected``, with the next expected position and the first waiting one.

        ``first`` is the first position that waits, None if none does. The last pair handed
        out is the one to keep; a call without a run hands out an empty one.
        """
        rows = rows[rows["position"] >= expected].drop_duplicates("position").sort_values("position")
        ready = _run(rows["position"], expected)
        run, rest = rows.iloc[:ready], rows.iloc[ready:]
        expected += ready
        if len(rest):
            self._keep(rest)
            low = int(rest["position"].iloc[0])
            first = low if first is None else min(low, first)
        yield run, expected, first
        while first is not None and first <= expected:
            run, first = self._next(expected)
            expected += len(run)
            yield run, expected, first

    def remaining(self) -> Iterator[pd.DataFrame]:
        """All rows that still wait, in order; the gaps between them are given up."""
        for span in sorted(k[0] for k in self.waiting.keys()):
            yield self._load(span).sort_values("position")

    def clear(self) -> None:
        self.waiting.clear()

    def _load(self, span: int) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.columns, self.waiting.getValue((span,)), strict=True)))

    def _store(self, span: int, rows: pd.DataFrame) -> None:
        self.waiting.updateValue((span,), tuple(rows[c].tolist() for c in self.columns))

    def _keep(self, rows: pd.DataFrame) -> None:
        for span, part in rows.groupby(rows["position"] // SPAN):
            span = int(span)
            if self.waiting.containsKey((span,)):
                part = pd.concat([self._load(span), part[self.columns]]).drop_duplicates("position")
            self._store(span, part)

    def _next(self, expected: int) -> tuple[pd.DataFrame, int | None]:
        """The waiting run from ``expected`` within its span, and the first position that waits then."""
        span = expected // SPAN
        if self.waiting.containsKey((span,)):
            rows = self._load(span).sort_values("position")
            rows = rows[rows["position"] >= expected]
            ready = _run(rows["position"], expected)
            if ready < len(rows):
                self._store(span, rows.iloc[ready:])
                return rows.iloc[:ready], int(rows["position"].iloc[ready])
            self.waiting.removeKey((span,))
            if ready:
                following = ((expected + ready) // SPAN,)
                if following[0] != span and self.waiting.containsKey(following):
                    return rows, int(self._load(following[0])["position"].min())
                return rows, self._least()
        return pd.DataFrame(columns=self.columns), self._least()

    def _least(self) -> int | None:
        spans = [k[0] for k in self.waiting.keys()]
        return int(self._load(min(spans))["position"].min()) if spans else None


class MapOfKey:
    """The entries of one key in a map state that several share, with the key in front of each entry's own."""

    def __init__(self, entries, key):
        self.entries, self.key = entries, key

    def getValue(self, at: tuple) -> tuple:
        return self.entries.getValue((self.key, *at))

    def updateValue(self, at: tuple, value: tuple) -> None:
        self.entries.updateValue((self.key, *at), value)

    def containsKey(self, at: tuple) -> bool:
        return self.entries.containsKey((self.key, *at))

    def removeKey(self, at: tuple) -> None:
        self.entries.removeKey((self.key, *at))

    def keys(self) -> list[tuple]:
        return [at[1:] for at in map(tuple, self.entries.keys()) if at[0] == self.key]

    def clear(self) -> None:
        for at in self.keys():
            self.removeKey(at)


def _run(positions: pd.Series, expected: int) -> int:
    """How many of the ascending positions follow on from ``expected`` without a gap."""
    return int((positions.to_numpy() == np.arange(expected, expected + len(positions))).cumprod().sum())
