"""Rows of a group between frames and handlers: in order, however many, and back in frames of bounded size."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd

#: Rows that are sorted in memory; rows of a frame that goes back; rows that a run is read by.
RUN, RETURNED, READ = 200_000, 5_000, 1_000


def _written(rows: list[tuple]) -> Iterator[tuple]:
    """A sorted run, on the worker's own disk until it is read."""
    file = tempfile.TemporaryFile()
    for k in range(0, len(rows), READ):
        pickle.dump(rows[k : k + READ], file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)

    def read() -> Iterator[tuple]:
        with file:
            while True:
                try:
                    part = pickle.load(file)
                except EOFError:
                    return
                yield from part

    return read()


def in_order(frames: Iterable[pd.DataFrame], columns: list[str], key: Callable[[tuple], tuple], most: int | None = None) -> Iterator[tuple]:
    """The rows of all frames as tuples, sorted by `key`. Above `most` rows they are sorted in runs, which go to disk and are merged, so that
    a group of any size needs the memory of a run."""
    most, rows, runs = most or RUN, [], []
    for f in frames:
        rows += zip(*(f[c].tolist() for c in columns), strict=True)
        if len(rows) >= most:
            rows.sort(key=key)
            runs.append(_written(rows))
            rows = []
    rows.sort(key=key)
    return heapq.merge(*runs, rows, key=key) if runs else iter(rows)


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Objects stay as they are: an integer column with nulls is none of floats."""
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})


def in_frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as they are made, RETURNED at a time."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= RETURNED:
            yield frame(held, columns)
            held = []
    if held:
        yield frame(held, columns)
