"""Many texts through one finite-state transducer, side by side.

Texts become runs of symbols, runs are cut into lanes of bounded length, and all lanes
of a slice take one step at a time, so a step is a few array operations instead of a
Python loop over characters."""

from __future__ import annotations

import numpy as np


def cut(starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes of at most `size` symbols: (owner, start, length), longest first."""
    pieces = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = starts[owner] + nth * size
    length = np.minimum(size, lengths[owner] - nth * size)
    order = np.argsort(-length, kind="stable")
    return owner[order], start[order], length[order]


def active(lengths: np.ndarray) -> list[int]:
    """For each step, how many of the lanes, longest first, still have a symbol."""
    if not len(lengths):
        return []
    ends = np.bincount(lengths, minlength=int(lengths[0]) + 1)
    return (len(lengths) - np.cumsum(ends)[:-1]).tolist()


def count_marks(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray,
                roots: np.ndarray) -> np.ndarray:
    """Marked transitions of each lane under each of several automata, which share the
    flat `table`: entry [row + symbol] holds the next row, its top bit the mark."""
    at = np.repeat(roots.astype(np.uint32)[:, None], len(start), axis=1)
    marks = np.zeros(at.shape, np.uint32)
    for step, n in enumerate(active(length)):
        got = table[at[:, :n] + symbols[start[:n] + step].astype(np.uint32)]
        marks[:, :n] += got >> np.uint32(31)
        at[:, :n] = got & np.uint32(0x7FFFFFFF)
    return marks


def place(row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a sparse arc; symbols are fewer than code points."""
    return row.astype(np.int64) << 21 | symbol


def count_sparse_marks(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, width: int,
                       opening: np.ndarray, places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """As count_marks(), under one automaton whose table holds the symbols below `width`. A
    later symbol takes the arc found in the sorted `places`, else that of `opening`."""
    at = np.zeros(len(start), np.uint32)
    marks = np.zeros(len(start), np.uint32)
    for step, n in enumerate(active(length)):
        symbol = symbols[start[:n] + step]
        rare = np.flatnonzero(symbol >= width)
        symbol_in = symbol.copy()
        symbol_in[rare] = 1
        got = table[at[:n] + symbol_in]
        if len(rare):
            got[rare] = opening[symbol[rare]]
            if len(places):
                wanted = place(at[rare], symbol[rare])
                near = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
                hit = places[near] == wanted
                got[rare[hit]] = after[near[hit]]
        marks[:n] += got >> np.uint32(31)
        at[:n] = got & np.uint32(0x7FFFFFFF)
    return marks


def weights(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, arcs: np.ndarray, warm: int,
            deep: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of the arc each symbol takes along its lane, from state 0; zero outside
    lanes. The first `warm` symbols of a lane move the state and do not count. Entry
    [row + symbol] of `arcs` holds the next row and the weight. Also whether the arc
    leaves from a row before `deep`."""
    out = np.zeros(len(symbols))
    early = np.zeros(len(symbols), bool)
    at = np.zeros(len(start), np.int64)
    for step, n in enumerate(active(length)):
        here = start[:n] + step
        got = arcs[at[:n] + symbols[here]]
        if step >= warm:
            out[here] = got["weight"]
            early[here] = at[:n] < deep
        at[:n] = got["next"]
    return out, early
