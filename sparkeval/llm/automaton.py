"""A byte automaton over the UTF-8 bytes of many documents at once.

A table of 256 entries classifies bytes, differences of the classes give where words begin and end,
and CRC-32 states of all words advance together, a byte a step, by the usual table of 256 entries.
"""

from __future__ import annotations

import zlib

import numpy as np

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Start of a CRC-32, and what its end is xored with.
START = np.uint32(0xFFFFFFFF)
#: So few unfinished words no longer fill a step; the rest of each goes to the standard library.
FEW = 16


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


TABLE = _table()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; none crosses a document (``offsets``)."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def advance(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 states after ``lengths`` bytes from ``starts`` on, each from its own state.

    Step k takes byte k of all words that have one: words lie in descending order of length, so
    these are the first.  A long word's tail costs a call, not a step for each byte.
    """
    if not len(starts):
        return states.copy()
    order = np.argsort(np.minimum(lengths, 0xFFFF).astype(np.uint16) ^ np.uint16(0xFFFF), kind="stable")
    at, s, n = starts[order], states[order], lengths[order]
    short = np.minimum(n, 0xFFFF)
    more = len(n) - np.cumsum(np.bincount(short))  # how many have more than k bytes
    k = 0
    while k < len(more) and more[k] >= FEW:
        m = more[k]
        x = s[:m]
        s[:m] = TABLE[(x ^ data[at[:m] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
        k += 1
    for i in range(int(more[k]) if k < len(more) else 0):
        rest = data[at[i] + k : at[i] + n[i]].tobytes()
        s[i] = np.uint32(zlib.crc32(rest, int(s[i] ^ START))) ^ START
    out = np.empty_like(s)
    out[order] = s
    return out


def step(states: np.ndarray, byte: int) -> np.ndarray:
    """States after one more byte, the same for all."""
    return TABLE[(states ^ np.uint32(byte)) & np.uint32(255)] ^ (states >> np.uint32(8))
