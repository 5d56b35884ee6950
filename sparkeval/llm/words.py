"""Vectorised words, word hashes and shingles of the UTF-8 bytes of many documents."""

from __future__ import annotations

import numpy as np

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; words are never cut, so a longer word makes a longer block.
_BLOCK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * _STEP)
BYTE[WHITE] = 0
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse."""
    for k, base in enumerate((_STEP, _INVERSE)):
        while len(_powers[k]) < n:
            p = _powers[k]
            _powers[k] = np.concatenate([p, p * (p[-1:] * base)])
    return _powers[0], _powers[1]


def bounds(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of bytes that are not ``white``, by default of
    ``[^\\x20\\x09-\\x0D]``; none crosses a document."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~white[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside
    last[:-1] = last[:-1] & (~inside[1:] | cut[1:-1]) if len(last) > 1 else last[:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each span; spans ascend and do not overlap.

    A span's hash is a polynomial of its bytes, taken for all spans of a block in one sweep.
    """
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        to = int(ends[j - 1])
        up, down = _power(to - at)
        value = byte[data[at:to]] * up[: to - at]
        edges = np.empty(2 * (j - i), np.int64)
        edges[0::2], edges[1::2] = starts[i:j] - at, ends[i:j] - at
        if edges[-1] == to - at:
            edges = edges[:-1]
        total = np.add.reduceat(value, edges)[0::2]
        out[i:j] = mix(total * down[starts[i:j] - at] + (ends[i:j] - starts[i:j]).astype(U))
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased (A-Z) words: hashes, starts, ends, and the offset of each document's first."""
    low = LOWER[data]
    starts, ends = bounds(low, offsets)
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, of: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each document's distinct hashes of ``n`` words in a row, ascending.

    A document of fewer words has one, of them all; one without words has none.  ``of`` holds
    where each document's words start, and the end.
    """
    odd = mix(np.arange(1, n + 1, dtype=U) * _STEP) | U(1)
    total = np.zeros(max(0, len(hashes) - n + 1), U)
    for k in range(n):
        total += hashes[k : k + len(total)] * odd[k]
    total = mix(total)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(total[a : b - n + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * odd[: b - a]).sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(np.empty(0, U))
    return out
