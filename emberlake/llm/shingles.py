"""Hashes of word shingles of whole texts, vectorised over the bytes of an Arrow column.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased. Its hash is a polynomial over its
bytes modulo 2 ** 64, taken from running sums; a shingle's hash mixes the hashes of its words. Two different
shingles share a hash with probability of about 2 ** -60, which is taken as never.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
_BASE, _UNBASE = 0x9E3779B97F4A7C15 | 5, pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64)
_TABLE = np.random.default_rng(20240131).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_ODD = np.random.default_rng(20240201).integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(max(n, CHUNK + 1), U(_BASE if which == "up" else _UNBASE))
        steps[0] = U(1)
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def chunks(column) -> list[tuple[int, int]]:
    """Ranges of rows of a string column with about CHUNK bytes each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    out, start = [], 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK, "right")) - 1)
        out.append((start, stop))
        start = stop
    return out


def shingle_hashes(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingle hashes of each row, sorted; row i has hashes[ends[i]:ends[i + 1]].

    A row with fewer words than width, but some, has its whole sequence as one shingle; null is as empty.
    """
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends -= ends[0]
    low = np.where((raw >= 65) & (raw <= 90), raw | 0x20, raw)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first, last = word.copy(), word.copy()  # bytes that begin and end a word; no word crosses a row
    if len(raw):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        begins = ends[(ends > 0) & (ends < len(raw))]
        first[begins] = word[begins]
        last[begins - 1] = word[begins - 1]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_TABLE[low] * _power("up", len(raw)), out=sums[1:])
    hashes = mix((sums[to] - sums[at]) * _power("down", len(raw) + 1)[at])
    bounds = np.searchsorted(at, ends)  # words of row i: bounds[i] to bounds[i + 1]
    n = np.diff(bounds)
    total = len(hashes)
    rolled = np.zeros(max(total - width + 1, 0), U)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * _ODD[k]
    rolled = mix(rolled)
    sets = []
    for i in range(len(column)):
        a, b = bounds[i], bounds[i + 1]
        if n[i] >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif n[i]:
            sets.append(mix(np.array([int((hashes[a:b] * _ODD[width : width + n[i]]).sum()) % (1 << 64) ^ int(n[i])], U)))
        else:
            sets.append(np.zeros(0, U))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.cumsum([0, *map(len, sets)])
