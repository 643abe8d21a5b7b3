"""Vectorised 64-bit hashing of words in byte arrays."""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal true runs of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on as one number, zeros behind the end."""
    return padded_loads(np.concatenate([data, np.zeros(8, np.uint8)]))


def padded_loads(data: np.ndarray) -> np.ndarray:
    """loads of all but the last eight bytes, without a copy."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever its bytes stand: a chain of mixed eight-byte words, so
    that no linear relation between texts makes spans collide. Who must tell spans apart compares their bytes."""
    words, size = loads(data), end - start
    with np.errstate(over="ignore"):
        out = mix64(size.astype(np.uint64) * GOLDEN)
        rows: np.ndarray | slice = slice(None)
        at, left = start, size
        while len(left):
            value = words[at] & _KEEP[np.minimum(left, 8)]
            out[rows] = mix64((out[rows] * GOLDEN) ^ mix64(value + GOLDEN))
            more = np.flatnonzero(left > 8)
            rows = more if isinstance(rows, slice) else rows[more]
            at, left = at[more] + 8, left[more] - 8
    return out


def equal_spans(x: np.ndarray, at: np.ndarray, y: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes from `at` are those from `other`, span by span; x and y are the loads of two texts."""
    out = np.ones(len(size), bool)
    rows = np.flatnonzero(size > 0)
    step = 0
    while len(rows):
        keep = _KEEP[np.minimum(size[rows] - step, 8)]
        out[rows] = (x[at[rows] + step] ^ y[other[rows] + step]) & keep == 0
        step += 8
        rows = rows[(size[rows] > step) & out[rows]]
    return out
