"""Polynomial hashes over byte buffers, in numpy.

Two hashes modulo the Mersenne prime 2**31 - 1 with bases of their own make one of 62 bits: two different
strings of n bytes agree for at most n of the bases, so with a chance of (n / 2**31)**2. (Modulo 2**64, every
odd base fails on some strings of 1,024 bytes.) ``prefix(buf)[:, i]`` is the hash of the first i bytes, the
first byte having the highest power. A window's hash takes the prefix at its start, times the power of its
length, from the prefix at its end, so equal bytes hash alike wherever they stand.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 31) - 1
#: Drawn once at random.
BASES = (1_284_865_837, 710_425_341)
_P, _31 = np.uint64(PRIME), np.uint64(31)
_BLOCK = 1 << 16
_tables: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """Equal modulo PRIME, and below 2**33."""
    return (x & _P) + (x >> _31)


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, below PRIME."""
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


def powers(n: int, sign: int = 1) -> np.ndarray:
    """base**(sign * i) for i in 0..n or more, a row for each base."""
    table = _tables.get(sign, np.ones((2, 1), np.uint64))
    while table.shape[1] <= n:
        step = np.array([[pow(b, sign * table.shape[1], PRIME)] for b in BASES], np.uint64)
        table = np.concatenate([table, _rest(table * step)], axis=1)
    _tables[sign] = table
    return table


def prefix(buf: np.ndarray, bases: int = 2) -> np.ndarray:
    """A row for each base; one will do where what it finds is checked."""
    up, down = powers(_BLOCK)[:bases], powers(_BLOCK, -1)[:bases]
    s = np.zeros((bases, len(buf) + 1), np.uint32)
    for a in range(0, len(buf), _BLOCK):  # sums of a block stay under 2**55
        part = buf[a : a + _BLOCK].astype(np.uint64) + np.uint64(1)
        n = len(part)
        inner = _fold(np.cumsum(part * down[:, 1 : n + 1], axis=1))
        s[:, a + 1 : a + 1 + n] = _rest(_fold(inner + s[:, a : a + 1]) * up[:, 1 : n + 1])
    return s


def window(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] from ``s = prefix(buf)``."""
    size = np.asarray(end) - start
    up, out = powers(int(size.max(initial=0))), None
    for row, table in zip(s, up, strict=False):
        before = _rest(row[start].astype(np.uint64) * table[size])
        h = row[end] + _P - before
        h = np.where(h >= _P, h - _P, h)
        out = h if out is None else out | h << np.uint64(32)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups_of(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut documents into runs [i, j) of at most ``most`` bytes, one document at least."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out
