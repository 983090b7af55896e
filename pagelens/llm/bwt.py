"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

The alphabet are the substrings of STRIDE bytes (as 15 bits of a hash; windows of an interval are compared once more at
the end, by 64 bits and then byte by byte), and a suffix is followed by the one STRIDE bytes later. So a context of 100 bytes is four symbols, and four rounds of refinement order all suffixes by it.
"""

from __future__ import annotations

import numpy as np

STRIDE = 25


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n bytes of x, by doubling."""
    out, have, power = None, 0, x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    size = 1
    while n >> have:  # pieces of 1, 2, 4, ... are put together by the bits of n
        out_len = len(x) - n + 1
        if n >> have & 1:
            at = n & ((1 << have) - 1)
            piece = power[at : at + out_len]
            out = piece.copy() if out is None else _mix(out, piece)
        have += 1
        if n >> have:
            power = _mix(power[:-size], power[size:])
            size *= 2
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    h += b * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


class Shard:
    """The suffix order of some strings to `depth` symbols, and its transform.

    Each string has as many rows as bytes and one more; those with fewer than STRIDE bytes left are its ends. `symbol`
    holds a number for each row, 0 for ends. Suffixes that agree stand in the order of their places.
    """

    def __init__(self, symbol: np.ndarray, start: np.ndarray, depth: int):
        n = len(symbol)
        keys = [symbol]
        for _ in range(depth - 1):
            key = np.zeros(n, np.uint16)
            key[: n - STRIDE] = keys[-1][STRIDE:]
            key[symbol == 0] = 0
            keys.append(key)
        order = np.argsort(keys[-1], kind="stable")
        for key in keys[-2::-1]:
            order = order[np.argsort(key[order], kind="stable")]
        before = np.zeros(n, np.uint16)
        before[STRIDE:] = symbol[: n - STRIDE]
        before[(start[:, None] + np.arange(STRIDE)).ravel()] = 0  # what precedes a string's first bytes
        self.suffixes = order
        self.transform = before[order]
        self.ends = int(n - np.count_nonzero(symbol))


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms of shards (Holt and McMillan 2014).

    Returns, for each place of the merged order, its shard, and the number of the interval of suffixes that agree in
    `depth` symbols. Each round takes the symbols in the order so far and deals the places out by them, stably; where a
    round parts neighbours, their common prefix is known to end. No suffix is compared or sorted again.
    """
    sizes = [len(s.transform) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    fixed = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.ends for s in shards])
    interval = np.zeros(len(z), np.int32)
    symbols = np.concatenate([s.transform for s in shards])
    for turn in range(depth):
        if turn:
            for j, s in enumerate(shards):
                symbols[z == j] = s.transform
        inner = np.flatnonzero(symbols)  # the others precede a string's first bytes; the ends keep their places
        order = inner[np.argsort(symbols[inner], kind="stable")]
        c, g = symbols[order], interval[order]
        new = np.ones(len(order), bool)
        np.logical_or(c[1:] != c[:-1], g[1:] != g[:-1], out=new[1:])
        z = np.concatenate([fixed, z[order]])
        interval = np.concatenate([np.zeros(len(fixed), np.int32), np.cumsum(new, dtype=np.int32)])
    return z, interval


def repeated_windows(data: np.ndarray, start: np.ndarray, window: int = 100, shards_of: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Of strings laid end to end, the places at which `window` bytes begin, and the interval of equal ones of each.

    They come interval by interval, in each by place. Each string must have `window` bytes at least. The strings are dealt to `shards_of` shards in order.
    """
    depth = window // STRIDE
    if depth * STRIDE != window:
        raise ValueError(f"the window must be a multiple of {STRIDE}")
    n = len(data)
    lengths = np.diff(np.append(start, n))
    if len(start) and lengths.min() < window:
        raise ValueError("each string must hold a window")
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    # a row past each string's end; its place in rows is its byte's plus the number of its string
    string_of = np.repeat(np.arange(len(start), dtype=np.int32), lengths)
    begin = start + np.arange(len(start))
    h = np.zeros(n, np.uint16)
    h[: n - STRIDE + 1] = (rolling(data, STRIDE) >> np.uint64(48)).astype(np.uint16) | 1
    rows = np.zeros(n + len(start), np.uint16)
    rows[np.arange(n, dtype=np.int64) + string_of] = h
    tail = begin[:, None] + lengths[:, None] - np.arange(STRIDE)  # fewer than STRIDE bytes left
    rows[tail.ravel()] = 0
    cuts = np.unique(np.append(np.searchsorted(begin, np.linspace(0, len(rows), shards_of + 1)[:-1]), len(start)))
    shards, bases = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = begin[a], begin[b] if b < len(start) else len(rows)
        shards.append(Shard(rows[lo:hi], begin[a:b] - lo, depth))
        bases.append(lo)
    z, interval = merge(shards, depth)
    place = np.empty(len(z), np.int64)
    for j, s in enumerate(shards):
        place[z == j] = s.suffixes + bases[j]
    owner = np.repeat(np.arange(len(start), dtype=np.int32), lengths + 1)[place]
    whole = place + window <= (begin + lengths)[owner]
    byte, interval = (place - owner)[whole], interval[whole]
    if not len(byte):
        return byte, interval
    full = rolling(data, window)[byte]  # symbols may have met in 15 bits
    differ = (interval[1:] == interval[:-1]) & (full[1:] != full[:-1])
    if differ.any():
        mixed = np.flatnonzero(np.isin(interval, interval[1:][differ]))
        order = mixed[np.lexsort((byte[mixed], full[mixed], interval[mixed]))]
        byte[mixed], full[mixed] = byte[order], full[order]
        new = np.ones(len(byte), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (full[1:] != full[:-1])
        interval = np.cumsum(new, dtype=np.int32)
    return by_bytes(data, byte, interval, window)


def by_bytes(data: np.ndarray, byte: np.ndarray, interval: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of windows at `byte` after a look at their bytes: those that differ are parted.

    Each window is compared with the one before it in its interval. Where both follow windows just compared with each
    other, only their last bytes are new.
    """
    same = np.flatnonzero(interval[1:] == interval[:-1]) + 1
    q, p = byte[same - 1], byte[same]
    partner = np.full(len(data) + 1, -2, np.int64)
    partner[p] = q
    equal = data[p + window - 1] == data[q + window - 1]
    heads = np.flatnonzero((p == 0) | (partner[p - 1] != q - 1))
    for k in range(window - 1):
        equal[heads] &= data[p[heads] + k] == data[q[heads] + k]
    if equal.all():
        return byte, interval
    bad = np.isin(interval, interval[same[~equal]])
    content = [data[b : b + window].tobytes() if x else b"" for b, x in zip(byte.tolist(), bad.tolist(), strict=True)]
    order = sorted(range(len(byte)), key=lambda i: (interval[i], content[i], byte[i]))
    new = [0, *(int(interval[i] != interval[j] or content[i] != content[j]) for j, i in zip(order, order[1:], strict=False))]
    return byte[order], np.cumsum(new, dtype=np.int32)
