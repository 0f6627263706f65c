"""Words of many texts at once: ASCII-lower-cased runs of bytes that aren't ASCII white space, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; longer texts are cut at white space.
SLICE = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of an odd base and of its inverse."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n, SLICE) + 1
    out = []
    for base in (_BASE, _BACK):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 4 * SLICE:
        _powers[:] = out
    return out[0], out[1]


def _hash(low: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in bytes; heads: where texts begin, so that words don't run across."""
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[low]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    heads = heads[heads < len(low)]
    starts[heads] = word[heads]
    tails = heads[heads > 0] - 1
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(last) + 1
    power, back = powers(len(low))
    run = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[: len(low)], out=run[1:])
    return mix((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts, ends


class Words:
    """Hashes of all words of some texts, the bounds of each text in them, and the lower-cased bytes with the words' places."""

    def __init__(self, hashes, bounds, low, starts, ends):
        self.hashes, self.bounds, self.low, self.starts, self.ends = hashes, bounds, low, starts, ends


def words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) for a few rows at a time; nulls are empty texts.

    Two words have equal hashes only if they are equal, but for a chance of about 2^-60 a pair."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] and column.buffers()[2].size else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if sizes[~valid].any():
            yield from words(pa.array([b"" if x is None else x for x in column.to_pylist()], pa.large_binary()))
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        low = _LOWER[data[offsets[lo] : offsets[hi]]]
        if len(low) <= SLICE:
            hashes, starts, ends = _hash(low, offsets[lo:hi] - offsets[lo])
        else:
            parts, at = [], 0
            while at < len(low):
                to = min(len(low), at + SLICE)
                if to < len(low):
                    gaps = np.flatnonzero(_SPACE[low[at:to]])
                    if len(gaps):
                        to = at + int(gaps[-1]) + 1
                    else:
                        rest = np.flatnonzero(_SPACE[low[to:]])
                        to = to + int(rest[0]) + 1 if len(rest) else len(low)
                h, s, e = _hash(low[at:to], np.zeros(0, np.int64))
                parts.append((h, s + at, e + at))
                at = to
            hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        bounds = np.searchsorted(starts, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, Words(hashes, bounds, low, starts, ends)
        lo = hi


def gathered(parts: Iterator[tuple[int, int, Words]], size: int) -> Iterator[tuple[int, int, Words]]:
    """What words() yields, in fewer and larger parts of about `size` bytes."""
    held: list[tuple[int, int, Words]] = []

    def one() -> tuple[int, int, Words]:
        if len(held) == 1:
            return held[0]
        shift = np.cumsum([0, *(len(w.low) for _, _, w in held)])
        before = np.cumsum([0, *(len(w.hashes) for _, _, w in held)])
        join = lambda name, by=None: np.concatenate([getattr(w, name) + (0 if by is None else by[i]) for i, (_, _, w) in enumerate(held)])
        bounds = np.concatenate([[0], *(w.bounds[1:] + before[i] for i, (_, _, w) in enumerate(held))])
        low = np.concatenate([w.low for _, _, w in held])
        return held[0][0], held[-1][1], Words(np.concatenate([w.hashes for _, _, w in held]), bounds, low, join("starts", shift), join("ends", shift))

    for part in parts:
        held.append(part)
        if sum(len(w.low) for _, _, w in held) >= size:
            yield one()
            held.clear()
    if held:
        yield one()
