"""Vectorised text kernels: numpy over Arrow buffers, no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}

#: The white space that separates words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits; returns a new array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def powers(n: int, base: int = _P) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept and grown as needed."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = _tables[base] = np.multiply.accumulate(have)
    return have[:n]


def text_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    buffers = arr.buffers()
    offs = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Prefix:
    """Polynomial hashes of any range of a sequence, from one cumulative sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        got = self.sums[end] - self.sums[start]
        got *= powers(len(self.sums), _PI)[start]
        return mix(got)

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of k values."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        got = self.sums[k:] - self.sums[:n]
        got *= powers(n, _PI)
        return mix(got)


def runs(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values that don't cross row offsets."""
    n = len(flag)
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:n] = flag[: n - 1]
    after[: n - 1] = flag[1:]
    before[offs[:-1]] = False
    inner = offs[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(flag & ~before[:n]), np.flatnonzero(flag & ~after[:n]) + 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and per row the offset of its first word."""
    starts, ends = runs(~SPACE[data], offs)
    return starts, ends, np.searchsorted(starts, offs)


#: Bytes up to which a word is hashed by its 8-byte lanes; longer ones go through XXH3.
LANES = 4
_LANE_KEYS = mix(np.arange(101, 101 + LANES, dtype=np.uint64) * np.uint64(_P))


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The first 32 bytes of each range as LANES numbers of 8 bytes, zero behind its end."""
    padded = np.concatenate([data, np.zeros(8 * LANES, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = []
    for k in range(LANES):
        inside = np.clip(size - 8 * k, 0, 8).astype(np.uint64)
        # A shift by 64 bits is undefined: two shifts by half as much.
        half = (np.uint64(8) - inside) * np.uint64(4)
        out.append((view[np.minimum(starts + 8 * k, len(padded) - 8)] << half << half) >> half >> half)
    return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes, from the bytes alone; no structure of the bytes makes them collide."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(_P))
    for k, lane in enumerate(lanes(data, starts, ends)):
        h = mix((h ^ lane) * _LANE_KEYS[k] + lane) if k == 0 else np.where(size > 8 * k, mix((h ^ lane) * _LANE_KEYS[k] + lane), h)
    for i in np.flatnonzero(size > 8 * LANES):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=_P)
    return h


def told_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each range, equal where and only where its bytes are: hashes propose, the bytes decide."""
    _, head, number = np.unique(h, return_index=True, return_inverse=True)
    size = ends - starts
    like = head[number]
    differs = size != size[like]
    for lane in lanes(data, starts, ends):
        differs |= lane != lane[like]
    for i in np.flatnonzero((size > 8 * LANES) & ~differs & (like != np.arange(len(like)))):
        differs[i] = data[starts[i] : ends[i]].tobytes() != data[starts[like[i]] : ends[like[i]]].tobytes()
    if differs.any():
        odd: dict[bytes, int] = {}
        for i in np.flatnonzero(differs):
            number[i] = odd.setdefault(data[starts[i] : ends[i]].tobytes(), len(head) + len(odd))
    return number


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same from starts[1], ..."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - at, counts)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    have, m = 1, x
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m[:n]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places the ranges cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:n]) > 0
