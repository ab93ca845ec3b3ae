"""Content-defined chunking with a gear hash and normalized cut conditions, in NumPy.

The hash is p = (p >> 1) + gear[byte] from min_size on, reset for every chunk. Its value at a place is the floor of
the sum of gear[byte j places back] / 2**j. 64 terms of that sum, by doubling and with 32 bits behind the point, give
it at every place at once, so the places where a cut is possible are found without a loop over bytes. Where fewer
bytes have come since the reset it is that or one less, which is decided exactly; so is the rare sum near a carry.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np

from .scalars import AVG_SIZE, MAX_SIZE, MIN_SIZE, gear_table

#: Bytes searched at a time: bounds memory, not chunks.
SEGMENT = 1 << 20
_TERMS = 64
#: Bits behind the point of the sums, and terms after which what is left out is less than 1.
_POINT, _CLOSE = 32, 32
#: A sum whose fraction is below this is right: 64 shifts and the terms left out make less than the rest.
_SURE = (1 << 32) - (1 << 8)


@lru_cache(maxsize=1)
def _gear() -> tuple[list[int], np.ndarray]:
    table = gear_table()
    return table, np.array(table, np.uint64) << np.uint64(_POINT)


def backend_description() -> str:
    """What cuts chunks, for people."""
    return f"NumPy {np.__version__} in Arrow batches"


def center_size(avg: int, least: int, source: int) -> int:
    """Where the strict condition gives way to the loose one."""
    return min(max(0, avg - min(least + -(-least // 2), avg)), source)


def masks(avg: int) -> tuple[int, int]:
    bits = round(math.log2(avg))
    return (1 << (bits + 1)) - 1, (1 << (bits - 1)) - 1


class _Search:
    """Places in data where p & loose may be 0, with their sums, found by segments as they are asked for."""

    def __init__(self, data: bytes, loose: int) -> None:
        self.data, self.loose, self.done = np.frombuffer(data, np.uint8), np.uint64(loose), {}

    def segment(self, k: int) -> tuple[list[int], list[int]]:
        if k not in self.done:
            a = max(0, k * SEGMENT - _TERMS)
            s = _gear()[1][self.data[a : (k + 1) * SEGMENT]]
            step = 1
            while step < _TERMS:
                more = s[:-step] >> np.uint64(step)
                s = s.copy() if step == 1 else s
                s[step:] += more
                step *= 2
            p = s >> np.uint64(_POINT)
            at = np.flatnonzero(((p + np.uint64(1)) & self.loose) <= 2)  # p, one less or, by a carry, one more
            at = at[at >= k * SEGMENT - a]
            self.done = {k: ((at + a).tolist(), s[at].tolist())}
        return self.done[k]

    def between(self, start: int, stop: int):
        k = start // SEGMENT
        while k * SEGMENT < stop:
            places, sums = self.segment(k)
            for i in range(bisect_left(places, start), len(places)):
                if places[i] >= stop:
                    return
                yield places[i], sums[i]
            k += 1


def _exact(data: bytes, first: int, at: int) -> int:
    """p after the bytes from first to at: from 64 terms where the rest can't change the floor, else from all."""
    gear = _gear()[0]
    if at - first >= _TERMS + _CLOSE:
        total = 0
        for j in range(64):
            total += gear[data[at - j]] << (63 - j)
        if (total & ((1 << 63) - 1)) + (1 << 33) < 1 << 63:
            return total >> 63
    p = 0
    for i in range(first, at + 1):
        p = (p >> 1) + gear[data[i]]
    return p


def cuts(data: bytes, least: int = MIN_SIZE, avg: int = AVG_SIZE, most: int = MAX_SIZE) -> list[tuple[int, int]]:
    """(offset, length) of the chunks of data: contiguous, covering it, none longer than most, only the last shorter than least."""
    n = len(data)
    if n <= least:
        return [(0, n)] if n else []
    strict, loose = masks(avg)
    center, gear, search = center_size(avg, least, most), _gear()[0], _Search(data, loose)
    out, start = [], 0
    while start < n:
        size = min(most, n - start)
        length, first = size, start + least
        if size > least:
            turn, end, p, far = start + min(center, size), start + size, 0, first + _TERMS
            near = min(first + _CLOSE, end)
            for i in range(first, near):  # windows of the search would reach back beyond the reset
                p = (p >> 1) + gear[data[i]]
                if not p & (strict if i < turn else loose):
                    length = i + 1 - start
                    break
            else:
                for i, total in search.between(near, end):
                    p = total >> _POINT if i >= far and total & 0xFFFFFFFF < _SURE else _exact(data, first, i)
                    if not p & (strict if i < turn else loose):
                        length = i + 1 - start
                        break
        out.append((start, length))
        start += length
    return out


def cuts_by_byte(data: bytes, least: int, avg: int, most: int) -> list[tuple[int, int]]:
    """The definition, byte by byte: for tests."""
    strict, loose = masks(avg)
    center, gear, out, start = center_size(avg, least, most), gear_table(), [], 0
    if len(data) <= least:
        return [(0, len(data))] if data else []
    while start < len(data):
        size = min(most, len(data) - start)
        i, p, length = min(least, size), 0, size
        while i < size:
            p = (p >> 1) + gear[data[start + i]]
            if not p & (strict if i < min(center, size) else loose):
                length = i + 1
                break
            i += 1
        out.append((start, length))
        start += length
    return out
