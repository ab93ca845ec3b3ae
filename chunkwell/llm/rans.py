"""Static range asymmetric numeral system (rANS) over token ids, vectorised over interleaved lanes."""

from __future__ import annotations

import zlib

import numpy as np

SCALE, LOW, LANES, BLOCK, EVERY = 18, 1 << 31, 512, 1 << 18, 256
_M = 1 << SCALE


class BadChecksum(ValueError):
    pass


class Table:
    """Frequencies of the symbols present, scaled to sum to 2**SCALE; shared by all blocks of a segment."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self._slots: np.ndarray | None = None
        self._at: np.ndarray | None = None

    @property
    def at(self) -> np.ndarray:
        """The place of each symbol in the table."""
        if self._at is None:
            self._at = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.int64)
            self._at[self.symbols] = np.arange(len(self.symbols))
        return self._at

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        every = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(every)
        count = every[symbols]
        if len(symbols) > _M // 2:
            raise ValueError(f"{len(symbols)} distinct ids; a table holds {_M // 2}")
        f = np.maximum(1, count * _M // max(1, count.sum())).astype(np.int64)
        over = int(f.sum()) - _M
        for i in np.argsort(-f, kind="stable"):  # the largest give or take what rounding left
            if over == 0:
                break
            step = min(over, int(f[i]) - 1) if over > 0 else over
            f[i] -= step
            over -= step
        return cls(symbols, f)

    def dump(self) -> bytes:
        gaps = np.diff(self.symbols.astype(np.int64), prepend=0).astype("<u4")
        return zlib.compress(len(gaps).to_bytes(4, "little") + gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + self.freq.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)

    @classmethod
    def load(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        n = int.from_bytes(raw[:4], "little")
        planes = np.frombuffer(raw, np.uint8, offset=4).reshape(2, 4, n)
        gaps, freq = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes)
        return cls(np.cumsum(gaps.astype(np.int64)), freq)


def encode(ids: np.ndarray, table: Table) -> dict:
    """One block: n, lanes, words (in decoding order), checkpoints and the ids' checksum.

    A checkpoint (step, word position, lane states) lets decoding begin at that step.
    """
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    at = table.at[ids]
    grid = np.full(steps * lanes, int(np.argmax(table.freq)) if len(table.freq) else 0, np.int64)
    grid[:n] = at
    f, c = table.freq[grid].reshape(steps, lanes), table.cum[grid].reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    out, s32, scale, bound = 0, np.uint64(32), np.uint64(SCALE), np.uint64((LOW >> SCALE) << 32)
    low32 = np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        ft = f[t]
        full = x >= ft * bound
        if full.any():
            words.append((x[full] & low32).astype("<u4"))
            out += len(words[-1])
            x[full] >>= s32
        q = x // ft
        x = (q << scale) + (x - q * ft) + c[t]
        if t % EVERY == 0:
            marks.append((t, out, x.astype("<u8").tobytes()))
    body = np.concatenate(words[::-1]).tobytes() if words else b""
    return {"n": n, "lanes": lanes, "words": body, "marks": [(t, out - pos, state) for t, pos, state in reversed(marks)], "crc": zlib.crc32(ids.astype("<u4").tobytes())}


def decode(block: dict, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids[start:stop] of a block, from the last checkpoint before start; the whole block is checked against its checksum."""
    n, lanes = block["n"], block["lanes"]
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, "<u4")
    first = start // lanes // EVERY
    t0, pos, state = block["marks"][first]
    words, x = np.frombuffer(block["words"], "<u4"), np.frombuffer(state, "<u8").astype(np.uint64)
    steps = -(-stop // lanes) - t0
    got = np.empty((steps, lanes), np.uint32)
    mask, scale, low, s32 = np.uint64(_M - 1), np.uint64(SCALE), np.uint64(LOW), np.uint64(32)
    slots, freq, cum = table.slots, table.freq, table.cum
    for t in range(steps):
        slot = x & mask
        s = slots[slot]
        got[t] = s
        x = freq[s] * (x >> scale) + slot - cum[s]
        need = x < low
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << s32) | words[pos : pos + k].astype(np.uint64)
            pos += k
    ids = table.symbols[got.ravel()].astype("<u4")[start - t0 * lanes : stop - t0 * lanes]
    if start == 0 and stop == n and zlib.crc32(ids.tobytes()) != block["crc"]:
        raise BadChecksum(f"a block of {n} ids does not match its checksum")
    return ids
