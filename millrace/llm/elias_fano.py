"""Elias-Fano coding of monotone sequences, read where they lie: select and successor search on the mapped bits."""

from __future__ import annotations

import struct

import numpy as np

#: Of a sequence: values, bits of a low half, bytes of low and of high halves. All parts are multiples of 8 bytes.
HEAD = 32
#: For each byte, the places of its ones in order.
PLACES = np.array([[p for p in range(8) if b >> p & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)], np.uint8).ravel()
ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def whole(data: bytes) -> bytes:
    """Filled up to a multiple of 8 bytes."""
    return data + b"\0" * (-len(data) % 8)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits (up to 63) each, least significant bit first, and 8 spare bytes."""
    n = len(values)
    out = np.zeros(-(-n * width // 64) + 1, np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # Values in one word don't overlap, so that their sum is the word; what passes its end begins the next one.
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(values << shift, first)
        over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out.astype("<u8").tobytes()


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of 64-bit numbers: low halves packed, high halves as a unary bit vector."""
    n = len(values)
    values = values.astype(np.uint64)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
    low = min(low, 63)
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
    bits[high + np.arange(n)] = 1
    lows = pack_bits(values & np.uint64((1 << low) - 1), low)
    highs = whole(np.packbits(bits, bitorder="little").tobytes())
    return struct.pack("<QQQQ", n, low, len(lows), len(highs)) + lows + highs


class Sequence:
    """A sequence that starts at byte `at` of `data` (a memory map, or bytes in memory); `end` is where it ends.

    Only running counts of the ones and zeros in each byte of the high halves are kept beside the bits.
    """

    def __init__(self, data: np.ndarray, at: int = 0):
        self.n, self.width, lows, highs = struct.unpack("<QQQQ", data[at : at + HEAD].tobytes())
        self.end = at + HEAD + lows + highs
        self.lows = np.asarray(data[at + HEAD : at + HEAD + lows].view("<u8"))
        self.highs = np.asarray(data[at + HEAD + lows : self.end])
        self.mask = np.uint64((1 << self.width) - 1)
        self._ones: np.ndarray | None = None
        self._zeros: np.ndarray | None = None

    @property
    def ones(self) -> np.ndarray:
        """Ones in the bytes up to and with each."""
        if self._ones is None:
            self._ones = np.cumsum(ONES[self.highs])
        return self._ones

    @property
    def zeros(self) -> np.ndarray:
        """Zeros in the bytes up to and with each."""
        if self._zeros is None:
            self._zeros = np.arange(8, 8 * len(self.highs) + 8, 8) - self.ones
        return self._zeros

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # A shift by 64 in two steps, as one has no effect.
        return ((self.lows[word] >> shift) | (self.lows[word + 1] << (np.uint64(63) - shift) << np.uint64(1))) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the given indexes."""
        byte = np.searchsorted(self.ones, i, side="right")
        held = self.highs[byte]
        rank = i - (self.ones[byte] - ONES[held])
        high = byte * 8 + PLACES[held * np.int64(8) + rank] - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high half of `high` or less (-1 or more): the ones before the zero of that number."""
        zeros = self.zeros
        inside = np.clip(high, 0, zeros[-1] - 1)
        byte = np.searchsorted(zeros, inside, side="right")
        flipped = ~self.highs[byte]
        rank = inside - (zeros[byte] - ONES[flipped])
        ones = byte * 8 + PLACES[flipped * np.int64(8) + rank] - inside
        return np.where(high < 0, 0, np.where(high >= zeros[-1], self.n, np.minimum(ones, self.n)))

    def successors(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value not below each query, whether it is equal)."""
        if not self.n or not len(queries):
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), bool)
        queries = queries.astype(np.uint64)
        high = np.minimum(queries >> np.uint64(self.width), np.uint64(1 << 62)).astype(np.int64)
        want = queries & self.mask
        at = self._upto(high - 1)
        # The first value that may be it has this high half if its bit follows right on those of lower ones. Few queries need another.
        bit = np.where(at < self.n, at + high, 0)
        same = (at < self.n) & ((self.highs[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) > 0)
        low = self._low(np.minimum(at, self.n - 1))
        equal = same & (low == want)
        rest = np.flatnonzero(same & (low < want))
        if len(rest):
            at[rest], equal[rest] = self._among(at[rest] + 1, self._upto(high[rest]), want[rest])
        return at, equal

    def _among(self, at: np.ndarray, end: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value from `at` on whose low half is not below `want`, `end` if none; whether it is equal)."""
        low, up = at.copy(), end.copy()
        live = np.flatnonzero(low < up)
        while len(live):
            mid = (low[live] + up[live]) >> 1
            less = self._low(mid) < want[live]
            low[live[less]] = mid[less] + 1
            up[live[~less]] = mid[~less]
            live = live[low[live] < up[live]]
        equal = low < end
        equal[equal] = self._low(low[equal]) == want[equal]
        return low, equal


def decode(data: np.ndarray) -> np.ndarray:
    """All values of a sequence that starts at the first byte of `data`."""
    s = Sequence(data)
    return s[np.arange(s.n)]


def size_of(data: np.ndarray) -> int:
    return Sequence(data).end
