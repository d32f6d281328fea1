"""Word shingles of texts as sorted arrays of 64-bit hashes, and minima of universal hashes over them."""

from __future__ import annotations

import numpy as np

#: Odd multipliers. Any would do; all workers must have the same.
MIX = np.uint64(0x9FB21C651E98DF25)
PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x = x * PLACES[0]
    return x ^ (x >> np.uint64(32))


def _placed(value: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit number for a byte at a place of its word, without any linear structure."""
    return mixed((place.astype(np.uint64) << np.uint64(8) | value.astype(np.uint64)) * PLACES[2] + PLACES[3])


class Words:
    """Hashes of the lower-cased words of texts, in bytes.

    A hash is the sum of a mixed number for every (byte, place), mixed again with the length: tabulation hashing, with a
    computed table. Two different words collide with a probability of 2**-64, whatever structure they have; a
    polynomial modulo 2**64 would be the same for words such as that of Thue and Morse and its complement.
    """

    #: Places with a ready table; numbers of later ones are computed.
    NEAR = 64

    def __init__(self) -> None:
        place, value = np.divmod(np.arange(self.NEAR * 256, dtype=np.int64), 256)
        self.table = _placed(value, place)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, words up to the end of each text). A-Z count as a-z."""
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined.lower(), np.uint8)
        space = SPACE[data]
        # A text's words end where the next text begins, as a line feed lies between.
        word = ~space
        starts = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        value = data[word]
        place = np.arange(len(value)) - np.repeat(first, sizes)
        if int(sizes.max()) <= self.NEAR:
            numbers = self.table[place << 8 | value]
        else:
            near = place < self.NEAR
            numbers = np.empty(len(value), np.uint64)
            numbers[near] = self.table[place[near] << 8 | value[near]]
            numbers[~near] = _placed(value[~near], place[~near])
        h = mixed(np.add.reduceat(numbers, first) ^ sizes.astype(np.uint64) * PLACES[1])
        return h, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], words: Words, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text; of its whole sequence if it has fewer words."""
    h, upto = words.of(texts)
    grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
    factor = [mixed(np.array([j + 1], np.uint64))[0] | np.uint64(1) for j in range(k)]
    for j in range(k):
        grams += h[j : j + len(grams)] * factor[j]
    grams = mixed(grams)
    out, at = [], 0
    for end in upto.tolist():
        n = end - at
        if n >= k:
            s = np.sort(grams[at : end - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            whole = np.array([n], np.uint64)
            for j in range(n):
                whole = whole * MIX + h[at + j]
            out.append(mixed(whole))
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs (odd multiplier, addend) of the multiply-add-shift family."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), r.integers(0, 1 << 64, n, np.uint64)


def minima(values: np.ndarray, family: tuple[np.ndarray, np.ndarray], block: int = 1024) -> np.ndarray:
    """The least upper half of a * x + b over all x, for each (a, b) of the family, as 32-bit numbers."""
    a, b = family
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    for at in range(0, len(values), block):
        grid = values[None, at : at + block] * a[:, None]
        grid += b[:, None]
        np.minimum(least, grid.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)
