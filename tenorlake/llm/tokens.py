"""Words of many texts at once, as positions and 64-bit hashes in NumPy arrays.

Separators are single bytes below 128, so UTF-8 bytes can be cut without decoding them.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Bytes that separate words in ``[^\\x20\\x09-\\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = ~SPACE
#: Letters and digits, and every byte of a longer character: words without punctuation.
ALNUM = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
ALNUM_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)

#: Bases of the word hashes, a pair for each of two independent hashes; they are taken modulo the prime 2**31 - 1.
BASES = ((0x4E3779B9, 0x42B2AE3D), (0x165667B1, 0x27D4EB2F))
PRIME = np.uint64((1 << 31) - 1)
STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))
#: A word of more bytes is hashed on its own.
LONG_WORD = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def modulo(x: np.ndarray) -> np.ndarray:
    """Values below 2**62 modulo ``PRIME``."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo ``PRIME``, ``n`` at least."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        p = int(PRIME)
        known = ()
        for step in (base, pow(base, -1, p)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate((out, modulo(out * np.uint64(pow(step, len(out), p)))))
            known += (out,)
        _powers[base] = known
    return known


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (one more at the end)."""
    inside = is_word[data]
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, chunk: int = 1 << 19) -> np.ndarray:
    """A 62-bit hash of every word's bytes, spread over 64 bits: two polynomials modulo a prime (Karp-Rabin).

    ``which``, 0 or 1, names one of two hashes with bases of their own.
    """
    out = np.empty(len(starts), np.uint64)
    long = ends - starts > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), which)
    if long.any():
        out[~long] = word_hashes(data, starts[~long], ends[~long], which, chunk)
        return out
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + chunk, side="right")))
        high = ends[to - 1]
        a, b = starts[at:to] - low, ends[at:to] - low
        own = data[low:high].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(high - low + 1, np.uint64)
        half = []
        for base in BASES[which]:
            up, down = powers(base, max(chunk, int(high - low)))
            # below 2**39 each and at most 2**20 and a chunk of them: no overflow
            np.cumsum(own * up[: high - low], out=sums[1:])
            half.append(modulo(modulo(sums[b] - sums[a]) * down[a]))
        out[at:to] = half[0] << np.uint64(31) | half[1]
        at = to
    return mixed(out)


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash for each run of ``length`` words, by the index of its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, length):
        total *= STEPS[which]
        total += words[k : k + n]
    return mixed(total)


def text_of_word(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
