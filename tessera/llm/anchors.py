"""Content-defined anchors of byte strings, in numpy.

Every ``span`` consecutive bytes hold ``span - K + 1`` K-byte grams; the one with
the smallest hash (the first of equal ones) is their anchor. As this depends on
these bytes alone, equal strings have their anchor at the same place, and a
whole run of neighbouring strings shares one.
"""

from __future__ import annotations

import functools

import numpy as np

K, HASH_BITS, PLACE_BITS = 24, 40, 24
#: Bytes that are looked at together; a longer text is met in stretches of so many strings.
STRETCH = 4_000_000
BASE = 0x9E3779B97F4A7C55
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the end."""
    x = np.concatenate([buf, np.zeros(8, "u1")]).astype("u8")
    x = x[:-1] | (x[1:] << _U(8))
    x = x[:-2] | (x[2:] << _U(16))
    return (x[:-4] | (x[4:] << _U(32)))[: len(buf)]


@functools.lru_cache(maxsize=2)
def powers(base: int) -> np.ndarray:
    """Powers of an odd number, as many as a stretch has places."""
    out = np.full(STRETCH + 1000, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchors of the span-byte strings of several texts that lie in buf one after the other.

    at: place of each anchor; low, high: first and last start of the strings
    that it stands for; hashed: its HASH_BITS; context: a hash of the bytes from
    low to high + span and of where the anchor lies in them; text: which text.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray, span: int, stretch: int = STRETCH):
        self.buf, self.span = buf, span
        ends = np.append(starts[1:], len(buf))
        found = [self.scan(buf[a : a + stretch + span - 1], starts - a, ends - a) + (a,) for a in range(0, max(1, len(buf) - span + 1), stretch)]
        self.at, self.low, self.high = (np.concatenate([f[i] + f[5] for f in found]) for i in range(3))
        self.hashed, self.context = (np.concatenate([f[i] for f in found]) for i in (3, 4))
        self.text = np.searchsorted(starts, self.at, side="right") - 1

    def scan(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
        """(at, low, high, hashed, context) over one stretch; starts and ends of texts may lie outside."""
        n, span, empty = len(buf), self.span, np.zeros(0, "i8")
        if n < span:
            return empty, empty, empty, empty.astype("u8"), empty.astype("u8")
        x = eights(buf)
        gram = x * _U(0x9E3779B97F4A7C15)  # of K = 24 bytes
        gram[:-8] += x[8:] * _U(0xC2B2AE3D27D4EB4F)
        gram[:-16] += x[16:] * _U(0x165667B19E3779F9)
        gram ^= gram >> _U(29)
        gram *= _U(0xBF58476D1CE4E5B9)
        gram ^= gram >> _U(32)
        gram *= _U(0x94D049BB133111EB)
        low_bits = _U((1 << PLACE_BITS) - 1)
        v = (gram & ~low_bits) | np.arange(n, dtype="u8")
        width = span - K + 1
        least, have = v, 1
        while 2 * have <= width:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        least = least[: n - span + 1]
        whole = np.zeros(n + 1, "i4")  # starts of strings that lie within one text
        fits = (ends - starts >= span) & (ends - span >= 0) & (starts <= n - span)
        np.add.at(whole, np.maximum(starts[fits], 0), 1)
        np.add.at(whole, np.minimum(ends[fits] - span + 1, n), -1)
        windows = np.flatnonzero(np.cumsum(whole[: n - span + 1]))
        if not len(windows):
            return empty, empty, empty, empty.astype("u8"), empty.astype("u8")
        where = (least[windows] & low_bits).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([first[1:], [len(windows)]]) - 1
        at, low, high = where[first], windows[first], windows[last]
        hashed = gram[at] >> _U(PLACE_BITS)
        # a sum of mixed 8-byte grams times powers of an odd base: any stretch's hash from two prefix sums
        x *= _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(32)
        x *= _U(0xC4CEB9FE1A85EC53)
        x *= powers(BASE)[:n]
        total = np.zeros(n + 1, "u8")
        np.cumsum(x, out=total[1:])
        back = powers(pow(BASE, -1, 1 << 64))
        summed = (total[high + span - 7] - total[low]) * back[low]
        return at, low, high, hashed, mix(summed + ((at - low) * 131 + (high - low)).astype("u8"))
