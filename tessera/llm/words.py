"""Words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from tessera.llm.anchors import mix

_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], "u8")
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: Bytes of a word that are hashed in numpy; longer words are hashed one by one.
LONG = 64


class WordTable:
    """The words, by ASCII white space, of texts (bytes) that lie in ``joined`` with a newline after each.

    first, end: where each word lies; hashed: its 64-bit hash; starts: where each
    text begins; of text i the words are low[i] to low[i + 1] - 1.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.joined = joined = joined.lower() if lower else joined  # bytes: ASCII letters only
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype("i8")
        space = np.concatenate([[True], _IS_SPACE[np.frombuffer(joined, "u1")]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.first, self.end = edge[::2], edge[1::2]
        self.low = np.searchsorted(self.first, self.starts)
        size = self.end - self.first
        eight = np.ndarray((len(joined),), "<u8", joined + bytes(8), strides=(1,))  # the eight bytes from each place on
        self.hashed = mix((eight[self.first] & _LOW[np.minimum(size, 8)]) * _ODD[0] + size.astype("u8"))
        for k in range(8, LONG, 8):
            at = np.flatnonzero(size > k)
            if not len(at):
                break
            self.hashed[at] = mix(self.hashed[at] * _ODD[1] + (eight[self.first[at] + k] & _LOW[np.minimum(size[at] - k, 8)]))
        for i in np.flatnonzero(size > LONG).tolist():
            self.hashed[i] = xxhash.xxh64_intdigest(joined[self.first[i] : self.end[i]])
