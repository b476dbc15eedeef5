"""Best-fit packing with a swap-based local search.

Every document's tokens end in the separator id; longer ones than ``capacity``
are cut into full pieces with the shorter piece first. Pieces are dealt at
random (by a hash of document and piece) into groups of a bounded number of
documents, so a task never grows with the corpus. Each group is packed by best
fit over decreasing lengths; then a local search works on its underfull bins:
it moves a document, exchanges one for one, one for two or two for one, always
into a bin that is as full or fuller, by which the sum of squared fills grows,
until no such step is left or as many bins are used as any packing needs (total
size, and documents of which no two fit together). Partners are looked up by the
sizes, and sums of two sizes, that bins with so much room hold: a bin has at most
44 different sizes, so the index stays small. A group can leave at most about
one bin short of full for want of company.

Ids are those of the JSON file's tokenizer without special tokens added: its
added tokens have their own ids where a text spells them out.

Cases: null texts are empty and are one separator; repeated rows are packed
once each; ties of length go by doc_id and piece (null doc_ids last), and equal
rows are interchangeable; texts of any length are encoded whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_text, load
from tessera.llm.common import texts_of

CAPACITY, SEPARATOR, GROUP = 1024, 2, 25_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path, pattern, with_added=True)
        for b in batches:
            out: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                ids = np.array([*encode_text(encoding, t, with_added=True), separator], dtype="<u4")
                out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Bins of sizes, found by free room: a bit mask says for which amounts of room there are bins."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0

    def put_back(self, k: int, room: int) -> None:
        """Bin k now has this room."""
        old = self.free[k]
        self.by_room[old].discard(k)
        if not self.by_room[old]:
            self.mask &= ~(1 << old)
        self.free[k] = room
        if self.items[k]:  # an empty bin isn't offered
            self.by_room[room].add(k)
            self.mask |= 1 << room

    def best(self, size: int, without: int = -1) -> int:
        """The fullest bin that has room for size, or -1."""
        m = self.mask >> size
        while m:
            room = size + (m & -m).bit_length() - 1
            found = next((k for k in self.by_room[room] if k != without), -1)
            if found >= 0:
                return found
            m &= m - 1
        return -1

    def add(self, item: int, size: int, k: int) -> None:
        if k < 0:
            k = len(self.items)
            self.items.append([])
            self.free.append(self.capacity)
        self.items[k].append(item)
        self.put_back(k, self.free[k] - size)

    def take(self, item: int, size: int, k: int) -> None:
        self.items[k].remove(item)
        self.put_back(k, self.free[k] + size)


def best_fit(sizes: list[int], capacity: int) -> Bins:
    """Best fit in the given order."""
    bins = Bins(capacity)
    for i, s in enumerate(sizes):
        bins.add(i, s, bins.best(s))
    return bins


def fewest_bins(sizes: list[int], capacity: int) -> int:
    """How many bins any packing needs: for each k, documents over capacity - k are alone, those over half don't meet, and those from k to half need what these leave."""
    count = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, "i8")
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, most = capacity // 2, 0
    for k in range(1, half + 1):
        alone, big = number[-1] - number[capacity - k], number[capacity - k] - number[half]
        left = big * capacity - (total[capacity - k] - total[half])
        most = max(most, int(alone + big + max(0, -(-(total[half] - total[k - 1] - left) // capacity))))
    return max(most, -(-int(total[-1]) // capacity))


class Index:
    """For each amount of room the sizes, and sums of two sizes, that bins with it hold, as bit masks; and which bins."""

    def __init__(self, bins: Bins, sizes: list[int]):
        self.bins, self.sizes = bins, sizes
        self.masks: list[dict[int, int]] = [{}, {}, {}]
        self.holders: list[dict[tuple[int, int], set[int]]] = [{}, {}, {}]
        self.known: dict[int, tuple[int, tuple]] = {}
        for k in range(len(bins.items)):
            self.renew(k)

    def renew(self, k: int) -> None:
        """Bin k has changed."""
        if k in self.known:
            room, found = self.known.pop(k)
            for n in (1, 2):
                for size in found[n - 1]:
                    self.holders[n][room, size].discard(k)
                    if not self.holders[n][room, size]:
                        self.masks[n][room] &= ~(1 << size)
        room, items = self.bins.free[k], self.bins.items[k]
        if not room or not items:
            return
        count = Counter(self.sizes[i] for i in items)
        ones = tuple(count)
        twos = tuple({a + b for a, b in itertools.combinations(ones, 2)} | {2 * a for a, n in count.items() if n > 1})
        self.known[k] = room, (ones, twos)
        for n, found in ((1, ones), (2, twos)):
            for size in found:
                self.holders[n].setdefault((room, size), set()).add(k)
                self.masks[n][room] = self.masks[n].get(room, 0) | 1 << size

    def partner(self, n: int, size: int, most_room: int, without: int) -> tuple[int, int] | None:
        """(bin, sum of n of its documents): one that holds less than size, but no more than its room less; as full as may be."""
        for room in sorted(self.masks[n]):
            if room > most_room:
                break
            low = max(1, size - room)
            found = self.masks[n][room] >> low & ((1 << (size - low)) - 1)
            while found:
                its = low + (found & -found).bit_length() - 1
                k = next((k for k in self.holders[n][room, its] if k != without), None)
                if k is not None:
                    return k, its
                found &= found - 1
        return None


def improve(bins: Bins, sizes: list[int]) -> None:
    """Local search over underfull bins, the emptiest first, until no step is left or no packing has fewer bins."""
    least = fewest_bins(sizes, bins.capacity)
    used = sum(1 for x in bins.items if x)
    if used <= least:
        return
    index, changed = Index(bins, sizes), True
    while changed:
        changed = False
        for low in sorted(index.known, key=lambda k: (-bins.free[k], k)):
            while bins.items[low] and bins.free[low] and step(bins, index, low):
                changed = True
            if not bins.items[low]:
                used -= 1
                if used <= least:
                    return
                index.renew(low)


def step(bins: Bins, index: Index, low: int) -> bool:
    """Move a document of the bin low into a bin as full or fuller, or exchange one for one, one for two or two for one there."""
    sizes, free = index.sizes, bins.free
    own = {sizes[i]: i for i in bins.items[low]}  # one of each size
    for size in sorted(own, reverse=True):
        k = bins.best(size, low)
        if k >= 0 and free[k] <= free[low]:
            return exchange(bins, index, low, [own[size]], k, [])
    for size in sorted(own, reverse=True):
        for n in (1, 2):
            found = index.partner(n, size, free[low], low)
            if found:
                return exchange(bins, index, low, [own[size]], found[0], some(bins, sizes, found[0], n, found[1]))
    count = Counter(sizes[i] for i in bins.items[low])
    for a, b in itertools.combinations_with_replacement(sorted(own, reverse=True), 2):
        if a == b and count[a] < 2 or a + b > bins.capacity:
            continue
        found = index.partner(1, a + b, free[low], low)
        if found:
            return exchange(bins, index, low, some(bins, sizes, low, 2, a + b, (a, b)), found[0], some(bins, sizes, found[0], 1, found[1]))
    return False


def some(bins: Bins, sizes: list[int], k: int, n: int, total: int, named: tuple[int, int] | None = None) -> list[int]:
    """n documents of bin k whose sizes add up to total (and are the named ones)."""
    items = bins.items[k]
    if n == 1:
        return [next(i for i in items if sizes[i] == total)]
    first = {}
    for i in items:
        rest = total - sizes[i]
        if rest in first and (named is None or sizes[i] in named):
            return [first[rest], i]
        first.setdefault(sizes[i], i)
    raise AssertionError("the index knows a pair that the bin hasn't")


def exchange(bins: Bins, index: Index, low: int, out: list[int], k: int, back: list[int]) -> bool:
    for items, source in ((out, low), (back, k)):
        for i in items:
            bins.take(i, index.sizes[i], source)
    for items, to in ((out, k), (back, low)):
        for i in items:
            bins.add(i, index.sizes[i], to)
    index.renew(low)
    index.renew(k)
    return True


def pack_group(pdf: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = pdf["length"].tolist()
    bins = best_fit(sizes, capacity)
    improve(bins, sizes)
    sequence, offset = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64")
    base = (int(pdf["bin_group"].iloc[0]) + 1) << 32
    for k, items in enumerate(bins.items):
        at = 0
        for i in items:
            sequence[i], offset[i] = base + k, at
            at += sizes[i]
    return pdf.assign(sequence_id=sequence, offset=offset).drop(columns="bin_group")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, separator: int = SEPARATOR, group: int = GROUP) -> DataFrame:
    """One row for each piece with its sequence and its place there."""
    groups = max(1, -(-docs.count() // group))
    cut_up = pieces(docs, path, pattern, capacity, separator).withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return cut_up.groupBy("bin_group").applyInPandas(lambda pdf: pack_group(pdf, capacity), PACKED)
