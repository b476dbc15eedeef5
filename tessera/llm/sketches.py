"""Document fingerprints: invertible Bloom lookup sketches over hashed paragraph pieces.

A text's paragraphs (lines), long ones cut after words that a hash picks, become
64-bit digests; a piece that is repeated counts its earlier occurrences in, so
that a text is a set of digests. Each digest is added to three cells, which hold
a count, the xor of the digests and the xor of their checks. Subtracting one
version's cells from another's leaves the digests that only one has; peeling
cells that hold a single one recovers them all.

A fingerprint has as many cells as it takes to peel all of its own digests. The
places are the low bits of a hash, so a sketch folds to half as many cells by
adding its halves, and two fingerprints are compared at any size: it begins with
few cells, and where peeling fails a larger sketch is tried, beyond the smaller
fingerprint's own size by peeling that one and adding its digests to more cells.
The likeness is 1 - |difference| / (|a| + |b|); ``likeness_of`` computes it of
two returned strings, and ``compare_versions`` all documents of a task together.

Cases: null texts are empty; two empty texts are alike (1); equal texts have
equal fingerprints; documents are ordered by descending doc_id, rows of one
doc_id by descending hash of the text (equal rows follow each other), null
doc_ids count as the smallest long; the last one's next is the first; the next
of a lone document is itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import mix
from tessera.llm.words import WordTable

#: About how many words a piece has; the fewest cells in each third of a sketch, and cells in a third for each digest.
PIECE_WORDS, LEAST, LOAD = 8, 4, 0.5
#: Rounds of peeling after which a larger sketch is tried; few take a tenth of them.
ROUNDS = 200
#: Documents of a task, sampled doc_ids for each task's boundary, and how many of them the driver gets at most.
ROWS_OF_TASK, SAMPLES, MOST_SAMPLES = 1500, 10, 1_000_000
#: Stands for a null doc_id where documents are ordered.
NO_ID = -(2**63)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
CELL = np.dtype([("count", "<i2"), ("key", "<u8"), ("check", "<u4")])
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Sets:
    """Sets of digests: those of set i are keys[low[i]:low[i + 1]]."""

    def __init__(self, doc: np.ndarray, keys: np.ndarray, n: int):
        self.keys, self.low = keys, np.searchsorted(doc, np.arange(n + 1))
        self.size = np.diff(self.low)

    def pick(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in at, digest) of the digests of these sets."""
        n = self.size[at]
        where = np.repeat(self.low[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(at)), n), self.keys[where]


def sets_of(texts: list[str]) -> Sets:
    """The sets of digests of the texts' pieces."""
    data = [t.encode() for t in texts]
    words = WordTable(data)
    n = len(words.hashed)
    doc = np.repeat(np.arange(len(data)), np.diff(words.low))
    line = np.cumsum(np.frombuffer(words.joined, "u1") == 10)[words.first] if n else words.first
    stop = ((words.hashed >> np.uint64(20)) % np.uint64(PIECE_WORDS) == 0) | np.append(line[1:] != line[:-1], np.ones(min(1, n), bool))
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), stop[:-1]]))
    size = np.diff(np.append(begin, n))
    place = (np.arange(n) - np.repeat(begin, size)).astype("u8")
    keys = mix(np.add.reduceat(mix(words.hashed + place * _ODD[0]), begin) + size.astype("u8")) if n else words.hashed
    bare = [i for i, t in enumerate(data) if t and words.low[i] == words.low[i + 1]]  # white space only
    doc = np.concatenate([doc[begin], np.array(bare, "i8")])
    keys = np.concatenate([keys, np.array([xxhash.xxh64_intdigest(data[i]) for i in bare], "u8")])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    head = np.concatenate([np.ones(min(1, len(keys)), bool), (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])
    nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0)) if len(keys) else keys
    return Sets(doc, mix(keys + nth.astype("u8") * _ODD[1]), len(data))


def digests(text: str) -> np.ndarray:
    """The set of digests of a text's pieces, as many as it has pieces."""
    return sets_of([text]).keys


def power_from(n: np.ndarray) -> np.ndarray:
    """The least power of two from each number on, LEAST at least."""
    return 1 << np.ceil(np.log2(np.maximum(n, LEAST))).astype("i8")


class Cells:
    """Sketches side by side; third[d] is a third of the cells of sketch d, a power of two."""

    def __init__(self, third: np.ndarray):
        self.third = third.astype("i8")
        self.base = np.concatenate([[0], np.cumsum(3 * self.third)])
        n = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(n, "i8"), np.zeros(n, "u8"), np.zeros(n, "u4")

    def places(self, doc: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        third, at = self.third[doc], mix(key * _ODD[2])
        return [self.base[doc] + j * third + ((at >> np.uint64(20 * j)).astype("i8") & (third - 1)) for j in range(3)]

    @staticmethod
    def check_of(key: np.ndarray) -> np.ndarray:
        return (mix(key + _ODD[0]) >> np.uint64(32)).astype("u4")

    def add(self, doc: np.ndarray, key: np.ndarray, sign: np.ndarray | int) -> None:
        check = self.check_of(key)
        for at in self.places(doc, key):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, digest) of all that could be recovered, and whether each sketch was emptied."""
        n = len(self.third)
        of = np.repeat(np.arange(n), 3 * self.third)
        docs, keys = [np.zeros(0, "i8")], [np.zeros(0, "u8")]
        look = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(ROUNDS):  # what isn't done by then has failed
            look = look[(np.abs(self.count[look]) == 1) & (self.check_of(self.key[look]) == self.check[look])]
            if not len(look):
                break
            doc, key, sign = of[look], self.key[look], self.count[look]
            first = np.unique(mix(key) + doc.astype("u8"), return_index=True)[1]  # a digest can stand alone in several cells
            doc, key, sign = doc[first], key[first], sign[first]
            self.add(doc, key, -sign)
            docs.append(doc)
            keys.append(key)
            look = np.unique(np.concatenate(self.places(doc, key)))
        whole = np.ones(n, bool)
        whole[of[(self.count != 0) | (self.key != 0) | (self.check != 0)]] = False
        return np.concatenate(docs), np.concatenate(keys), whole

    def packed(self) -> list[str]:
        """Each sketch as text."""
        cells = np.zeros(len(self.count), CELL)
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check
        return [base64.b64encode(cells[a:b].tobytes()).decode() for a, b in zip(self.base.tolist(), self.base[1:].tolist(), strict=False)]


def fingerprints(sets: Sets) -> list[str]:
    """The sketch of each set that has cells enough to be peeled."""
    out = [""] * len(sets.size)
    third, todo = power_from(LOAD * sets.size), np.arange(len(sets.size))
    while len(todo):
        table = Cells(third[todo])
        table.add(*sets.pick(todo), 1)
        made = table.packed()
        whole = table.peel()[2]
        for k in np.flatnonzero(whole).tolist():
            out[todo[k]] = made[k]
        todo = todo[~whole]
        third[todo] *= 2
    return out


def first_third(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """With how many cells two fingerprints are compared first: as many as a fifth of what both have would need."""
    return power_from(LOAD * np.maximum(np.abs(n_a - n_b), (n_a + n_b) // 5))


def differences(a: Sets, b: Sets) -> np.ndarray:
    """How many digests only one of a[i] and b[i] has: subtract, peel, retry larger."""
    out, todo, third = np.zeros(len(a.size), "i8"), np.arange(len(a.size)), first_third(a.size, b.size)
    while len(todo):
        table = Cells(third[todo])
        table.add(*a.pick(todo), 1)
        table.add(*b.pick(todo), -1)
        doc, _, whole = table.peel()
        out[todo[whole]] = np.bincount(doc, minlength=len(todo))[whole]
        todo = todo[~whole]
        third[todo] *= 2
    return out


def likeness(a: Sets, b: Sets) -> np.ndarray:
    total = a.size + b.size
    return np.where(total > 0, 1 - differences(a, b) / np.maximum(total, 1), 1.0)


def unpacked(fingerprint: str) -> Cells:
    cells = np.frombuffer(base64.b64decode(fingerprint), CELL)
    table = Cells(np.array([len(cells) // 3]))
    table.count, table.key, table.check = cells["count"].astype("i8"), cells["key"].copy(), cells["check"].copy()
    return table


def resized(table: Cells, third: int) -> Cells:
    """The sketch of the same digests with another number of cells: folded, or peeled and added anew."""
    out = Cells(np.array([third]))
    own = int(table.third[0])
    if third > own:
        copy = Cells(table.third)
        copy.count, copy.key, copy.check = table.count.copy(), table.key.copy(), table.check.copy()
        doc, key, _ = copy.peel()
        out.add(doc, key, 1)
        return out
    fold = lambda x: x.reshape(3, own // third, third)
    out.count = fold(table.count).sum(axis=1).ravel()
    out.key, out.check = (np.bitwise_xor.reduce(fold(x), axis=1).ravel() for x in (table.key, table.check))
    return out


def likeness_of(fingerprint: str, other: str) -> float:
    """The likeness of two fingerprints, from nothing but them."""
    a, b = unpacked(fingerprint), unpacked(other)
    n_a, n_b = (int(x.count.sum()) // 3 for x in (a, b))
    if not n_a + n_b:
        return 1.0
    third = int(first_third(np.array([n_a]), np.array([n_b]))[0])
    while True:
        left, right = resized(a, third), resized(b, third)
        left.count -= right.count
        left.key ^= right.key
        left.check ^= right.check
        doc, _, whole = left.peel()
        if whole[0]:
            return 1 - len(doc) / (n_a + n_b)
        third *= 2


def compare_group(table: pa.Table) -> pa.Table:
    """One stretch of documents, and as guest the first document of the next stretch."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("guest", "place", "hash", "doc_id", "text")), strict=True), key=lambda r: (r[0], -r[1], -r[2]))
    own = [r for r in rows if not r[0]]
    texts = [r[4] for r in own]
    following = [*texts[1:], next((r[4] for r in rows if r[0]), texts[0] if texts else "")]
    edited = []
    for t, after in zip(texts, following, strict=True):
        k = len(t) // 3
        edited.append(t[: len(t) - k] + after[:k])
    mine, changed, after = sets_of(texts), sets_of(edited), sets_of(following)
    columns = [
        pa.array([r[3] for r in own], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(fingerprints(mine), pa.string()),
        pa.array(fingerprints(changed), pa.string()),
        pa.array(likeness(mine, changed), pa.float64()),
        pa.array(likeness(mine, after), pa.float64()),
    ]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])


def whole_number(place: int, hashed: int) -> int:
    """Two longs as one number that is ordered as they are."""
    return (place << 64) + hashed + 2**63


def compare_versions(docs: DataFrame, rows_of_task: int = ROWS_OF_TASK) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    Documents are dealt into stretches of neighbours by doc_id and hash of the
    text, so that rows of one doc_id are split too. The stretches end at
    documents of the table, of which a sample of at most about MOST_SAMPLES (two
    numbers each) is all that the driver sees; so the first document of a
    stretch is known beforehand and is sent to the stretch before it as well.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("place"), F.xxhash64("text").alias("hash"), "doc_id", "text")
    n, top = rows.agg(F.count("*"), F.max(F.struct("place", "hash"))).first()
    one_in = max(1, rows_of_task // SAMPLES, n // MOST_SAMPLES)
    sample = rows.select("place", "hash").where(F.pmod(F.xxhash64("place", "hash"), F.lit(one_in)) == 0).distinct().collect()
    found = sorted(whole_number(*r) for r in sample)[SAMPLES - 1 :: SAMPLES]
    last = whole_number(*top) if top else 0
    bounds = [*[b for b in found if b < last], last]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [whole_number(p, h) for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            part = [bisect_left(bounds, k) for k in keys]
            ends = [i for i, k in enumerate(keys) if bounds[part[i]] == k]
            take = pa.array([*range(len(keys)), *ends], pa.int64())
            to = pa.array([*part, *[(part[i] + 1) % len(bounds) for i in ends]], pa.int32())
            guest = pa.array([False] * len(keys) + [True] * len(ends))
            yield pa.RecordBatch.from_arrays([to, guest, *(b.column(i).take(take) for i in range(4))], ["part", "guest", "place", "hash", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part int, guest boolean, place long, hash long, doc_id long, text string")
    return dealt.groupBy("part").applyInArrow(compare_group, RESULT)
